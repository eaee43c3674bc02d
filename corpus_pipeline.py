"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.

quality classifier → line dedup → n-gram Jaccard join → benchmark decontamination → best-fit packing

All stages but the last return the columns of documents, whatever further columns are called. All take empty
tables (no rows come back), and whole texts of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.common import written
from pointloom.llm.decontaminate import decontaminated
from pointloom.llm.line_dedup import line_dedup
from pointloom.llm.ngram_join import near_deduplicated
from pointloom.llm.packing import packed
from pointloom.llm.quality import quality_kept


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. The classifier is fitted on these documents.

    A null text is scored as the empty one, a null doc_id like others (its label isn't known); repeated rows
    are kept or rejected together; a score equal to the threshold is accepted.
    """
    return quality_kept(docs, _table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; n_chars counts the text that is left.

    A null text becomes the empty one; a null doc_id comes after all others; rows repeated with one doc_id keep
    the same lines; of equal ids none goes first. No row is dropped.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    out = line_dedup(docs.select(*columns)).drop("n_lines", "n_dropped")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else out


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id.

    Null and empty texts are in no group and stay; a null doc_id goes if its group has an id, else it stays; all
    rows with the smallest doc_id stay, repeated ones too. A row goes by its id and its text: another text under
    the same id, null or not, stays.
    """
    return near_deduplicated(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item.

    Null and empty texts overlap with nothing and stay; a null doc_id is like others; repeated rows stay or go
    together; an overlap of just the least length or share counts.
    """
    return decontaminated(docs, _table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences.

    Null and empty texts are packed as an end mark; a null doc_id is an id like others; repeated rows are packed
    each; documents longer than the largest sequence are cut into pieces; pieces of equal length go in table order.
    """
    return packed(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram jaccard join", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("best-fit packing", packing_stage),
]

#: The classifier can't be expressed in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents, each written as Parquet in the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
