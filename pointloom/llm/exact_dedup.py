"""Exact deduplication by content-defined chunk recipes (native).

Each normalised text is cut at positions that its own characters choose. Equal
texts have equal cuts. The distinct chunks are deduplicated by their full text,
each gets an identifier that is verified to stand for one text only, and
documents are then compared by their ordered lists of identifiers: a long text
moves once at most, as its distinct chunks, and never whole.

Results in special cases: a null text counts as empty, and all empty texts are
equal; rows repeated with the same doc_id and an equal text are one document; a
null doc_id is a document like others and stays only if no other id is in its
group; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, fresh, text_of, written

#: A chunk ends at the first of these places after MIN_CHUNK characters, or at MAX_CHUNK.
#: The classes have the same members in either case, so that cuts don't depend on case.
MIN_CHUNK, MAX_CHUNK = 256, 4096
CUT = r"(?:[.!?\n]|[aeiouAEIOU][^aeiouAEIOU]\s)"


def chunks_of(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """Content-defined chunks; joined they give the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most}}}?{CUT}|.{{1,{most}}}"), F.lit(0))


def chunk_hash(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def dictionary(chunked: DataFrame, hashed=chunk_hash) -> DataFrame:
    """The distinct chunks with their hash. The text itself is the key, so no two texts share a row."""
    return chunked.select(F.explode(F.array_distinct("chunks")).alias("chunk")).select(hashed(F.col("chunk")).alias("h"), "chunk").distinct()


def clashes(chunks: DataFrame) -> DataFrame:
    """Chunks whose hash stands for more than one text, numbered within the hash. Almost always empty.

    First only hashes are counted; the texts move again only if one is ambiguous.
    """
    shared = written(chunks.groupBy("h").count().where("count > 1").select("h"), "ambiguous")
    if shared.isEmpty():
        return chunks.sparkSession.createDataFrame([], "h long, chunk string, nth int")
    return chunks.join(shared, "h", "left_semi").select("h", "chunk", F.row_number().over(Window.partitionBy("h").orderBy("chunk")).alias("nth"))


def recipes(docs: DataFrame, hashed=chunk_hash, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> DataFrame:
    """(doc_id, text_sha256, recipe): recipe is the ordered list of verified chunk identifiers."""
    norm = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.transform(chunks_of(text_of(), least, most), ascii_lower).alias("chunks"))
    table = written(
        norm.select("doc_id", F.sha2(F.array_join("chunks", ""), 256).alias("text_sha256"), F.transform("chunks", hashed).alias("recipe")).groupBy("doc_id", "text_sha256", "recipe").agg(F.count(F.lit(1)).alias("copies")),
        "recipes",
    )
    bad = clashes(dictionary(norm, hashed))
    if bad.isEmpty():  # verified: each hash stands for one text
        return table.select("doc_id", "text_sha256", "recipe", F.array().cast("array<int>").alias("nth"))
    # Some hashes are ambiguous: those chunks also carry their number within the hash.
    hit = norm.withColumn("text_sha256", F.sha2(F.array_join("chunks", ""), 256)).select("doc_id", "text_sha256", F.posexplode("chunks").alias("pos", "chunk")).withColumn("h", hashed(F.col("chunk")))
    found = hit.join(bad, ["h", "chunk"]).groupBy("doc_id", "text_sha256").agg(F.sort_array(F.collect_set(F.struct("pos", "nth"))).alias("nth"))
    found = found.select("doc_id", "text_sha256", F.transform("nth", lambda x: x["nth"]).alias("nth"))
    same = table["doc_id"].eqNullSafe(found["doc_id"]) & (table["text_sha256"] == found["text_sha256"])
    return table.join(found, same, "left").select(table["doc_id"], table["text_sha256"], "recipe", F.coalesce("nth", F.array().cast("array<int>")).alias("nth"))


def exact_dedup(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. Of equal texts the largest doc_id stays."""
    table = recipes(docs, **how)
    groups = table.groupBy(F.col("recipe").alias("r"), F.col("nth").alias("k")).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    # Recipes of one document don't travel again; AQE splits a large group in this join.
    out = table.join(groups, (table["recipe"] == groups["r"]) & (table["nth"] == groups["k"]), "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """The documents that stay, with all their columns."""
    id_, sha_ = fresh(docs, "id", "sha")
    kept = exact_dedup(docs, **how).where("kept").select(F.col("doc_id").alias(f"{id_}2"), F.col("text_sha256").alias(f"{sha_}2"))
    own = docs.withColumns({id_: F.col("doc_id").cast("long"), sha_: F.sha2(ascii_lower(text_of()), 256)})
    found = own.join(kept, F.col(id_).eqNullSafe(F.col(f"{id_}2")) & (F.col(sha_) == F.col(f"{sha_}2")), "left_semi")
    return found.dropDuplicates([id_, sha_]).select(*docs.columns)
