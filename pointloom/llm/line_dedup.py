r"""Line deduplication across documents (native).

Lines are exploded and hashed after normalisation (strip [\x20\x09-\x0D], lower
A-Z), documents are counted per hash by their smallest and largest id, and lines
over the threshold are dropped and the rest put together again by position. Only
hashes (128 bits), ids and positions are shuffled for the counting; a text moves
once, for the reassembly.

Results in special cases: a null or empty text is one empty line and keeps it; a
null doc_id counts as one document after all others; rows repeated with the same
doc_id are one document for the counting and keep a row each; an empty table
gives no rows; a very long text is an array of lines in one row, and moves once; the name
of the text column may be in any case, and further columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, fresh, text_of, written

MIN_CHARS = 10
_LAST = (1 << 63) - 1


def _hashed(lines: Column, min_chars: int) -> Column:
    """Per line the 128-bit hash of its key, or null for keys that are too short."""
    keys = F.transform(F.transform(lines, lambda x: F.btrim(x, F.lit(SPACE))), ascii_lower)
    return F.transform(keys, lambda k: F.when(F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit("second"), k).alias("b"))))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with text replaced, and n_lines, n_dropped (long) added.

    A line whose key has at least min_chars code points and is found in two
    documents or more stays only in the smallest doc_id that holds it.
    """
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    lines = F.split(text_of(), "\n", -1)
    base = docs.select(own.alias("_id"), F.xxhash64(text_of()).alias("_row"), _hashed(lines, min_chars).alias("_h"))
    keys = base.select("_id", F.explode(F.array_distinct("_h")).alias("k")).where("k is not null")
    # Found in two documents or more: the smallest and the largest id differ.
    shared = keys.groupBy(F.col("k.a").alias("a"), F.col("k.b").alias("b")).agg(F.min("_id").alias("first"), F.max("_id").alias("last")).where("first < last").drop("last")
    # Written, so that both sides of the next join are plain shuffles and AQE can split a frequent line.
    shared = written(shared, "lines")
    at = base.select("_id", "_row", F.posexplode("_h").alias("pos", "k")).where("k is not null").select("_id", "_row", "pos", "k.a", "k.b")
    dropped = at.join(shared, ["a", "b"]).where("_id > first").groupBy("_id", "_row").agg(F.sort_array(F.collect_set("pos")).alias("_gone")).select(F.col("_id").alias("_id2"), F.col("_row").alias("_row2"), "_gone")
    id_, row_, gone_, lines_, ends_ = fresh(docs, "id", "row", "gone", "lines", "ends")
    dropped = dropped.withColumnRenamed("_gone", gone_)
    same = (F.col(id_) == F.col(f"{id_}2")) & (F.col(row_) == F.col(f"{row_}2"))
    joined = docs.withColumns({id_: own, row_: F.xxhash64(text_of())}).join(dropped.withColumnsRenamed({"_id2": f"{id_}2", "_row2": f"{row_}2"}), same, "left")
    # The lines between the dropped positions, as slices: linear in the number of lines.
    n, gone = F.size(lines), F.coalesce(gone_, F.array().cast("array<int>"))
    joined = joined.withColumns({lines_: lines, ends_: F.concat(F.array(F.lit(-1)), gone, F.array(n))})
    between = F.transform(F.sequence(F.lit(1), F.size(ends_) - 1), lambda i: F.slice(lines_, F.col(ends_)[i - 1] + 2, F.col(ends_)[i] - F.col(ends_)[i - 1] - 1))
    kept = F.when(F.col(gone_).isNull(), text_of()).otherwise(F.array_join(F.flatten(between), "\n"))
    counts = [F.size(lines_).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped")]
    return joined.select(*[kept.alias(c) if c.lower() == "text" else F.col(c) for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")], *counts)
