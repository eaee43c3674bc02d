"""Shared pieces: scratch tables, text normalisation, size-checked broadcast."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch_path, shared_dir, written

#: The characters that the contracts call space.
SPACE = "\t\n\x0b\x0c\r "
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Letters other than A-Z that lower() would change.
_OTHER_UPPER = r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"
#: Rows that may be broadcast: at 16 bytes a row, 32 MB.
BROADCAST_ROWS = 2_000_000


@contextmanager
def batches_of(spark: SparkSession, rows: int, size: str = "64m") -> Iterator[None]:
    """What is run inside reads and sends at most so many rows at once, and about that size to Python: for rows that are large each."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size, "spark.sql.parquet.columnarReaderBatchSize": str(min(rows, 4096))}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder, for small tables within loops."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small_side(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if df (a written table of narrow rows) has at most limit rows, else df: then the join shuffles."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that df has no column of, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else changed.

    lower() is fast and does the same unless other upper-case letters are there;
    only then the slower translate() is used.
    """
    return F.when(c.rlike(_OTHER_UPPER), F.translate(c, UPPER, LOWER)).otherwise(F.lower(c))


def text_of(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold_of(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 5. Rows of fold 0 are held out; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))
