"""A keyed table that micro-batches are merged into.

Rows lie in buckets of their key's hash, each version of a bucket in the folder of the batch
that wrote it; each batch's index file says which batch last wrote each bucket. A merge reads
and writes the buckets that have changed keys, and no other. It is idempotent by batch id: a
batch that is tried again starts from the index before it and writes the same folder again.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: More for a table of which a batch changes few keys: a batch writes whole buckets.
BUCKETS = 16


class UpsertTable:
    """Rows (of a schema) of which each key has one. Keys may be null."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self, before: int | None = None) -> dict[int, int]:
        """The batch that last wrote each bucket, of the batches before one: at most a number a bucket."""
        fs, at = self._at("index")
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        batches = [int(n) for n in names if n.isdigit() and (before is None or int(n) < before)]
        if not batches:
            return {}
        stream = fs.open(self._at(f"index/{max(batches)}")[1])
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(b): n for b, n in json.loads(text).items()}

    def _note(self, batch: int, versions: dict[int, int]) -> None:
        """The batch counts from here on. The file is written beside and renamed, so it is there whole or not at all."""
        fs, part = self._at(f"index/_{batch}")
        stream = fs.create(part, True)
        stream.write(bytearray(json.dumps(versions).encode()))
        stream.close()
        at = self._at(f"index/{batch}")[1]
        fs.delete(at, False)
        fs.rename(part, at)

    def _read(self, at: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/batch={batch}/bucket={bucket}" for bucket, batch in sorted(at.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def merge(self, updates: DataFrame, batch: int) -> None:
        """Puts the rows of updates, of which each key has one, in place of those with their keys."""
        new = updates.select(*self.schema.fieldNames()).withColumn("bucket", self._bucket()).persist()
        try:
            changed = [r[0] for r in new.select("bucket").distinct().collect()]
            known = self.versions(before=batch)
            old = self._read({b: known[b] for b in changed if b in known})
            same = [old[k].eqNullSafe(new[k]) for k in self.keys]
            on = same[0]
            for c in same[1:]:
                on = on & c
            kept = old.join(new, on, "left_anti").withColumn("bucket", self._bucket())
            tasks = min(len(changed), int(self.spark.conf.get("spark.sql.shuffle.partitions")))
            rows = kept.unionByName(new).repartition(max(tasks, 1), "bucket")
            rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={batch}")
        finally:
            new.unpersist()
        self._note(batch, known | dict.fromkeys(changed, batch))

    def rows(self) -> DataFrame:
        return self._read(self.versions())
