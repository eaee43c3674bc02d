"""Edit log with undo and redo, and versioned snapshots."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.layout import write_scene
from .scene import AXES

MOST_EDITS, MOST_SNAPSHOTS = 50, 10


def recorded(df: DataFrame, edit_id: int, label: str, attr: str, new: Column, chosen: Column) -> DataFrame:
    """The rows (edit_id, label, gid, attr, old, new) of an edit; they are appended to the log and never changed."""
    return df.where(chosen).select(F.lit(edit_id).alias("edit_id"), F.lit(label).alias("label"), "gid", F.lit(attr).alias("attr"), F.col(attr).cast("double").alias("old"), new.cast("double").alias("new"))


def state(base: DataFrame, log: DataFrame, active: list[int]) -> DataFrame:
    """base with the active edits applied: per row and attribute the last one counts. active holds at most 50 ids."""
    attrs = [c for c, t in base.dtypes if c != "gid" and t in ("double", "float")]
    last = log.where(F.col("edit_id").isin(active)).groupBy("gid").pivot("attr", attrs).agg(F.max_by("new", "edit_id"))
    last = last.select("gid", *[F.col(a).alias(f"_{a}") for a in attrs])
    types = dict(base.dtypes)
    return base.join(last, "gid", "left").select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).cast(types[c]).alias(c) if c in attrs else F.col(c) for c in base.columns])


def history(log: DataFrame, active: list[int]) -> DataFrame:
    return log.where(F.col("edit_id").isin(active)).groupBy("edit_id", "label").agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class Cursor:
    """Which edits are active and which can be done again. A new edit clears the latter; at most 50 can be undone."""

    active: list[int] = field(default_factory=list)
    redo: list[int] = field(default_factory=list)
    fixed: int = 0  # so many of the first edits can't be undone any more

    def did(self, edit_id: int) -> Cursor:
        active = [*self.active, edit_id]
        return Cursor(active, [], max(self.fixed, len(active) - MOST_EDITS))

    def undone(self) -> Cursor:
        if len(self.active) <= self.fixed:
            return self
        return Cursor(self.active[:-1], [*self.redo, self.active[-1]], self.fixed)

    def redone(self) -> Cursor:
        return Cursor([*self.active, self.redo[-1]], self.redo[:-1], self.fixed) if self.redo else self


class Snapshots:
    """Versions of a scene as Parquet folders under a path, with a table of them. Scenes with positions are laid out for spatial queries."""

    SCHEMA = "id long, label string, path string, live boolean"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _index(self) -> DataFrame:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/index")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], self.SCHEMA)
        newest = Window.partitionBy("id").orderBy("live")  # a later row with live = false ends a snapshot
        rows = self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/index")
        return rows.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")

    def _note(self, id_: int, label: str, path: str, live: bool) -> None:
        self.spark.createDataFrame([(id_, label, path, live)], self.SCHEMA).write.mode("append").parquet(f"{self.path}/index")

    def save(self, df: DataFrame, label: str) -> int:
        id_ = (self._index().agg(F.max("id")).first()[0] or 0) + 1
        where = f"{self.path}/{id_}-{uuid.uuid4().hex}"
        if set(AXES) <= set(df.columns):
            write_scene(df, where)
        else:
            df.write.parquet(where)
        self._note(id_, label, where, True)
        return id_

    def list(self) -> DataFrame:
        """Newest first."""
        return self._index().where("live").select("id", "label").orderBy(F.desc("id"))

    def restore(self, id_: int) -> DataFrame:
        """The snapshot's rows; it is taken off the list."""
        r = self._index().where((F.col("id") == id_) & F.col("live")).first()
        if r is None:
            raise KeyError(id_)
        self._note(id_, r["label"], r["path"], False)
        return self.spark.read.parquet(r["path"])

    def original(self) -> DataFrame:
        """The first snapshot, whether on the list or not."""
        r = self._index().orderBy("id").first()
        if r is None:
            raise KeyError("no snapshot")
        return self.spark.read.parquet(r["path"])

    def expired(self, keep: int = MOST_SNAPSHOTS) -> DataFrame:
        """The snapshots beyond the newest `keep`."""
        return retention(self._index().where("live").withColumn("project_id", F.lit(0)), keep)


def retention(snapshots: DataFrame, keep: int = MOST_SNAPSHOTS) -> DataFrame:
    """Per project, the snapshots beyond the newest `keep`."""
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("id")))
    return snapshots.withColumn("_r", rank).where(F.col("_r") > keep).drop("_r")
