"""Scratch tables in the folder that all executors see."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a local session gets one of its own; on a cluster that is an error."""
    sc = spark.sparkContext
    checkpoints = sc._jsc.sc().getCheckpointDir()
    found = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found and checkpoints.isDefined():
        found = checkpoints.get()
    if not found:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        found = f"/tmp/checkpoints/pointloom-{uuid.uuid4().hex}"
    if not checkpoints.isDefined():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Bytes of a row group for rows that are large each: what a task holds while it writes or reads them.
WIDE = 8 << 20


def written(df: DataFrame, name: str = "scratch", wide: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: computed once, cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    (df.write.option("parquet.block.size", WIDE) if wide else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
