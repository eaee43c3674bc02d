"""Scenes as Parquet in the order of a Morton key, so that box and sphere queries skip what they don't need.

write_scene deals the rows out by ranges of the key, sorts them and writes small row groups:
the rows of a page, a row group and a file are near each other, and their least and greatest
coordinates are tight. Beside the files stands a table of each file's bounds; a query opens
only the files that its box meets, and the Parquet reader skips row groups and pages in them.

The key's range is that of the middle rows; rows outside are in its outermost cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.morton import morton
from ..operators.scene import AXES, active, in_box, in_sphere

#: Rows of a file, bytes of a row group and rows of a page.
FILE_ROWS, GROUP_BYTES, PAGE_ROWS = 1_000_000, 4 << 20, 5_000
BOUNDS = "_bounds"  # Spark's readers pass over names with an underscore


def key_of(df: DataFrame) -> tuple[int, Column]:
    """The number of rows, and their Morton key between the percentiles 1 and 99, widened by half their distance. One pass."""
    n, *mids = df.agg(F.count(F.lit(1)), *[F.percentile_approx(a, [0.01, 0.99], 1000) for a in AXES]).first()
    ends = [(lo - (hi - lo) / 2, hi + (hi - lo) / 2) for lo, hi in (m or (0.0, 0.0) for m in mids)]
    return n, morton(AXES, tuple(e[0] for e in ends), tuple(e[1] for e in ends))


def write_scene(df: DataFrame, path: str, file_rows: int = FILE_ROWS, group_bytes: int = GROUP_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Writes df (x, y, z and any other columns) to a new folder. Rows of one place may be in several files."""
    n, key = key_of(df)
    order = ["_key", *(["gid"] if "gid" in df.columns else [])]
    placed = df.withColumn("_key", key).repartitionByRange(max(-(-n // file_rows), 1), *order).sortWithinPartitions(*order)
    options = {"parquet.block.size": group_bytes, "parquet.page.row.count.limit": page_rows}
    placed.drop("_key").write.options(**options).parquet(path)
    spark = df.sparkSession
    ends = [f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))]
    files = spark.read.schema(df.schema).parquet(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n"), *ends)
    files.coalesce(1).write.parquet(f"{path}/{BOUNDS}")  # a row a file


class Scene:
    """A folder that write_scene has written. Without its table of bounds all files are opened."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{BOUNDS}")
        known = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
        self.bounds = spark.read.parquet(f"{self.path}/{BOUNDS}") if known else None
        self.schema = spark.read.parquet(self.path).schema

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def _near(self, low: tuple[float, ...], high: tuple[float, ...]) -> DataFrame:
        """The rows of the files that a box meets."""
        if self.bounds is None:
            return self.rows()
        meets = F.lit(True)
        for a, lo, hi in zip(AXES, low, high, strict=True):
            meets = meets & (F.col(f"max_{a}") >= lo) & (F.col(f"min_{a}") <= hi)
        files = [f"{self.path}/{r['file']}" for r in self.bounds.where(meets).select("file").collect()]
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*files)

    def box(self, low: tuple[float, ...], high: tuple[float, ...], exclude_deleted: bool = True) -> DataFrame:
        """The rows in a box, bounds inclusive."""
        df = self._near(low, high)
        return df.where(in_box(low, high) & active(df, exclude_deleted))

    def sphere(self, center: tuple[float, ...], radius: float, exclude_deleted: bool = True) -> DataFrame:
        """The rows no farther from center than radius."""
        df = self._near(tuple(c - radius for c in center), tuple(c + radius for c in center))
        return df.where(in_sphere(center, radius) & active(df, exclude_deleted))
