"""Masks as run lengths: what they cover per image row, and an interval join of places with them.

A mask's pixels of one image row are few runs (u0 to u1, inclusive), however large the mask.
For the join, the runs of all masks of an image row become one sorted list of segments in
which no mask begins or ends; a place finds its segment by binary search.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def mask_runs(masks: DataFrame) -> DataFrame:
    """(pos, mask_id, v, u0, u1) of mask pixels (pos, mask_id, u, v); a pixel may come more than once."""
    row = Window.partitionBy("pos", "mask_id", "v").orderBy("u")
    pixels = masks.select("pos", "mask_id", "v", "u").distinct()
    island = pixels.withColumn("_i", F.col("u") - F.row_number().over(row))
    return island.groupBy("pos", "mask_id", "v", "_i").agg(F.min("u").alias("u0"), F.max("u").alias("u1")).drop("_i")


def run_boxes(runs: DataFrame) -> DataFrame:
    """(pos, mask_id, area, x, y, w, h), from runs alone."""
    area, box = F.sum(F.col("u1") - F.col("u0") + 1), (F.min("u0").alias("x"), F.min("v").alias("y"))
    ends = ((F.max("u1") - F.min("u0") + 1).alias("w"), (F.max("v") - F.min("v") + 1).alias("h"))
    return runs.groupBy("pos", "mask_id").agg(area.cast("long").alias("area"), *box, *ends)


def row_lists(runs: DataFrame) -> DataFrame:
    """(pos, v, starts, masks): per image row the ascending starts of its segments, and the masks of each (none in gaps)."""
    rows = runs.groupBy("pos", "v").agg(F.collect_list(F.struct("u0", "u1", "mask_id")).alias("m"))
    edges = F.concat(F.transform("m", lambda r: r["u0"]), F.transform("m", lambda r: r["u1"] + 1))
    rows = rows.withColumn("starts", F.array_sort(F.array_distinct(edges)))
    held = lambda u: F.filter("m", lambda r: (r["u0"] <= u) & (r["u1"] >= u))
    return rows.select("pos", "v", "starts", F.transform("starts", lambda u: F.transform(held(u), lambda r: r["mask_id"])).alias("masks"))


def last_not_above(ascending: Column, value: Column) -> Column:
    """The place (from 0) of the last element that isn't above value, by binary search; -1 if there is none."""
    span = F.struct(F.lit(-1).alias("lo"), F.size(ascending).alias("hi"))  # lo isn't above, hi is

    def halved(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        fits = F.get(ascending, mid) <= value
        ended = s["hi"] - s["lo"] <= 1
        lo = F.when(~ended & fits, mid).otherwise(s["lo"])
        return F.struct(lo.alias("lo"), F.when(~ended & ~fits, mid).otherwise(s["hi"]).alias("hi"))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(ascending) + 2)).cast("int") + 1)
    return F.aggregate(steps, span, halved, lambda s: s["lo"])


def run_hits(seen: DataFrame, lists: DataFrame, width: int, height: int) -> DataFrame:
    """Projected rows (pos, u, v, ...) with the masks they fall into: a join on the image row, then a search in its list."""
    at = seen.withColumns({"ui": F.least(F.floor("u"), F.lit(width - 1)).cast("int"), "vi": F.least(F.floor("v"), F.lit(height - 1)).cast("int")})
    met = at.join(lists.withColumnRenamed("v", "vi"), ["pos", "vi"])
    met = met.withColumn("_at", last_not_above(F.col("starts"), F.col("ui"))).where("_at >= 0")
    return met.withColumn("mask_id", F.explode(F.get("masks", F.col("_at")))).drop("starts", "masks", "_at")
