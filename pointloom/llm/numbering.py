"""Consecutive numbers in a sort order, without a window over a whole table.

Rows are dealt out by ranges of the whole sort key and numbered within each range;
a range's rows are counted and the counts of the ranges before it are added. The
ranges are written first, so that a lost executor can't draw other borders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, small_side, written


def numbered(df: DataFrame, group: list[str], order: list[str], number: str = "i", size: str = "n") -> DataFrame:
    """df with each row's number within its group (from 0, in ascending order, nulls first) and the group's rows.

    df should be narrow: it is written once. A group may hold any share of the rows. Rows equal in group and order
    are numbered in any order.
    """
    range_, at_, first_ = fresh(df, "range", "at", "first")
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    ranged = written(df.repartitionByRange(*keys).withColumn(range_, F.spark_partition_id()), "ranges")
    within = [range_, *group]
    counts = ranged.groupBy(*within).agg(F.count(F.lit(1)).alias(size))
    # A group has a row for each range here, not for each of its rows.
    before = Window.partitionBy(*[F.col(c) for c in group] or [F.lit(0)])
    running = before.orderBy(range_).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(first_, F.coalesce(F.sum(size).over(running), F.lit(0))).withColumn(size, F.sum(size).over(before))
    counts = written(counts, "counts").withColumnsRenamed({c: f"{first_}_{c}" for c in within})
    rows = ranged.withColumn(at_, F.row_number().over(Window.partitionBy(*within).orderBy(*[F.col(c).asc_nulls_first() for c in order])))
    same = [F.col(c).eqNullSafe(F.col(f"{first_}_{c}")) for c in within]
    on = same[0]
    for c in same[1:]:
        on = on & c
    joined = rows.join(small_side(counts), on)
    return joined.select(*df.columns, (F.col(first_) + F.col(at_) - 1).cast("long").alias(number), F.col(size).cast("long").alias(size))
