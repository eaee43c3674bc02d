"""Filters, statistics and cleanup of a splat table (gid, x, y, z, opacity, scale_*, ...)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import logit, rgb_to_sh, sigmoid, to_log_scale

AXES, SCALES = ("x", "y", "z"), ("scale_0", "scale_1", "scale_2")
DELETED_OPACITY, DELETED_BELOW, MAX_REST = -100.0, -50.0, 45
#: Rows of a column that an exact percentile is taken from at once.
BRACKET_ROWS = 100_000


def active(df: DataFrame, exclude_deleted: bool) -> Column:
    return ~F.col("deleted") if exclude_deleted and "deleted" in df.columns else F.lit(True)


def in_box(low: tuple[float, ...], high: tuple[float, ...]) -> Column:
    """Bounds inclusive; plain comparisons, so they reach the Parquet scan."""
    c = F.lit(True)
    for a, lo, hi in zip(AXES, low, high, strict=True):
        c = c & F.col(a).between(lo, hi)
    return c


def in_sphere(center: tuple[float, ...], radius: float) -> Column:
    """A box that the scan can use, then the exact distance."""
    d2 = sum((F.col(a) - c) * (F.col(a) - c) for a, c in zip(AXES, center, strict=True))
    return in_box(tuple(c - radius for c in center), tuple(c + radius for c in center)) & (d2 <= radius * radius)


def query_box(df: DataFrame, low: tuple[float, ...], high: tuple[float, ...], exclude_deleted: bool = True) -> DataFrame:
    return df.where(in_box(low, high) & active(df, exclude_deleted))


def query_sphere(df: DataFrame, center: tuple[float, ...], radius: float, exclude_deleted: bool = True) -> DataFrame:
    return df.where(in_sphere(center, radius) & active(df, exclude_deleted))


query_radius = query_sphere


def delete_region(df: DataFrame, region: Column, outside: bool = False) -> DataFrame:
    """Marks the active rows inside (or outside) of a region as deleted."""
    hit = ~region if outside else region
    return df.withColumn("deleted", F.col("deleted") | hit)


def mark_deleted(df: DataFrame) -> DataFrame:
    """The deletion flag of a loaded scene: an opacity of -50 or less."""
    return df.withColumn("deleted", F.col("opacity") <= DELETED_BELOW)


def probability(df: DataFrame, space: str = "auto") -> DataFrame:
    """Adds p, the opacity as a probability. "auto": logits if any absolute value is above 1.5 (one row broadcast)."""
    if space == "logit":
        return df.withColumn("p", sigmoid(F.col("opacity")))
    if space == "prob":
        return df.withColumn("p", F.col("opacity"))
    top = F.broadcast(df.agg(F.max(F.abs("opacity")).alias("_top")))
    return df.crossJoin(top).withColumn("p", F.when(F.col("_top") > 1.5, sigmoid(F.col("opacity"))).otherwise(F.col("opacity"))).drop("_top")


def prune(df: DataFrame, threshold: float = 0.005, max_rows: int | None = None, space: str = "auto") -> DataFrame:
    """Rows with a probability above the threshold; of them the max_rows most opaque (ties: lowest gid)."""
    if "opacity" not in df.columns:
        return df
    kept = probability(df, space).where(F.col("p") > threshold)
    return (top_opacity(kept, max_rows) if max_rows else kept).drop("p")


def top_opacity(df: DataFrame, n: int) -> DataFrame:
    """The n most opaque rows: a top-k per partition, then of those."""
    return df.orderBy(F.desc("opacity"), "gid").limit(n)


def prune_counts(df: DataFrame, threshold: float = 0.005, space: str = "auto") -> DataFrame:
    return probability(df, space).agg(F.count(F.lit(1)).alias("n_before"), F.count_if(F.col("p") > threshold).alias("n_after"), F.count_if(~(F.col("p") > threshold)).alias("n_pruned"))


def trim_rest(df: DataFrame, most: int = MAX_REST) -> DataFrame:
    """Drops colour coefficients f_rest_i with i >= 45."""
    return df.select(*[c for c in df.columns if not (c.startswith("f_rest_") and int(c[7:]) >= most)])


def bounds(df: DataFrame) -> DataFrame:
    out = [f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))]
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if("deleted").alias("n_deleted"), *out)


def _between(c: str, lo: float | None, hi: float | None) -> Column:
    """The column's value where it lies in the bracket, else null."""
    return F.col(c) if lo is None else F.when((F.col(c) >= F.lit(lo)) & (F.col(c) <= F.lit(hi)), F.col(c))


def brackets(df: DataFrame, columns: tuple[str, ...], shares: tuple[float, ...], most: int = BRACKET_ROWS, accuracy: int = 10_000) -> dict[tuple[str, float], tuple]:
    """(column, share) → (lo, hi, p): the percentile of the whole column is the percentile p of its values within [lo, hi].

    Approximate percentiles enclose the rank, and counts prove it; brackets are narrowed until they hold at
    most that many rows or one value. lo is None where the whole column is small enough. The driver gets some numbers a round.
    """
    total = dict(zip(columns, df.agg(*[F.count(c) for c in columns]).first(), strict=True))
    found = {(c, q): (None, None, 0, total[c]) for c in columns for q in shares}
    margin = dict.fromkeys(found, 2 / accuracy)
    rank = {(c, q): q * max(total[c] - 1, 0) for c, q in found}
    last: set[tuple[str, float]] = set()
    while True:
        wide = [key for key, (lo, hi, _, n) in found.items() if n > most and (lo is None or lo < hi) and key not in last]
        if not wide:
            break
        around = []
        for key in wide:
            lo, hi, below, n = found[key]
            p, m = (rank[key] - below) / (n - 1), margin[key]
            around.append(F.percentile_approx(_between(key[0], lo, hi), [max(p - m, 0.0), min(p + m, 1.0)], accuracy))
        ends = df.agg(*around).first()
        counts = df.agg(*[x for (c, _), (lo, hi) in zip(wide, ends, strict=True) for x in (F.count_if(F.col(c) < F.lit(lo)), F.count(_between(c, lo, hi)))]).first()
        for i, key in enumerate(wide):
            below, n = counts[2 * i], counts[2 * i + 1]
            encloses = below <= math.floor(rank[key]) and math.ceil(rank[key]) < below + n
            if encloses and n < found[key][3]:
                found[key] = (*ends[i], below, n)
            elif encloses or margin[key] >= 1:
                last.add(key)  # no narrower one: its ends are values of many rows
            else:
                margin[key] *= 8
    return {key: (lo, hi, min(max((rank[key] - below) / (n - 1), 0.0), 1.0) if n > 1 else 0.5) for key, (lo, hi, below, n) in found.items()}


def median_of(df: DataFrame, column: str) -> Column:
    """The exact median of a column of df, as an aggregate: taken within a bracket of some rows, not of the whole column."""
    lo, hi, p = brackets(df, (column,), (0.5,))[column, 0.5]
    return F.percentile(_between(column, lo, hi), F.lit(p))


def robust_bounds(df: DataFrame, margin: float = 0.5, low: float = 0.02, high: float = 0.98, exact: bool = True, most: int = BRACKET_ROWS) -> DataFrame:
    """Percentiles per axis, widened by a margin. Exact ones are taken within brackets of at most about `most` rows;
    exact=False: approximate ones in one pass."""
    ends = [(n, a, q, sign) for a in AXES for n, q, sign in (("low", low, -1), ("high", high, 1))]
    if exact:
        at = brackets(df, AXES, (low, high), most)
        f = lambda a, q: F.percentile(_between(a, *at[a, q][:2]), F.lit(at[a, q][2]))
    else:
        f = lambda a, q: F.percentile_approx(a, F.lit(q), F.lit(10000))
    return df.agg(*[(f(a, q) + sign * margin).alias(f"{n}_{a}") for n, a, q, sign in ends])


def statistics(df: DataFrame, exclude_deleted: bool = False) -> DataFrame:
    """Quality statistics of a scene: two passes, the moments of the first broadcast to the second."""
    df = df.where(active(df, exclude_deleted))
    p = df.withColumn("_p", sigmoid(F.col("opacity")))
    moments = [f(a).alias(f"{k}_{a}") for a in AXES for k, f in (("m", F.avg), ("s", F.stddev_pop), ("lo", F.min), ("hi", F.max))]
    one = p.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("_p") > 0.1).alias("n_effective"),
        F.avg((F.col("_p") < 0.05).cast("double")).alias("transparent"),
        F.avg((F.col("_p") > 0.95).cast("double")).alias("opaque"),
        F.avg("_p").alias("opacity_mean"),
        F.stddev_pop("_p").alias("opacity_std"),
        *moments,
    )
    long = df.select(F.explode(F.array(*SCALES)).alias("s")).agg(F.avg("s").alias("scale_mean"), F.stddev_pop("s").alias("scale_std"), F.min("s").alias("scale_min"), F.max("s").alias("scale_max"))
    first = F.broadcast(one)
    out = F.lit(False)
    for a in AXES:
        out = out | (F.abs(F.col(a) - F.col(f"m_{a}")) > 3.0 * F.col(f"s_{a}"))
    share = df.crossJoin(first).agg(F.avg(out.cast("double")).alias("outliers"))
    volume = (F.col("hi_x") - F.col("lo_x")) * (F.col("hi_y") - F.col("lo_y")) * (F.col("hi_z") - F.col("lo_z"))
    keep = ["n", "n_effective", "transparent", "opaque", "opacity_mean", "opacity_std"]
    return one.select(*keep, volume.alias("volume"), F.when(volume > 0, F.col("n") / volume).otherwise(0.0).alias("density")).crossJoin(F.broadcast(long)).crossJoin(F.broadcast(share))


def sampled_centroid(df: DataFrame, most: int = 2000) -> DataFrame:
    """Centroid and bounding radius over every (n // most)-th row by gid; gid counts from 0."""
    n = df.count()
    part = df.where(F.col("gid") % max(1, n // most) == 0)
    center = part.agg(*[F.avg(a).alias(f"c{a}") for a in AXES])
    d2 = sum((F.col(a) - F.col(f"c{a}")) * (F.col(a) - F.col(f"c{a}")) for a in AXES)
    return part.crossJoin(F.broadcast(center)).groupBy("cx", "cy", "cz").agg(F.sqrt(F.max(d2)).alias("radius"))


def to_splat_schema(df: DataFrame) -> DataFrame:
    """Model output to splat columns: missing attributes defaulted, colour, opacity and scales in their stored spaces."""
    get = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in df.columns else F.lit(d)
    cols = [F.col(c) for c in ("gid", *AXES)]
    cols += [rgb_to_sh(get(c, 0.5)).alias(f"f_dc_{i}") for i, c in enumerate(("r", "g", "b"))]
    cols += [logit(get("alpha", 0.8)).alias("opacity")]
    cols += [to_log_scale(get(f"size_{i}", 0.01)).alias(f"scale_{i}") for i in range(3)]
    cols += [get(f"rot_{i}", 1.0 if i == 0 else 0.0).alias(f"rot_{i}") for i in range(4)]
    return df.select(*cols)


def clean_outliers(df: DataFrame, sigmas: float = 3.0, least: int = 100) -> DataFrame:
    """Rows within mean + 3σ on each scale axis (one-sided; only if more than `least` rows are there)."""
    m = F.broadcast(df.agg(F.count(F.lit(1)).alias("_n"), *[f(s).alias(f"{k}_{s}") for s in SCALES for k, f in (("_m", F.avg), ("_s", F.stddev_pop))]))
    out = F.lit(False)
    for s in SCALES:
        out = out | (F.col(s) > F.col(f"_m_{s}") + sigmas * F.col(f"_s_{s}"))
    return df.crossJoin(m).where(~out | (F.col("_n") <= least)).select(*df.columns)


def distribution_metrics(df: DataFrame) -> DataFrame:
    """Mean binary entropy of opacity, mean scale, mean smallest scale."""
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), sigmoid(F.col("opacity"))))
    mean_scale = sum(F.avg(F.exp(s)) for s in SCALES) / 3.0
    return df.agg(F.avg(-(p * F.ln(p) + (1.0 - p) * F.ln(1.0 - p))).alias("opacity_entropy"), mean_scale.alias("mean_scale"), F.avg(F.exp(F.least(*SCALES))).alias("mean_flatness"))


def repeatable_sample(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, the same for a given seed whatever the partitioning: the least by a digest of seed and gid."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("gid").cast("string"))), "gid").limit(n)
