"""Segments: membership, merge, split, edits by segment, labels, index map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import applied, composed, palette, rotation_matrix, rotation_quaternion
from .camera import small
from .scene import AXES, SCALES


def segment_stats(df: DataFrame, segments: DataFrame) -> DataFrame:
    """Count, centroid and box per segment; zeros for an empty one."""
    aggs = [F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(f"c{a}") for a in AXES], *[f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))]]
    g = df.groupBy("segment_id").agg(*aggs)
    return segments.select("segment_id").join(g, "segment_id", "left").select("segment_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in g.columns if c != "segment_id"])


def members_of(df: DataFrame, members: DataFrame, segment_id: int) -> DataFrame:
    return df.join(members.where(F.col("segment_id") == segment_id).select("gid"), "gid", "left_semi")


def background(df: DataFrame, members: DataFrame, segment_id: int) -> DataFrame:
    """(segment_id, gid) of the rows that are in no segment."""
    return df.select("gid").join(members.select("gid"), "gid", "left_anti").select(F.lit(segment_id).alias("segment_id"), "gid")


def next_id(segments: DataFrame) -> Column:
    return F.coalesce(F.max("segment_id"), F.lit(-1)) + 1


def merge(segments: DataFrame, members: DataFrame, ids: list[int], distinct: bool = False) -> tuple[DataFrame, DataFrame]:
    """(segments, members) with those ids as one segment; its id is the largest remaining one plus 1. Unknown ids are ignored."""
    if len(ids) < 2:
        raise ValueError("a merge takes two segments or more")
    rest, old = segments.where(~F.col("segment_id").isin(ids)), segments.where(F.col("segment_id").isin(ids))
    new = F.broadcast(rest.agg(next_id(rest).alias("_new")))  # one row
    area = old.agg(F.sum("area").alias("area"), F.min_by("label", "pos").alias("label"), F.min("pos").alias("pos"), F.bool_or("visible").alias("visible")).where("area is not null")
    one = area.crossJoin(new).select(F.col("_new").alias("segment_id"), "pos", "label", "area", "visible")
    joined = members.crossJoin(new).withColumn("segment_id", F.when(F.col("segment_id").isin(ids), F.col("_new")).otherwise(F.col("segment_id"))).drop("_new")
    return rest.select("segment_id", "pos", "label", "area", "visible").unionByName(one), joined.distinct() if distinct else joined


def split(df: DataFrame, members: DataFrame, segment_id: int, k: int, seed: int = 0) -> DataFrame:
    """(segment_id, gid): the segment's rows in up to k clusters with new ids; other members as they are."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    own = VectorAssembler(inputCols=list(AXES), outputCol="_v").transform(members_of(df, members, segment_id).select("gid", *AXES))
    found = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_c").fit(own).transform(own).select("gid", "_c")
    rest = members.where(F.col("segment_id") != segment_id)
    names = found.select("_c").distinct().select("_c", (F.row_number().over(Window.orderBy("_c")) - 1).alias("_n"))  # at most k rows
    first = F.broadcast(rest.agg(next_id(rest).alias("_new")))
    new = found.join(F.broadcast(names), "_c").crossJoin(first).select((F.col("_new") + F.col("_n")).cast(members.schema["segment_id"].dataType).alias("segment_id"), "gid")
    return rest.select("segment_id", "gid").unionByName(new)


def duplicate(df: DataFrame, chosen: Column, offset: tuple[float, float, float] = (0.5, 0.0, 0.0)) -> DataFrame:
    """df and shifted copies of the chosen rows with new gids after the largest.

    New gids count up within each partition from the rows of the partitions before.
    """
    sel = df.where(chosen).withColumn("_m", F.monotonically_increasing_id())
    sel = sel.withColumn("_p", F.shiftright("_m", 33))
    sizes = sel.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    base = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_base"))  # a row per partition
    top = F.broadcast(df.agg(F.max("gid").alias("_top")))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("gid"))
    moved = {a: F.col(a) + o for a, o in zip(AXES, offset, strict=True)}
    new = sel.withColumn("_r", rank).join(base, "_p").crossJoin(top).withColumns(moved).withColumn("gid", F.col("_top") + F.col("_base") + F.col("_r"))
    return df.unionByName(new.select(*df.columns))


def transform(df: DataFrame, chosen: Column, translation=(0.0, 0.0, 0.0), rotation=(0.0, 0.0, 0.0), scale=(1.0, 1.0, 1.0)) -> DataFrame:
    """Rotates the chosen rows about their centroid, then scales, then moves them.

    A rotation about the centroid leaves the centroid where it is, so one aggregate
    serves both steps. A scale of 0 or less mirrors positions and leaves log-scales.
    """
    out = df.withColumn("_on", chosen)
    turned, scaled = any(rotation), tuple(scale) != (1.0, 1.0, 1.0)
    if turned or scaled:
        pivot = F.broadcast(out.where("_on").agg(*[F.avg(a).alias(f"_p{a}") for a in AXES]))
        out = out.crossJoin(pivot)
        d = tuple(F.col(a) - F.col(f"_p{a}") for a in AXES)
        if turned:
            d = tuple(applied(rotation_matrix(rotation), d))
        pos = [c * s + F.col(f"_p{a}") for c, s, a in zip(d, scale, AXES, strict=True)]
    else:
        pos = [F.col(a) for a in AXES]
    new = {a: c + t for a, c, t in zip(AXES, pos, translation, strict=True)}
    if turned and all(f"rot_{i}" in df.columns for i in range(4)):
        new |= {f"rot_{i}": c for i, c in enumerate(composed(rotation_quaternion(rotation), tuple(F.col(f"rot_{i}") for i in range(4))))}
    if scaled:
        import math

        new |= {c: F.col(c) + math.log(s) for c, s in zip(SCALES, scale, strict=True) if s > 0 and c in df.columns}
    return out.withColumns({k: F.when(F.col("_on"), v).otherwise(F.col(k)) for k, v in new.items()}).select(*df.columns)


def batch_transform(df: DataFrame, segment_ids: list[int], **how) -> DataFrame:
    """transform() of several segments about one common pivot."""
    return transform(df, F.col("segment_id").isin(segment_ids), **how)


def flag_deleted(df: DataFrame, ids: DataFrame, deleted: bool = True) -> DataFrame:
    """Soft delete, or its reverse, of the rows in ids (gid)."""
    hit = ids.select("gid").distinct().withColumn("_hit", F.lit(True))
    return df.join(hit, "gid", "left").withColumn("deleted", F.when(F.col("_hit"), F.lit(deleted)).otherwise(F.col("deleted"))).drop("_hit")


def light(df: DataFrame, chosen: Column, brightness: float = 1.0, tint=(1.0, 1.0, 1.0), sh_scale: float = 1.0) -> DataFrame:
    new = {f"f_dc_{i}": F.col(f"f_dc_{i}") * (brightness * t) for i, t in enumerate(tint)}
    if "f_rest" in df.columns:
        new["f_rest"] = F.transform("f_rest", lambda v: (v * sh_scale).cast("float"))
    return df.withColumns({k: F.when(chosen, v).otherwise(F.col(k)) for k, v in new.items()})


def set_attribute(df: DataFrame, attr: str, values: DataFrame) -> DataFrame:
    """Overwrites attr by (gid, value); an attribute that df doesn't have is an error."""
    if attr not in df.columns:
        raise ValueError(f"no attribute {attr}")
    return df.join(values.select("gid", F.col("value").alias("_v")), "gid", "left").withColumn(attr, F.coalesce("_v", attr)).drop("_v")


def effective_opacity(df: DataFrame, members: DataFrame, segments: DataFrame) -> DataFrame:
    """Adds effective_opacity: -100 for rows of a hidden segment; the true opacity is never overwritten."""
    hidden = members.join(segments.where(~F.col("visible")).select("segment_id"), "segment_id", "left_semi").select("gid").distinct().withColumn("_h", F.lit(True))
    return df.join(hidden, "gid", "left").withColumn("effective_opacity", F.when(F.col("_h"), F.lit(-100.0)).otherwise(F.col("opacity"))).drop("_h")


def delete_segment(df: DataFrame, segments: DataFrame, members: DataFrame, segment_id: int) -> tuple[DataFrame, DataFrame]:
    """(scene, segments): rows soft-deleted, manifest entry dropped."""
    return flag_deleted(df, members.where(F.col("segment_id") == segment_id)), segments.where(F.col("segment_id") != segment_id)


def rename(segments: DataFrame, segment_id: int, label: str) -> DataFrame:
    return segments.withColumn("label", F.when(F.col("segment_id") == segment_id, F.lit(label)).otherwise(F.col("label")))


def index_map(df: DataFrame, segments: DataFrame, members: DataFrame) -> DataFrame:
    """(gid, value): position + 1 of the last of the first 255 segments that holds the row, 0 for none."""
    m = members.join(F.broadcast(segments.where("pos < 255").select("segment_id", "pos")), "segment_id").groupBy("gid").agg(F.max(F.col("pos") + 1).alias("v"))
    return df.select("gid").join(m, "gid", "left").select("gid", F.coalesce("v", F.lit(0)).cast("int").alias("value"))


def response(segments: DataFrame, members: DataFrame) -> DataFrame:
    """Manifest rows with defaults per field."""
    n = members.groupBy("segment_id").agg(F.count(F.lit(1)).alias("_n"))
    get = lambda c, d: F.coalesce(F.col(c), d) if c in segments.columns else d
    return segments.join(n, "segment_id", "left").select(
        "segment_id",
        get("label", F.concat(F.lit("object_"), F.col("segment_id").cast("string"))).alias("label"),
        get("color", F.array(F.lit(128), F.lit(128), F.lit(128))).alias("color"),
        get("visible", F.lit(True)).alias("visible"),
        get("n_gaussians", F.coalesce("_n", F.lit(0))).cast("long").alias("n_gaussians"),
    )


def nest(segments: DataFrame, members: DataFrame) -> DataFrame:
    """One row per segment with gaussian_ids as an array, as the JSON manifest has it."""
    ids = members.groupBy("segment_id").agg(F.sort_array(F.collect_list("gid")).alias("gaussian_ids"))
    return segments.join(ids, "segment_id", "left").withColumn("gaussian_ids", F.coalesce("gaussian_ids", F.array().cast("array<bigint>")))


def unnest(manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, members) of nested segments."""
    return manifest.drop("gaussian_ids"), manifest.select("segment_id", F.explode("gaussian_ids").alias("gid"))


def colored(segments: DataFrame) -> DataFrame:
    return segments.withColumn("color", F.array(*palette(F.col("pos"))))


#: The display colour (r, g, b, a) of each state, the first that holds counts.
HIGHLIGHTS = {"deleted": (0, 0, 0, 0), "eraser": (255, 100, 100, 200), "brush": (255, 200, 150, 200), "selected": (200, 255, 220, 255), "hovered": (200, 210, 255, 240), "dimmed": (180, 180, 180, 220)}


def highlight(df: DataFrame, state: DataFrame) -> DataFrame:
    """(gid, rgba) by priority; rows in no state stay white. state: (gid, kind)."""
    kinds = [k for k in HIGHLIGHTS if k != "deleted"]
    flags = state.groupBy("gid").agg(*[F.bool_or(F.col("kind") == k).alias(f"_{k}") for k in kinds])
    rgba = lambda v: F.array(*[F.lit(x) for x in v])
    color = F.when(F.col("deleted"), rgba(HIGHLIGHTS["deleted"]))
    for k in kinds:
        color = color.when(F.col(f"_{k}"), rgba(HIGHLIGHTS[k]))
    return df.join(flags, "gid", "left").select("gid", color.otherwise(rgba((255, 255, 255, 255))).alias("rgba"))


def select_add(current: DataFrame, ids: DataFrame) -> DataFrame:
    return current.select("gid").union(ids.select("gid")).distinct()


def select_remove(current: DataFrame, ids: DataFrame) -> DataFrame:
    return current.select("gid").join(ids.select("gid"), "gid", "left_anti")


def select_toggle(current: DataFrame, ids: DataFrame) -> DataFrame:
    """In one but not in both."""
    both = current.select("gid").distinct().withColumn("_a", F.lit(1)).unionByName(ids.select("gid").distinct().withColumn("_a", F.lit(2)))
    return both.groupBy("gid").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select("gid")


def range_select(segments: DataFrame, current: DataFrame, a: int, b: int) -> DataFrame:
    """Ids of the segments between two rows of the list, and the current selection."""
    rows = segments.select("segment_id", F.row_number().over(Window.orderBy("pos")).alias("i"))  # a small dimension
    ends = F.broadcast(rows.where(F.col("segment_id").isin(a, b)).agg(F.min("i").alias("lo"), F.max("i").alias("hi")))
    return rows.crossJoin(ends).where("i between lo and hi").select("segment_id").union(current.select("segment_id")).distinct()


def compose(scene: DataFrame, other: DataFrame, project: str, chosen: Column, **how) -> DataFrame:
    """A scene and the transformed rows of a segment of another project, with their origin."""
    part = transform(other.where(chosen), F.lit(True), **how)
    return scene.withColumn("origin", F.lit("self")).unionByName(part.withColumn("origin", F.lit(project)), allowMissingColumns=True)


def classify(segments: DataFrame, vocabulary: DataFrame, threshold: float = 0.15, temperature: float = 100.0) -> DataFrame:
    """Zero-shot labels: (segment_id, label, confidence). segments (segment_id, v), vocabulary (label, w): arrays.

    Unit vectors, scaled dot product, softmax over the vocabulary, the best label if
    its probability reaches the threshold; the confidence always, to 3 digits.
    """
    unit = lambda c: F.transform(c, lambda x: x / F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, y: s + y * y)))
    dot = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y)
    s = segments.select("segment_id", unit(F.col("v").cast("array<double>")).alias("v")).crossJoin(small(vocabulary.select("label", unit(F.col("w").cast("array<double>")).alias("w"))))
    s = s.select("segment_id", "label", (dot * temperature).alias("s"))
    by = Window.partitionBy("segment_id")
    p = s.withColumn("e", F.exp(F.col("s") - F.max("s").over(by))).withColumn("p", F.col("e") / F.sum("e").over(by))
    best = p.groupBy("segment_id").agg(F.max(F.struct("p", F.col("label"))).alias("m"))
    return best.select("segment_id", F.when(F.col("m.p") >= threshold, F.col("m.label")).alias("label"), F.round("m.p", 3).alias("confidence"))
