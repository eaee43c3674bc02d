"""Image-space metrics over pixel tables (view, u, v, r, g, b, gt_*, depth, alpha), TSDF fusion."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import camera_space, pinhole, world_space
from ..scratch import written
from .camera import NEAR, pose, small
from .scene import median_of


def rows() -> tuple[Window, Window]:
    return Window.partitionBy("view", "v").orderBy("u"), Window.partitionBy("view", "u").orderBy("v")


def gradient(c: Column) -> Column:
    """Central-difference magnitude with replicated borders."""
    along, across = rows()
    gx = F.coalesce(F.lead(c).over(along), c) - F.coalesce(F.lag(c).over(along), c)
    gy = F.coalesce(F.lead(c).over(across), c) - F.coalesce(F.lag(c).over(across), c)
    return F.sqrt(gx * gx + gy * gy)


def gray(*names: str) -> Column:
    r, g, b = names or ("r", "g", "b")
    return 0.299 * F.col(r) + 0.587 * F.col(g) + 0.114 * F.col(b)


def psnr(px: DataFrame, zero: str = "inf") -> DataFrame:
    """(view, psnr). zero: what a perfect view gets: "inf", "guard" (+1e-8) or "floor" (at least 1e-10)."""
    e = F.array(*[(F.col(c) - F.col(f"gt_{c}")) * (F.col(c) - F.col(f"gt_{c}")) for c in "rgb"])
    mse = px.select("view", F.explode(e).alias("e")).groupBy("view").agg(F.avg("e").alias("mse"))
    m = F.col("mse")
    value = {"inf": F.when(m == 0, F.lit(float("inf"))).otherwise(-10.0 * F.log10(m)), "guard": -10.0 * F.log10(m + 1e-8), "floor": -10.0 * F.log10(F.greatest(m, F.lit(1e-10)))}[zero]
    return mse.select("view", value.alias("psnr"))


def ssim(px: DataFrame, window: int = 11, sigma: float = 1.5) -> DataFrame:
    """(view, ssim): Gaussian window, zero padding, mean over pixels and channels. A view is one image, so a group is bounded."""
    half = window // 2
    g = [math.exp(-((i - half) ** 2) / (2 * sigma * sigma)) for i in range(window)]
    weights = [x / sum(g) for x in g]

    def one(pdf):
        import numpy as np
        import pandas as pd

        w, h = int(pdf["u"].max()) + 1, int(pdf["v"].max()) + 1

        def blurred(a):
            p = np.pad(a, half)
            rows = sum(k * p[i : i + h, :] for i, k in enumerate(weights))
            return sum(k * rows[:, i : i + w] for i, k in enumerate(weights))

        total = 0.0
        for c in "rgb":
            a, b = np.zeros((h, w)), np.zeros((h, w))
            a[pdf["v"], pdf["u"]], b[pdf["v"], pdf["u"]] = pdf[c], pdf[f"gt_{c}"]
            ma, mb = blurred(a), blurred(b)
            va, vb, cov = blurred(a * a) - ma * ma, blurred(b * b) - mb * mb, blurred(a * b) - ma * mb
            total += (((2 * ma * mb + 1e-4) * (2 * cov + 9e-4)) / ((ma * ma + mb * mb + 1e-4) * (va + vb + 9e-4))).mean()
        return pd.DataFrame({"view": [pdf["view"].iloc[0]], "ssim": [total / 3]})

    cols = ["view", "u", "v", *[f"{p}{c}" for c in "rgb" for p in ("", "gt_")]]
    return px.select(*cols).groupBy("view").applyInPandas(one, "view int, ssim double")


def evaluation(per_view: DataFrame, n_gaussians: int) -> DataFrame:
    """Means of the per-view metrics, to 4 digits."""
    return per_view.agg(F.round(F.avg("psnr"), 4).alias("mean_psnr"), F.round(F.avg("ssim"), 4).alias("mean_ssim"), F.count(F.lit(1)).alias("n_views"), F.lit(n_gaussians).alias("num_gaussians"))


def even_views(views: DataFrame, k: int) -> DataFrame:
    """k of the views (view), evenly spaced: floor(i n / k). Views are a small dimension."""
    i = views.select("view", (F.row_number().over(Window.orderBy("view")) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    first = F.ceil(F.col("i") * k / F.col("n"))
    return i.where((F.col("n") <= k) | (F.floor(first * F.col("n") / k) == F.col("i"))).select("view")


def depth_pairs(px: DataFrame, cams: DataFrame, pairs: DataFrame, step: int = 4) -> DataFrame:
    """(a, b, z, depth): every step-th valid pixel of view a seen from b, with b's bilinear depth, where alpha is over .5 in both."""
    cam_cols = [*[f"r{i}{j}" for i in range(3) for j in range(3)], "t0", "t1", "t2", "fx", "fy", "cx", "cy", "width", "height"]
    ca = small(cams.select(F.col("pos").alias("a"), *cam_cols))
    cb = small(cams.select(F.col("pos").alias("b"), *[F.col(c).alias(f"b_{c}") for c in cam_cols]))
    src = px.where((F.col("u") % step == 0) & (F.col("v") % step == 0) & (F.col("alpha") > 0.5)).select(F.col("view").alias("a"), "u", "v", F.col("depth").alias("d"))
    full = Window.partitionBy("a", "b")
    s = src.join(small(pairs), "a").join(ca, "a").join(cb, "b").withColumn("_n0", F.count(F.lit(1)).over(full))
    cam = ((F.col("u") - F.col("cx")) / F.col("fx") * F.col("d"), (F.col("v") - F.col("cy")) / F.col("fy") * F.col("d"), F.col("d"))
    world = world_space(cam, *pose())
    xb, yb, zb = camera_space(world, *pose("b_"))
    s = s.withColumns({"xb": xb, "yb": yb, "z": zb}).where(F.col("z") > NEAR).withColumn("_n1", F.count(F.lit(1)).over(full))
    ub, vb = pinhole(F.col("xb"), F.col("yb"), F.col("z"), *[F.col(f"b_{c}") for c in ("fx", "fy", "cx", "cy")])
    s = s.withColumns({"ub": ub, "vb": vb}).where((F.col("ub") >= 0) & (F.col("ub") < F.col("b_width") - 1) & (F.col("vb") >= 0) & (F.col("vb") < F.col("b_height") - 1)).withColumn("_n2", F.count(F.lit(1)).over(full))
    s = s.where((F.col("_n0") >= 10) & (F.col("_n1") >= 10) & (F.col("_n2") >= 10)).select("a", "b", F.col("u").alias("su"), F.col("v").alias("sv"), "ub", "vb", "z")
    iu, iv = F.floor("ub"), F.floor("vb")
    fu, fv = F.col("ub") - iu, F.col("vb") - iv
    corner = lambda du, dv, w: F.struct((iu + du).cast("int").alias("cu"), (iv + dv).cast("int").alias("cv"), w.alias("w"))
    c = s.withColumn("c", F.explode(F.array(corner(0, 0, (1 - fu) * (1 - fv)), corner(1, 0, fu * (1 - fv)), corner(0, 1, (1 - fu) * fv), corner(1, 1, fu * fv))))
    b = px.select(F.col("view").alias("b"), F.col("u").alias("cu"), F.col("v").alias("cv"), F.col("depth").alias("bd"), F.col("alpha").alias("ba"))
    c = c.select("a", "b", "su", "sv", "z", "c.*").join(b, ["b", "cu", "cv"])
    m = c.groupBy("a", "b", "su", "sv").agg(F.first("z").alias("z"), F.sum(F.col("w") * F.col("bd")).alias("depth"), F.sum(F.col("w") * F.col("ba")).alias("alpha"))
    m = m.where(F.round("alpha", 9) > 0.5).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("a", "b")))
    return m.where("_n >= 10").select("a", "b", "z", "depth")


def depth_consistency(met: DataFrame, threshold: float = 0.05) -> DataFrame:
    """From depth_pairs: share of consistent depths averaged over pairs, mean and median absolute error over all pixels."""
    e = written(met.select("a", "b", "depth", F.abs(F.col("z") - F.col("depth")).alias("e")))
    per = e.groupBy("a", "b").agg(F.avg((F.col("e") / (F.col("depth") + 1e-6) < threshold).cast("double")).alias("ok"))
    one = per.agg(F.coalesce(F.avg("ok"), F.lit(0.0)).alias("pct_consistent"), F.count(F.lit(1)).alias("n_pairs"))
    return one.crossJoin(e.agg(F.coalesce(F.avg("e"), F.lit(0.0)).alias("mean_abs_depth_error"), F.coalesce(median_of(e, "e"), F.lit(0.0)).alias("median_abs_depth_error")))


def edge_alignment(px: DataFrame, least: int = 100) -> DataFrame:
    """(view, alignment): correlation of depth and grey gradients over pixels with alpha > .5, at least 0."""
    g = px.withColumns({"_g": gray()}).withColumns({"ga": gradient(F.col("_g")), "gd": gradient(F.col("depth"))}).where(F.col("alpha") > 0.5)
    m = g.groupBy("view").agg(F.corr("ga", "gd").alias("c"), F.count(F.lit(1)).alias("n"), F.stddev_pop("ga").alias("sa"), F.stddev_pop("gd").alias("sd"))
    return m.where((F.col("n") >= least) & (F.col("sa") >= 1e-8) & (F.col("sd") >= 1e-8) & ~F.isnan("c")).select("view", F.greatest("c", F.lit(0.0)).alias("alignment"))


def edge_summary(per_view: DataFrame) -> DataFrame:
    return per_view.agg(F.coalesce(F.avg("alignment"), F.lit(0.0)).alias("mean_edge_alignment"), F.count(F.lit(1)).alias("n_views"))


def alpha_coverage(px: DataFrame) -> DataFrame:
    v = px.groupBy("view").agg(F.avg("alpha").alias("m"), F.avg((F.col("alpha") < 0.5).cast("double")).alias("h"), F.avg((F.col("alpha") > 0.9).cast("double")).alias("c"))
    return v.agg(F.coalesce(F.avg("m"), F.lit(0.0)).alias("mean_alpha"), F.coalesce(F.avg("h"), F.lit(1.0)).alias("frac_holes"), F.coalesce(F.avg("c"), F.lit(0.0)).alias("frac_well_covered"), F.coalesce(F.stddev_pop("m"), F.lit(0.0)).alias("alpha_std"), F.count(F.lit(1)).alias("n_views"))


#: The points that each part of the health score is worth.
WEIGHTS = {"geometry": 30, "edge_alignment": 20, "coverage": 20, "cleanliness": 15, "opacity_health": 15}


def health_score(stats: DataFrame, depth: DataFrame, edges: DataFrame, alpha: DataFrame) -> DataFrame:
    """Composite 0-100 from four one-row summaries."""
    one = stats.select("outliers", "transparent").crossJoin(depth.select("pct_consistent")).crossJoin(edges.select("mean_edge_alignment")).crossJoin(alpha.select("mean_alpha"))
    parts = {"geometry": F.col("pct_consistent"), "edge_alignment": F.col("mean_edge_alignment"), "coverage": F.col("mean_alpha"), "cleanliness": 1.0 - F.col("outliers"), "opacity_health": 1.0 - F.col("transparent")}
    score = sum((w * parts[k] for k, w in list(WEIGHTS.items())[1:]), WEIGHTS["geometry"] * parts["geometry"])
    return one.select(F.round(score, 1).alias("score"), *[F.round(c, 4).alias(k) for k, c in parts.items()])


def image_losses(px: DataFrame) -> DataFrame:
    """Mean absolute error, and depth total variation damped at image edges."""
    along, across = rows()
    l1 = px.select(F.explode(F.array(*[F.abs(F.col(c) - F.col(f"gt_{c}")) for c in "rgb"])).alias("e")).agg(F.avg("e").alias("l1"))
    diff = lambda w: (F.abs(F.lead("depth").over(w) - F.col("depth")), sum(F.abs(F.lead(f"gt_{c}").over(w) - F.col(f"gt_{c}")) for c in "rgb") / 3.0)
    (dx, ix), (dy, iy) = diff(along), diff(across)
    tv = px.select((dx * F.exp(ix * -10.0)).alias("tx"), (dy * F.exp(iy * -10.0)).alias("ty")).agg((F.avg("tx") + F.avg("ty")).alias("depth_tv"))
    return l1.crossJoin(tv)


def surface_metrics(px: DataFrame) -> DataFrame:
    """Mean of 1 - n·s of rendered (nx, ny, nz) and surface (sx, sy, sz) normals, and mean distortion."""
    dot = F.col("nx") * F.col("sx") + F.col("ny") * F.col("sy") + F.col("nz") * F.col("sz")
    return px.agg(F.avg(1.0 - dot).alias("normal_inconsistency"), F.avg("distortion").alias("distortion"))


def view_ranking(px: DataFrame, confidence: str = "alpha") -> DataFrame:
    """(view, confidence, rank): by mean confidence, the highest first; natural order for up to two views."""
    m = px.groupBy("view").agg(F.round(F.avg(confidence), 9).alias("confidence"))
    n = F.count(F.lit(1)).over(Window.partitionBy())
    m = m.withColumn("_k", F.when(n <= 2, F.lit(0.0)).otherwise(F.col("confidence")))  # a row per view
    return m.select("view", "confidence", (F.row_number().over(Window.orderBy(F.desc("_k"), "view")) - 1).alias("rank"))


def covered_pixels(px: DataFrame, cams: DataFrame, ranking: DataFrame, threshold: float) -> DataFrame:
    """(view, u, v) of pixels that points of higher-ranked views already cover within the depth threshold.

    Depths are min-max normalised: the points' over all higher-ranked views, the pixels' over their view.
    """
    r = small(ranking.select("view", "rank"))
    per = px.groupBy("view").agg(F.min("depth").alias("lo"), F.max("depth").alias("hi")).join(r, "view")
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)  # a row per view
    per = per.select("view", "rank", F.col("lo").alias("c_lo"), F.col("hi").alias("c_hi"), F.min("lo").over(before).alias("p_lo"), F.max("hi").over(before).alias("p_hi"))
    cam_cols = [*[f"r{i}{j}" for i in range(3) for j in range(3)], "t0", "t1", "t2", "fx", "fy", "cx", "cy"]
    src = px.join(r, "view").join(small(cams.select(F.col("pos").alias("view"), *cam_cols)), "view")
    cam = ((F.col("u") - F.col("cx")) / F.col("fx") * F.col("depth"), (F.col("v") - F.col("cy")) / F.col("fy") * F.col("depth"), F.col("depth"))
    x, y, z = world_space(cam, *pose())
    pts = src.select(F.col("rank").alias("p_rank"), F.col("depth").alias("p_depth"), x.alias("x"), y.alias("y"), z.alias("z"))
    target = small(per.join(cams.select(F.col("pos").alias("view"), *cam_cols, "width", "height"), "view"))
    m = pts.join(target, F.col("p_rank") < F.col("rank"))  # few views on the broadcast side
    xc, yc, zc = camera_space((F.col("x"), F.col("y"), F.col("z")), *pose())
    guard = zc + 1e-8
    u, v = (F.col("fx") * xc + F.col("cx") * zc) / guard, (F.col("fy") * yc + F.col("cy") * zc) / guard
    m = m.withColumns({"_u": u, "_v": v}).where((F.col("_u") >= 0) & (F.col("_u") < F.col("width")) & (F.col("_v") >= 0) & (F.col("_v") < F.col("height")))
    norm = lambda d, lo, hi: F.when(F.col(hi) > F.col(lo), (F.col(d) - F.col(lo)) / (F.col(hi) - F.col(lo))).otherwise(F.col(d))
    m = m.select("view", F.floor("_u").cast("int").alias("u"), F.floor("_v").cast("int").alias("v"), norm("p_depth", "p_lo", "p_hi").alias("pd"), "c_lo", "c_hi")
    hit = m.join(px.select("view", "u", "v", "depth"), ["view", "u", "v"])
    return hit.where(F.round(F.abs(F.col("pd") - norm("depth", "c_lo", "c_hi")), 9) < threshold).select("view", "u", "v").distinct()


def voxel_grid(spark, dims: tuple[int, int, int]) -> DataFrame:
    nx, ny, nz = dims
    return spark.range(nx * ny * nz).select(F.expr(f"cast(id div {ny * nz} as int)").alias("i"), F.expr(f"cast((id div {nz}) % {ny} as int)").alias("j"), F.expr(f"cast(id % {nz} as int)").alias("k"))


def fuse(px: DataFrame, cams: DataFrame, origin: tuple[float, float, float], voxel: float, dims: tuple[int, int, int], truncation: float) -> DataFrame:
    """(i, j, k, tsdf, r, g, b, weight) of the observed voxels: depth maps averaged into a truncated signed distance."""
    grid = voxel_grid(px.sparkSession, dims)
    at = tuple(F.col(n) * voxel + o for n, o in zip("ijk", origin, strict=True))
    seen = grid.crossJoin(small(cams))
    xc, yc, zc = camera_space(at, *pose())
    seen = seen.withColumns({"_x": xc, "_y": yc, "z": zc}).where(F.col("z") > NEAR)
    u, v = pinhole(F.col("_x"), F.col("_y"), F.col("z"), *[F.col(c) for c in ("fx", "fy", "cx", "cy")])
    seen = seen.select("i", "j", "k", F.col("pos").alias("view"), u.cast("long").alias("u"), v.cast("long").alias("v"), "z", "width", "height").where("u >= 0 and u < width and v >= 0 and v < height")  # cast truncates towards 0
    m = seen.join(px.select("view", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), "depth", "r", "g", "b"), ["view", "u", "v"])
    sdf = F.col("depth") - F.col("z")
    m = m.where((F.col("depth") > 0) & (sdf > -truncation)).withColumn("t", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sdf / truncation)))
    return m.groupBy("i", "j", "k").agg(F.avg("t").alias("tsdf"), *[F.avg(c).alias(c) for c in "rgb"], F.count(F.lit(1)).alias("weight"))


def crossings(volume: DataFrame, origin: tuple[float, float, float], voxel: float, dims: tuple[int, int, int]) -> DataFrame:
    """(x, y, z, r, g, b): a vertex on each grid edge where the distance changes sign; colours of the voxel it lies in.

    Unobserved voxels have distance 1 and no colour.
    """
    full = voxel_grid(volume.sparkSession, dims).join(volume.select("i", "j", "k", F.col("tsdf").alias("_t"), "r", "g", "b"), ["i", "j", "k"], "left")
    full = full.select("i", "j", "k", F.coalesce("_t", F.lit(1.0)).alias("t"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in "rgb"])
    out = None
    for axis in "ijk":
        other = full.select(*[(F.col(n) - 1).alias(n) if n == axis else F.col(n) for n in "ijk"], F.col("t").alias("t2"))
        e = full.join(other, ["i", "j", "k"]).where(F.signum(F.col("t") + 0.0) * F.signum("t2") < 0).withColumn("f", F.col("t") / (F.col("t") - F.col("t2")))
        pos = [((F.col(n) + F.col("f")) if n == axis else F.col(n)) * voxel + o for n, o in zip("ijk", origin, strict=True)]
        part = e.select(*[p.alias(n) for p, n in zip(pos, "xyz", strict=True)], "r", "g", "b")
        out = part if out is None else out.unionByName(part)
    return out


def sharpness(px: DataFrame) -> DataFrame:
    """(view, sharpness): variance of the 4-neighbour Laplacian of the grey image (0-255), clipped to [-128, 127].

    Pixels at the border keep their grey value, less 128.
    """
    along, across = rows()
    g = px.withColumn("_g", F.floor(gray() * 255.0 + 0.5))
    lap = F.lead("_g").over(along) + F.lag("_g").over(along) + F.lead("_g").over(across) + F.lag("_g").over(across) - 4.0 * F.col("_g")
    clipped = F.greatest(F.lit(-128.0), F.least(F.lit(127.0), F.col("l")))
    return g.withColumn("l", lap).groupBy("view").agg(F.var_pop(F.when(F.col("l").isNull(), F.col("_g") - 128.0).otherwise(clipped)).alias("sharpness"))
