"""Training runs and benchmark results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HIGHER = {"mean_psnr": True, "mean_ssim": True, "mean_lpips": False}
#: Where each stage of a job lies in its progress (stage, start, width).
STAGES = [("extract", 0.0, 0.08), ("prepare", 0.08, 0.04), ("match", 0.12, 0.28), ("train", 0.15, 0.75), ("refine", 0.40, 0.55)]
#: Published results (method, scene, PSNR, SSIM, LPIPS).
PUBLISHED = [
    ("3dgs", "kitchen", 31.14, 0.926, 0.155), ("3dgs", "room", 31.43, 0.918, 0.184), ("3dgs", "counter", 29.28, 0.913, 0.180), ("3dgs", "bonsai", 32.32, 0.948, 0.135), ("3dgs", "bicycle", 25.15, 0.765, 0.246),
    ("3dgs", "garden", 27.32, 0.858, 0.137), ("3dgs", "stump", 26.55, 0.770, 0.261), ("3dgs", "flowers", 21.52, 0.605, 0.336), ("3dgs", "treehill", 22.49, 0.631, 0.339),
    ("2dgs", "kitchen", 31.35, 0.929, 0.145), ("2dgs", "room", 31.32, 0.919, 0.174), ("2dgs", "counter", 29.16, 0.912, 0.172), ("2dgs", "bonsai", 32.67, 0.949, 0.127), ("2dgs", "bicycle", 25.19, 0.758, 0.247),
    ("2dgs", "garden", 27.13, 0.852, 0.142), ("2dgs", "stump", 26.61, 0.766, 0.262), ("2dgs", "flowers", 21.30, 0.587, 0.346), ("2dgs", "treehill", 22.62, 0.628, 0.341),
]


def published(spark) -> DataFrame:
    rows = [(f"published-{m}", "mipnerf360", s, p, q, r, None, None, True) for m, s, p, q, r in PUBLISHED]
    return spark.createDataFrame(rows, "method string, dataset string, scene string, mean_psnr double, mean_ssim double, mean_lpips double, training_time_sec double, num_gaussians bigint, is_published boolean")


def with_published(results: DataFrame) -> DataFrame:
    return results.unionByName(published(results.sparkSession), allowMissingColumns=True)


def divergence(log: DataFrame, window: int = 200, factor: float = 1.5) -> DataFrame:
    """Adds diverged: the mean of the last half window is over factor times that of the first half."""
    half = window // 2
    w = Window.partitionBy("run_id").orderBy("step")
    old, new = F.avg("loss").over(w.rowsBetween(1 - window, -half)), F.avg("loss").over(w.rowsBetween(1 - half, 0))
    enough = F.row_number().over(w) >= window
    return log.withColumn("diverged", enough & (F.round(new, 9) > F.round(old * factor, 9)))


def first_divergence(log: DataFrame, window: int = 200, factor: float = 1.5) -> DataFrame:
    return divergence(log, window, factor).where("diverged").groupBy("run_id").agg(F.min("step").alias("step"))


def early_stop(evals: DataFrame, patience: int = 3) -> DataFrame:
    """(run_id, best, best_step, stop_step): stops after `patience` evaluations without a new best."""
    w = Window.partitionBy("run_id").orderBy("step")
    before = F.max("mean_psnr").over(w.rowsBetween(Window.unboundedPreceding, -1))
    e = evals.withColumn("_up", before.isNull() | (F.col("mean_psnr") > before)).withColumn("_isle", F.sum(F.col("_up").cast("int")).over(w))
    e = e.withColumn("_k", F.row_number().over(Window.partitionBy("run_id", "_isle").orderBy("step")) - 1)
    stop = F.min(F.when(F.col("_k") >= patience, F.col("step")))
    s = e.groupBy("run_id").agg(stop.alias("stop_step"))
    seen = e.join(s, "run_id").where(F.col("stop_step").isNull() | (F.col("step") <= F.col("stop_step")))
    return seen.groupBy("run_id").agg(F.max("mean_psnr").alias("best"), F.max_by("step", F.struct("mean_psnr", -F.col("step"))).alias("best_step"), F.first("stop_step").alias("stop_step"))


def run_summary(log: DataFrame, every: int = 10) -> DataFrame:
    """(run_id, first_loss, last_loss, curve): curve holds (step, psnr) of every 10th step."""
    curve = F.sort_array(F.collect_list(F.when(F.col("step") % every == 0, F.struct("step", F.round("mean_psnr", 6).alias("psnr")))))
    return log.groupBy("run_id").agg(F.min_by("loss", "step").alias("first_loss"), F.max_by("loss", "step").alias("last_loss"), curve.alias("curve"))


def stage_deltas(stages: DataFrame) -> DataFrame:
    """Adds delta, the PSNR over the scene's first stage."""
    w = Window.partitionBy("scene").orderBy("stage_no")
    return stages.withColumn("delta", F.col("mean_psnr") - F.first("mean_psnr").over(w))


def extreme_stages(stages: DataFrame) -> DataFrame:
    """(scene, best, worst): the stages of the largest gain and loss against the baseline."""
    d = stage_deltas(stages).where("stage_no > 0").withColumn("_d", F.round("delta", 9))
    return d.groupBy("scene").agg(F.max_by("stage", F.struct("_d", -F.col("stage_no"))).alias("best"), F.min_by("stage", F.struct("_d", "stage_no")).alias("worst"))


def best_stage(stages: DataFrame) -> DataFrame:
    """(scene, stage): the highest PSNR strictly above the baseline, else the baseline; the earlier one on ties."""
    return stages.groupBy("scene").agg(F.max_by("stage", F.struct("mean_psnr", -F.col("stage_no"))).alias("stage"))


def comparison(results: DataFrame, metric: str = "mean_psnr", scenes: list[str] | None = None) -> DataFrame:
    """One row per method, a column per scene."""
    return results.groupBy("method").pivot("scene", scenes).agg(F.first(metric))


def method_means(results: DataFrame, missing: str = "skip") -> DataFrame:
    """Means across scenes per method. missing: "zero" counts an absent metric as 0, "skip" leaves it out; time and size over positive values only."""
    m = lambda c: F.avg(F.coalesce(F.col(c), F.lit(0.0)) if missing == "zero" else F.col(c)).alias(c)
    return results.groupBy("method").agg(F.count(F.lit(1)).alias("n_scenes"), *[m(c) for c in HIGHER], *[F.avg(F.when(F.col(c) > 0, F.col(c))).alias(c) for c in ("training_time_sec", "num_gaussians")])


def best_per_scene(results: DataFrame, metric: str) -> DataFrame:
    """(scene, method, value, is_best)."""
    best = results.groupBy("scene").agg((F.max if HIGHER[metric] else F.min)(metric).alias("_best"))
    return results.where(F.col(metric).isNotNull()).join(best, "scene").select("scene", "method", F.col(metric).alias("value"), (F.col(metric) == F.col("_best")).alias("is_best"))


def facets(results: DataFrame) -> DataFrame:
    """(dataset, scenes, methods): sorted lists per dataset."""
    return results.groupBy("dataset").agg(F.sort_array(F.collect_set("scene")).alias("scenes"), F.sort_array(F.collect_set("method")).alias("methods"))


def method_order(methods: DataFrame) -> DataFrame:
    """Adds place: local methods before published ones, then by name. Methods are a small dimension."""
    return methods.withColumn("place", F.row_number().over(Window.orderBy(F.col("method").startswith("published-"), "method")))


def overall_progress(stage: Column, fraction: Column) -> Column:
    """A stage's fraction as progress of the whole job."""
    c = F.when(stage == STAGES[0][0], STAGES[0][1] + STAGES[0][2] * fraction)
    for name, start, width in STAGES[1:]:
        c = c.when(stage == name, start + width * fraction)
    return c
