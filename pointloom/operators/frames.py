"""Frames of videos: keyframe gates, splits, even picks, numbering. Windows run per scene (the by columns)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLUR, SIMILAR, LONGEST_GAP, MIN_FRAMES = 50.0, 0.02, 3, 20


def _scan(by: list[str], order: str = "idx") -> Window:
    return Window.partitionBy(*by).orderBy(order)


def blur_gate(frames: DataFrame, by: list[str], threshold: float = BLUR, longest: int = LONGEST_GAP) -> DataFrame:
    """Adds blurry_drop: blurry frames go, but of each run of them every (longest + 1)-th stays."""
    blurry = F.col("sharpness") < threshold
    f = frames.withColumn("_run", F.sum((~blurry).cast("int")).over(_scan(by)))
    k = F.row_number().over(Window.partitionBy(*by, "_run", "_b").orderBy("idx"))
    return f.withColumn("_b", blurry).withColumn("blurry_drop", F.col("_b") & (k % (longest + 1) != 0)).drop("_run", "_b")


def feature_distance(a: Column, b: Column) -> Column:
    """Mean absolute difference of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def _redundant(kept: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """Adds _hit (similar to its predecessor) and _later (then it is the one to go, not the predecessor)."""
    w = _scan(by)
    d = feature_distance(F.col("feature"), F.lag("feature").over(w))
    return kept.withColumns({"_hit": F.coalesce(d < threshold, F.lit(False)), "_later": F.col("sharpness") < F.lag("sharpness").over(w)})


def redundancy_gate(kept: DataFrame, by: list[str], threshold: float = SIMILAR) -> DataFrame:
    """Adds similar_drop: of two similar neighbours the less sharp one goes, the earlier one on ties."""
    f = _redundant(kept, by, threshold)
    w = _scan(by)
    first = F.coalesce(F.lead("_hit").over(w) & ~F.lead("_later").over(w), F.lit(False))
    return f.withColumn("similar_drop", (F.col("_hit") & F.col("_later")) | first).drop("_hit", "_later")


def score_and_select(frames: DataFrame, by: list[str], blur: float = BLUR, similar: float = SIMILAR) -> DataFrame:
    """Adds selected after both gates; nothing is deleted."""
    f = blur_gate(frames, by, blur)
    gone = redundancy_gate(f.where(~F.col("blurry_drop")), by, similar).where("similar_drop").select(*by, "idx", F.lit(True).alias("_gone"))
    return f.join(gone, [*by, "idx"], "left").withColumn("selected", ~F.col("blurry_drop") & F.col("_gone").isNull()).drop("_gone", "blurry_drop")


def select_keyframes(frames: DataFrame, by: list[str], blur: float = BLUR, similar: float = SIMILAR, min_frames: int = MIN_FRAMES) -> DataFrame:
    """The frames that stay, renumbered from 0 (new_idx); neither gate goes below min_frames.

    Drops are ranked in scan order and accepted while the budget lasts.
    """
    all_ = Window.partitionBy(*by)
    w = _scan(by)
    f = blur_gate(frames, by, blur).withColumn("_budget", F.count(F.lit(1)).over(all_) - min_frames)
    f = f.withColumn("_rank", F.sum(F.col("blurry_drop").cast("int")).over(w))
    f = f.withColumn("_out", F.col("blurry_drop") & (F.col("_rank") <= F.col("_budget")))
    f = f.withColumn("_budget2", F.col("_budget") - F.sum(F.col("_out").cast("int")).over(all_))
    kept = _redundant(f.where(~F.col("_out")), by, similar)
    # A similar pair names the frame to go; its first naming counts, in the order of the pairs.
    first = F.coalesce(F.lead("_hit").over(w) & ~F.lead("_later").over(w), F.lit(False))
    own = F.col("_hit") & F.col("_later")
    kept = kept.withColumn("_pair", F.row_number().over(w))
    kept = kept.withColumn("_named", F.when(own, F.col("_pair")).when(first, F.col("_pair") + 1))
    order = Window.partitionBy(*by).orderBy(F.col("_named").asc_nulls_last())
    kept = kept.withColumn("_nth", F.when(F.col("_named").isNotNull(), F.row_number().over(order)))
    kept = kept.where(F.col("_nth").isNull() | (F.col("_nth") > F.col("_budget2")))
    cols = [c for c in frames.columns]
    return kept.withColumn("new_idx", F.row_number().over(w) - 1).select(*cols, "new_idx")


def source_runs(frames: DataFrame, by: list[str]) -> DataFrame:
    """(by, run, source_file, first, last, n): runs of consecutive frames from one source."""
    w = _scan(by)
    new = F.coalesce((F.col("source_file") != F.lag("source_file").over(w)).cast("int"), F.lit(1))
    f = frames.withColumn("_new", new).withColumn("run", F.sum("_new").over(w) - 1)
    return f.groupBy(*by, "run", "source_file").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count(F.lit(1)).alias("n"))


def subsample(frames: DataFrame, by: list[str], most: int, chunked: bool = False) -> DataFrame:
    """The frames used: all if there are at most `most`, else every (n // most)-th, at most `most`."""
    if chunked:
        return frames
    f = frames.withColumns({"_i": F.row_number().over(_scan(by)) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / most))
    return f.where((F.col("_n") <= most) | ((F.col("_i") % step == 0) & (F.col("_i") / step < most))).drop("_i", "_n")


def evenly(frames: DataFrame, by: list[str], k: int, ends: bool = False) -> DataFrame:
    """k rows, evenly spaced: floor(i n / k), or with ends=True the truncated linspace(0, n - 1, k)."""
    f = frames.withColumns({"_i": F.row_number().over(_scan(by)) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    # Row i is picked if floor(t * step) = i for some t, where step is at least 1; only t = ceil(i / step) can be it.
    step = (F.col("_n") - 1) / F.lit(float(k - 1)) if ends and k > 1 else F.col("_n") / F.lit(float(k))
    t = F.ceil(F.round(F.col("_i") / step, 9))
    hit = (F.floor(F.round(t * step, 9)) == F.col("_i")) & (t < k)
    return f.where((F.col("_n") <= k) | hit).drop("_i", "_n")


def train_test(frames: DataFrame, by: list[str], every: int = 8) -> DataFrame:
    """Adds is_test: every 8th frame."""
    return frames.withColumn("is_test", (F.row_number().over(_scan(by)) - 1) % every == 0)


def guarded_train_test(frames: DataFrame, by: list[str], every: int = 4) -> DataFrame:
    """Adds is_test: every 4th, if there are more than 4 frames and at least 2 remain for training."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    test = F.ceil(n / every)
    return frames.withColumn("is_test", ((F.row_number().over(_scan(by)) - 1) % every == 0) & (n > 4) & (n - test >= 2))


def unified_numbers(sources: DataFrame, by: list[str]) -> DataFrame:
    """(source_file, n, is_image) rows numbered together: videos first, then photos, by source and place. Adds number and filename."""
    w = Window.partitionBy(*by).orderBy("is_image", "source_file", "n")
    return sources.withColumn("number", F.row_number().over(w) - 1).withColumn("filename", F.format_string("frame_%05d.jpg", F.col("number")))


def update_selection(frames: DataFrame, patch: DataFrame, keys: Sequence[str] = ("filename",)) -> DataFrame:
    """frames with selected overwritten by patch (keys, selected). The keys name one row of each; filename does where names are unique."""
    return frames.join(patch.select(*keys, F.col("selected").alias("_s")), list(keys), "left").withColumn("selected", F.coalesce("_s", "selected")).drop("_s")


def frame_counts(frames: DataFrame) -> DataFrame:
    """Per source and in total (source null): frames, selected, used."""
    g = frames.rollup("source_file").agg(F.count(F.lit(1)).alias("n"), F.count_if("selected").alias("n_selected"), F.count_if("used").alias("n_used"))
    return g


def safe_names(files: DataFrame, by: list[str]) -> DataFrame:
    """Adds safe_name: unsafe signs become _, and repeated names get _1, _2, ... before the extension."""
    clean = F.regexp_replace("filename", r"[^A-Za-z0-9._-]", "_")
    f = files.withColumn("_c", clean)
    k = F.row_number().over(Window.partitionBy(*by, "_c").orderBy("idx")) - 1
    stem, ext = F.regexp_extract("_c", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("_c", r"^(.*?)(\.[^.]*)?$", 2)
    return f.withColumn("safe_name", F.when(k == 0, F.col("_c")).otherwise(F.concat(stem, F.lit("_"), k.cast("string"), ext))).drop("_c")
