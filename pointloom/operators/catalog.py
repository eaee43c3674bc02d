"""Catalog tables: projects, jobs, scene objects, files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The files that tell which pipeline stages a project has.
RAW, SCENE, PRE_PRUNE, PRE_REFINE, PACKED = "anysplat_output.ply", "scene.ply", "scene_pre_prune.ply", "scene_pre_refine.ply", "scene.spz"


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The row with that key; none is an error."""
    got = df.where(F.col(key) == value)
    if got.isEmpty():
        raise KeyError(value)
    return got


def listing(df: DataFrame, order: str, newest_first: bool = True, **equal) -> DataFrame:
    for k, v in equal.items():
        df = df.where(F.col(k) == v)
    return df.orderBy(F.desc(order) if newest_first else F.asc(order), "id")


def with_scene(projects: DataFrame) -> DataFrame:
    return projects.where((F.col("status") == "ready") | (F.col("gaussian_count") > 0))


def ready_count(projects: DataFrame) -> DataFrame:
    return projects.agg(F.count_if(F.col("status") == "ready").alias("n_ready"))


def patched(df: DataFrame, patch: DataFrame, key: str = "id") -> DataFrame:
    """Non-null fields of the patch overwrite those of its row."""
    fields = [c for c in patch.columns if c != key]
    p = patch.select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    return df.join(p, key, "left").select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns])


def upserted(df: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """patched(), and rows with new keys added."""
    fields = [c for c in rows.columns if c != key]
    p = rows.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in fields])
    both = df.join(p, F.col(key) == F.col("_key"), "full_outer")
    return both.select(*[F.coalesce(F.col("_key"), F.col(key)).alias(key) if c == key else F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns])


def hidden(objects: DataFrame, ids: DataFrame) -> DataFrame:
    """Soft delete: visible becomes false."""
    return objects.join(ids.select("id", F.lit(True).alias("_h")).distinct(), "id", "left").withColumn("visible", F.when(F.col("_h"), F.lit(False)).otherwise(F.col("visible"))).drop("_h")


def removed(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id"), "id", "left_anti")


def with_sizes(projects: DataFrame, files: DataFrame) -> DataFrame:
    """Adds size_bytes, the length of the project's scene file (null without one). files: (project_id, filename, length)."""
    s = files.where(F.col("filename") == SCENE).select(F.col("project_id").alias("id"), F.col("length").alias("size_bytes"))
    return projects.join(s, "id", "left")


def provenance(files: DataFrame) -> DataFrame:
    """Per project: the file that each pipeline stage produced (null without the stage) and the current stage."""
    has = {k: F.bool_or(F.col("filename") == n).alias(k) for k, n in (("raw", RAW), ("scene", SCENE), ("prune", PRE_PRUNE), ("refine", PRE_REFINE))}
    p = files.groupBy("project_id").agg(*has.values())
    cleanup = F.col("scene") & F.col("raw")
    return p.select(
        "project_id",
        F.when(F.col("raw"), RAW).alias("raw_file"),
        F.when(cleanup & F.col("prune"), PRE_PRUNE).when(cleanup & F.col("refine"), PRE_REFINE).when(cleanup, SCENE).alias("cleanup_file"),
        F.when(F.col("prune") & F.col("refine"), PRE_REFINE).when(F.col("prune"), SCENE).alias("prune_file"),
        F.when(F.col("refine"), SCENE).alias("refine_file"),
        F.when(F.col("refine"), "refine").when(F.col("prune"), "prune").when(cleanup, "cleanup").when(F.col("raw"), "raw").alias("current_stage"),
    )


def comparison_pairs(files: DataFrame) -> DataFrame:
    """(project_id, label, before, after) for each kept earlier version."""
    kinds = F.create_map(F.lit(PRE_PRUNE), F.lit("Pre-Prune"), F.lit(PRE_REFINE), F.lit("Pre-Refine"))
    return files.where(F.col("filename").isin(PRE_PRUNE, PRE_REFINE)).select("project_id", F.element_at(kinds, F.col("filename")).alias("label"), F.col("filename").alias("before"), F.lit(SCENE).alias("after"))
