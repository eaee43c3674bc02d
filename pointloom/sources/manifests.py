"""JSON documents as tables: cameras, segment and frame manifests, benchmark results, media listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CAMERAS = "resolution int, focal_length_px double, cameras array<struct<frame:string,transform:array<array<double>>,width:int,height:int,fx:double,fy:double,cx:double,cy:double>>"
SEGMENTS = "primary_frame string, segments array<struct<id:int,label:string,area:bigint,bbox:array<int>,confidence:double,color:array<int>,visible:boolean,gaussian_ids:array<bigint>>>"
RESULTS = "method string, dataset string, scene string, training_time_sec double, num_gaussians bigint, metrics struct<mean_psnr:double,mean_ssim:double,mean_lpips:double>, config map<string,string>, mean_psnr double, mean_ssim double, mean_lpips double, per_view array<struct<name:string,psnr:double,ssim:double,lpips:double>>, _corrupt_record string"
FRAMES = "frames array<struct<filename:string,source_file:string,source_type:string,sharpness:double,selected:boolean>>"
RESOLUTION, FOCAL_SHARE = 448, 0.85
#: The extensions of each media type.
VIDEO, PHOTO = ("mp4", "mov", "avi", "mkv", "webm"), ("jpg", "jpeg", "png", "webp", "heic", "bmp", "tiff")


def flat_cameras(doc: DataFrame) -> DataFrame:
    """Rows (pos, frame, r00..r22, t0..t2, fx, fy, cx, cy, width, height) of a document with cameras[].

    Intrinsics a camera lacks come from the document: resolution 448, focal length .85 of it, centre in the middle.
    """
    names = doc.schema["cameras"].dataType.elementType.fieldNames()
    get = lambda c, d: F.coalesce(F.col(f"c.{c}"), d) if c in names else d
    res = F.coalesce(F.col("resolution"), F.lit(RESOLUTION)) if "resolution" in doc.columns else F.lit(RESOLUTION)
    focal = F.coalesce(F.col("focal_length_px"), res * FOCAL_SHARE) if "focal_length_px" in doc.columns else res * FOCAL_SHARE
    d = doc.withColumns({"_res": res, "_focal": focal}).select("_res", "_focal", F.posexplode("cameras").alias("pos", "c"))
    at = lambda i, j: F.element_at(F.element_at("c.transform", i + 1), j + 1)
    fx = get("fx", F.col("_focal"))
    return d.select(
        get("pos", F.col("pos")).cast("int").alias("pos"),
        F.col("c.frame").alias("frame"),
        *[at(i, j).alias(f"r{i}{j}") for i in range(3) for j in range(3)],
        *[at(i, 3).alias(f"t{i}") for i in range(3)],
        fx.cast("double").alias("fx"),
        get("fy", fx).cast("double").alias("fy"),
        get("cx", F.col("_res") / 2).cast("double").alias("cx"),
        get("cy", F.col("_res") / 2).cast("double").alias("cy"),
        get("width", F.col("_res")).cast("int").alias("width"),
        get("height", F.col("_res")).cast("int").alias("height"),
    )


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    return flat_cameras(spark.read.schema(CAMERAS).json(path, multiLine=True))


def read_segments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(segments, members)."""
    s = spark.read.schema(SEGMENTS).json(path, multiLine=True).select("primary_frame", F.posexplode("segments").alias("pos", "s"))
    seg = s.select(F.col("s.id").alias("segment_id"), "pos", "s.label", "s.area", "s.bbox", "s.confidence", "primary_frame", "s.color", F.coalesce("s.visible", F.lit(True)).alias("visible"))
    return seg, s.select(F.col("s.id").alias("segment_id"), F.explode("s.gaussian_ids").alias("gid"))


def write_segments(segments: DataFrame, members: DataFrame, path: str) -> None:
    """One JSON row per segment with its ids nested; the long table is what is kept for work."""
    ids = members.groupBy("segment_id").agg(F.sort_array(F.collect_list("gid")).alias("gaussian_ids"))
    out = segments.join(ids, "segment_id", "left").withColumn("gaussian_ids", F.coalesce("gaussian_ids", F.array().cast("array<bigint>")))
    out.withColumnRenamed("segment_id", "id").write.mode("overwrite").json(path)


def with_missing_frames(manifest: DataFrame, listing: DataFrame, keys: Sequence[str] = ("filename",)) -> DataFrame:
    """Manifest rows, and a default row (sharpness 0, selected) for each listed file that it lacks. The keys (in both, filename among them) name one row."""
    rest = listing.select(*keys).join(manifest.select(*keys), list(keys), "left_anti")
    return manifest.unionByName(rest.select(*keys, F.lit(0.0).alias("sharpness"), F.lit(True).alias("selected")), allowMissingColumns=True)


def write_results(results: DataFrame, path: str) -> None:
    """One JSON row per result, its means nested under metrics; read back with files="*.json" and a document per line."""
    means = [c for c in ("mean_psnr", "mean_ssim", "mean_lpips") if c in results.columns]
    rest = [c for c in results.columns if c not in means]
    results.select(*rest, F.struct(*means).alias("metrics")).write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str, files: str = "results.json", a_file_each: bool = True) -> DataFrame:
    """All results.json below a path; unreadable files are left out, absent names are "unknown".

    Means are taken from metrics, or from the top level where it lacks them.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", files).text(path, wholetext=a_file_each)
    raw = raw.select(F.from_json("value", RESULTS, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("d")).where("d is not null").select("d.*")
    good = raw.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    means = {c: F.coalesce(F.col(f"metrics.{c}"), F.col(c)) for c in ("mean_psnr", "mean_ssim", "mean_lpips")}
    return good.withColumns({c: F.coalesce(c, F.lit("unknown")) for c in ("method", "dataset", "scene")} | means).drop("metrics")


def normal_metrics(raw: DataFrame, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """One column per metric: the first key that is there and not null, of keys in different spellings."""
    have = set(raw.columns)
    rest = [c for c in raw.columns if not any(c in keys for keys in names.values())]
    cols = [F.coalesce(*[F.col(f"`{k}`") for k in keys if k in have]).alias(n) if have & set(keys) else F.lit(None).cast("double").alias(n) for n, keys in names.items()]
    return raw.select(*rest, *cols)


def first_candidate(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Per key the row of the first candidate file."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")


def write_evaluation(per_view: DataFrame, path: str, keys: list[str]) -> None:
    per_view.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("name", "psnr", "ssim", "lpips"))).alias("per_view")).write.mode("overwrite").json(path)


def read_evaluation(spark: SparkSession, path: str, keys: str) -> DataFrame:
    d = spark.read.schema(f"{keys}, per_view array<struct<name:string,psnr:double,ssim:double,lpips:double>>").json(path)
    return d.select("*", F.explode("per_view").alias("p")).select(*[c for c in d.columns if c != "per_view"], "p.*")


def media_type(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.when(ext.isin(*VIDEO), "video").when(ext.isin(*PHOTO), "photo").otherwise("other")


def list_media(spark: SparkSession, path: str) -> DataFrame:
    """(path, filename, kind, length, modified): videos, then photos, by name; contents aren't read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return media_listing(f.select("path", "length", F.col("modificationTime").alias("modified")))


def media_listing(files: DataFrame) -> DataFrame:
    """files (path, ...) with filename and kind: videos, then photos, by name; others are left out."""
    f = files.withColumn("filename", F.regexp_extract("path", r"([^/]+)$", 1))
    return f.withColumn("kind", media_type(F.col("filename"))).where("kind <> 'other'").orderBy(F.desc("kind"), "filename")


def first_number(name: Column) -> Column:
    """The first number in a name, or 0."""
    return F.coalesce(F.regexp_extract(name, r"(\d+)", 1).try_cast("long"), F.lit(0))


def by_number(files: DataFrame) -> DataFrame:
    """Files in the order of the first number in their names."""
    return files.orderBy(first_number(F.col("filename")), "filename")
