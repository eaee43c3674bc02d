"""Queries that write scene tables in their file formats, into the shared folder, and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import edits, pixels, scene
from ..sources import colmap, layout, manifests, ply
from ..scratch import scratch_path
from .registry import query
from .scene import rounded


def folder(df: DataFrame) -> str:
    path = scratch_path(df.sparkSession, "files")
    fs, p = ply.filesystem(path)
    fs.create_dir(p, recursive=True)
    return path


def saved(g1: DataFrame) -> str:
    path = f"{folder(g1)}/scene.ply"
    ply.write_ply(g1.drop("segment_id"), path)
    return path


def laid_out(df: DataFrame) -> layout.Scene:
    path = scratch_path(df.sparkSession, "scene")
    layout.write_scene(df, path)
    return layout.Scene(df.sparkSession, path)


@query("f01_box_layout", ("g2",), "select gid, segment_id from g2 where x between 10 and 20 and y between 5 and 15 and z between 3 and 9 and not deleted")
def f01(g2):
    """The box query on a scene in Morton order: files, row groups and pages outside are skipped."""
    return laid_out(g2).box((10.0, 5.0, 3.0), (20.0, 15.0, 9.0)).select("gid", "segment_id")


@query("f02_sphere_layout", ("g2",), "select gid, segment_id from g2 where (x-25)*(x-25)+(y-20)*(y-20)+(z-6)*(z-6) <= 64 and not deleted")
def f02(g2):
    return laid_out(g2).sphere((25.0, 20.0, 6.0), 8.0).select("gid", "segment_id")


@query("s01_ply_scan", ("g1",), "select gid, round(x::float::double,5) x, round(scale_0::float::double,5) scale_0, deleted from g1")
def s01(g1):
    back = scene.mark_deleted(ply.read_ply(g1.sparkSession, saved(g1)))
    return back.select("gid", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in ("x", "scale_0")], "deleted")


@query("s02_positions_scan", ("g1",), "select count(*) n, sum(gid)::bigint total, round(sum(x::float::double),4) sx, round(sum(z::float::double),4) sz from g1")
def s02(g1):
    back = ply.read_ply(g1.sparkSession, saved(g1), ["x", "y", "z"])
    return back.agg(F.count(F.lit(1)).alias("n"), F.sum("gid").alias("total"), *[F.round(F.sum(F.col(c).cast("double")), 4).alias(f"s{c}") for c in "xz"])


@query("s03_ply_inventory", ("g1",), "select count(*) n_vertices, 'x,y,z' first_properties, 14 n_properties from g1")
def s03(g1):
    i = ply.ply_inventory(g1.sparkSession, [saved(g1)])
    return i.select("n_vertices", F.array_join(F.slice("properties", 1, 3), ",").alias("first_properties"), F.size("properties").alias("n_properties"))


@query("s04_ply_sink", ("g1",), "select gid, round((case when deleted then -100.0 else opacity end)::float::double,4) opacity from g1")
def s04(g1):
    return ply.read_ply(g1.sparkSession, saved(g1)).select("gid", F.round(F.col("opacity").cast("double"), 4).alias("opacity"))


@query("s06_positions_sidecar", ("g1",), "select gid, round(x::float::double,5) x, round(y::float::double,5) y, round(z::float::double,5) z from g1")
def s06(g1):
    path = f"{folder(g1)}/positions.bin"
    ply.write_positions(g1, path)
    rows, _ = ply.read_positions(g1.sparkSession, path)
    return rows.select("gid", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in "xyz"])


@query("s08_sfm_model", ("g1", "c1"), "select 'points' part, count(*) n, round(sum(x),5) total from g1 union all select 'cameras', count(*), round(sum(fx),5) from c1 union all select 'images', count(*) filter (where pos < 5), round(sum(case when pos < 5 then -(r02*t0+r12*t1+r22*t2) end),5) from c1")
def s08(g1, c1):
    path = folder(g1)
    colmap.write_model(path, c1, g1.select("gid", "x", "y", "z", *[F.lit(v).alias(n) for n, v in (("r", 0.2), ("g", 0.4), ("b", 1.0))]))
    cams, imgs, pts = colmap.read_model(g1.sparkSession, path, c1.where("pos < 5").select(F.col("frame").alias("filename")))
    one = lambda n, d, c: d.agg(F.lit(n).alias("part"), F.count(F.lit(1)).alias("n"), F.round(F.sum(c), 5).alias("total"))
    return one("points", pts, "x").union(one("cameras", cams, "fx")).union(one("images", imgs, "tz"))


@query("a17_normals_and_distortion", ("d1",), "select round(avg(1 - (r*gt_r+g*gt_g+b*gt_b)),6) normal_inconsistency, round(avg(alpha),6) distortion from d1")
def a17_normals(d1):
    names = {"r": "nx", "g": "ny", "b": "nz", "gt_r": "sx", "gt_g": "sy", "gt_b": "sz", "alpha": "distortion"}
    return rounded(pixels.surface_metrics(d1.withColumnsRenamed(names)), "normal_inconsistency", "distortion")


@query("s09_sfm_export", ("g1", "c1"), "select 'point' part, gid + 1 id, round(x,6) a, round(y,6) b, round(z,6) c, (gid % 256)::double d from g1 union all select 'image', pos + 1, round(-(r00*t0+r10*t1+r20*t2),6), round(-(r01*t0+r11*t1+r21*t2),6), round(-(r02*t0+r12*t1+r22*t2),6), fx from c1")
def s09(g1, c1):
    path = folder(g1)
    level = (F.col("gid") % 256) / 255.0
    colmap.write_model(path, c1, g1.select("gid", "x", "y", "z", level.alias("r"), F.lit(0.4).alias("g"), F.lit(1.0).alias("b")))
    cams, imgs, pts = colmap.read_model(g1.sparkSession, path)
    points = pts.select(F.lit("point").alias("part"), F.col("point_id").alias("id"), "x", "y", "z", F.round(F.col("r") * 255))
    images = imgs.join(cams, "camera_id").select(F.lit("image"), F.col("image_id").cast("long"), "tx", "ty", "tz", "fx")
    return rounded(points.union(images).toDF("part", "id", *"abcd"), *"abc")


@query("s12_benchmark_results", ("results",), "select method, dataset, scene, mean_psnr, mean_ssim, mean_lpips, training_time_sec, num_gaussians from results")
def s12(results):
    path = f"{folder(results)}/results"
    manifests.write_results(results.drop("is_published"), path)
    back = manifests.read_results(results.sparkSession, path, "*.json", a_file_each=False)
    return back.select("method", "dataset", "scene", "mean_psnr", "mean_ssim", "mean_lpips", "training_time_sec", "num_gaussians")


@query("s14_evaluation_files", ("results",), "select method, dataset, scene as name, mean_psnr psnr, mean_ssim ssim, mean_lpips lpips from results")
def s14(results):
    path = f"{folder(results)}/evaluation"
    per_view = results.select("method", "dataset", F.col("scene").alias("name"), *[F.col(f"mean_{m}").alias(m) for m in ("psnr", "ssim", "lpips")])
    manifests.write_evaluation(per_view, path, ["method", "dataset"])
    return manifests.read_evaluation(results.sparkSession, path, "method string, dataset string")


@query("s15_media_listing", ("f1",), "with a as (select case idx % 3 when 0 then 'clip_' || idx || '.MP4' when 1 then 'img ' || idx || '.jpeg' else 'notes ' || idx || '.txt' end filename, idx from f1) select filename, case idx % 3 when 0 then 'video' else 'photo' end kind, idx as number from a where idx % 3 < 2")
def s15(f1):
    n, i = F.col("idx") % 3, F.col("idx").cast("string")
    name = F.when(n == 0, F.concat(F.lit("clip_"), i, F.lit(".MP4"))).when(n == 1, F.concat(F.lit("img "), i, F.lit(".jpeg"))).otherwise(F.concat(F.lit("notes "), i, F.lit(".txt")))
    files = f1.select(F.concat(F.lit("media/"), name).alias("path"))
    return manifests.by_number(manifests.media_listing(files)).select("filename", "kind", manifests.first_number(F.col("filename")).alias("number"))


@query("e13_snapshots", ("g1",), "select 'restored' part, gid, round(opacity+1,6) opacity from g1 union all select 'original', gid, round(opacity,6) from g1 union all select 'listed', unnest([1,3]), null")
def e13(g1):
    kept = edits.Snapshots(g1.sparkSession, f"{folder(g1)}/undo")
    ids = [kept.save(g1.select("gid", (F.col("opacity") + n).alias("opacity")), f"brighter by {n}") for n in range(3)]
    restored = kept.restore(ids[1])
    parts = [("restored", restored), ("original", kept.original()), ("listed", kept.list().select(F.col("id").alias("gid"), F.lit(None).cast("double").alias("opacity")))]
    rows = [d.select(F.lit(n).alias("part"), "gid", "opacity") for n, d in parts]
    return rounded(rows[0].union(rows[1]).union(rows[2]), "opacity")
