"""Invariants, brute force and round trips for what SQL can't check."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import edits, scene, segments, spatial
from pointloom.plans.registry import table
from pointloom.sources import manifests
from pointloom.streaming import sessions


def cloud(spark, n=300, seed=1, twins=True):
    r = random.Random(seed)
    rows = [(i, r.uniform(-1, 1), r.uniform(-1, 1), r.uniform(-1, 1), r.uniform(-4, 4)) for i in range(n)]
    if twins:  # duplicates and collinear points
        rows += [(n + i, *rows[i][1:4], r.uniform(-4, 4)) for i in range(20)] + [(n + 20 + i, i * 0.1, 0.0, 0.0, 0.0) for i in range(10)]
    return spark.createDataFrame(rows, "gid long, x double, y double, z double, opacity double"), rows


def d(a, b):
    return sum((p - q) ** 2 for p, q in zip(a[1:4], b[1:4])) ** 0.5


@pytest.mark.parametrize("capacity", [2, 30, None])
def test_knn_is_exact_for_any_size_of_leaves(spark, capacity):
    df, rows = cloud(spark, 120)
    got = {(r["gid"], r["rank"]): (round(r["d"], 9), r["other"]) for r in spatial.knn_join(df, df, 3, exclude_self=True, capacity=capacity).collect()}
    for a in rows:
        best = sorted((round(d(a, b), 9), b[0]) for b in rows if b[0] != a[0])[:3]
        assert [got[a[0], k][0] for k in (1, 2, 3)] == [x[0] for x in best]
        near = next(b for b in rows if b[0] == got[a[0], 1][1])
        assert round(d(a, near), 9) == best[0][0]


def test_radius_join_and_pairs(spark):
    df, rows = cloud(spark, 150)
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and d(a, b) <= 0.25}
    assert {(r["a_gid"], r["b_gid"]) for r in spatial.close_pairs(df, 0.25).collect()} == want
    both = {(r["a_gid"], r["b_gid"]) for r in spatial.radius_join(df, df, 0.25).collect()}
    assert both == want | {(b, a) for a, b in want} | {(r[0], r[0]) for r in rows}


def test_deduplicate_keeps_the_opaque_ones_apart(spark):
    df, rows = cloud(spark, 200)
    kept = {r["gid"] for r in spatial.deduplicate(df, 0.2).collect()}
    by = {r[0]: r for r in rows}
    order = sorted(rows, key=lambda r: (-r[4], r[0]))
    want = []
    for r in order:
        if all(d(r, k) > 0.2 for k in want):
            want.append(r)
    assert kept == {r[0] for r in want} and all(by[g] for g in kept)


def test_empty_clouds(spark):
    df, _ = cloud(spark, 3, twins=False)
    none = df.where("false")
    assert spatial.nearest_join(none, df).count() == 0 and spatial.nearest_join(df, none).count() == 0
    assert spatial.deduplicate(none).count() == 0


def test_sample_is_repeatable(spark, sf):
    g = table(spark, sf, "g1")
    a = {r["gid"] for r in scene.repeatable_sample(g, 50, 3).collect()}
    assert a == {r["gid"] for r in scene.repeatable_sample(g.repartition(7), 50, 3).collect()} and len(a) == 50


def test_split_covers_the_segment(spark, sf):
    g, m = table(spark, sf, "g1"), table(spark, sf, "members")
    out = segments.split(g, m, 3, 4)
    assert out.count() == m.count() and out.select("gid").distinct().count() == m.count()
    assert out.where("segment_id = 3").count() == 0


def test_scale_of_zero_or_less_leaves_log_scales(spark, sf):
    g = table(spark, sf, "g1")
    r = segments.transform(g, F.lit(True), scale=(-1.0, 1.0, 1.0)).join(g.select("gid", F.col("scale_0").alias("s")), "gid")
    assert r.where("scale_0 <> s").count() == 0


def test_unknown_attribute_is_an_error(spark, sf):
    with pytest.raises(ValueError):
        segments.set_attribute(table(spark, sf, "g1"), "nothing", spark.createDataFrame([], "gid long, value double"))


def test_cursor():
    c = edits.Cursor()
    for i in range(1, 61):
        c = c.did(i)
    for _ in range(70):
        c = c.undone()
    assert c.active == list(range(1, 11)) and len(c.redo) == 50
    assert c.redone().active[-1] == 11 and c.redone().did(99).redo == []


def test_snapshots(spark, sf, tmp_path):
    g = table(spark, sf, "g1").select("gid", "opacity")
    s = edits.Snapshots(spark, str(tmp_path / "undo"))
    one, two = s.save(g, "one"), s.save(g.withColumn("opacity", F.lit(1.0)), "two")
    assert [r["id"] for r in s.list().collect()] == [two, one]
    assert s.restore(two).where("opacity <> 1.0").count() == 0
    assert [r["id"] for r in s.list().collect()] == [one] and s.original().count() == g.count()
    with pytest.raises(KeyError):
        s.restore(two)
    assert s.expired(0).count() == 1


def test_ply_round_trip(spark, sf, tmp_path):
    from pointloom.sources import ply

    g = table(spark, sf, "g1")
    path = str(tmp_path / "scene.ply")
    ply.write_ply(g.drop("segment_id"), path)
    back = ply.read_ply(spark, path)
    assert back.count() == g.count() and "deleted" not in back.columns
    a = {r["gid"]: r for r in g.collect()}
    for r in scene.mark_deleted(back).collect():
        o = a[r["gid"]]
        assert r["deleted"] == o["deleted"] and abs(r["x"] - o["x"]) < 1e-6
    small = ply.read_ply(spark, path, ["x", "z"])
    assert small.columns == ["gid", "x", "z"]
    inv = ply.ply_inventory(spark, [path]).first()
    assert inv["n_vertices"] == g.count() and inv["properties"][:3] == ["x", "y", "z"] and ply.sh_degree(back) == 0
    many = spark.read.format("ply").option("path", path).option("rangeBytes", "3000").load()
    assert many.rdd.getNumPartitions() > 3 and many.agg(F.sum("gid")).first()[0] == g.agg(F.sum("gid")).first()[0]


def test_positions_round_trip(spark, sf, tmp_path):
    from pointloom.sources import ply

    g = table(spark, sf, "g1")
    ply.write_positions(g, str(tmp_path / "positions.bin"))
    back, head = ply.read_positions(spark, str(tmp_path / "positions.bin"))
    assert head["n"] == g.count() == back.count() and head["radius"] > 0
    assert back.join(g.select("gid", F.col("y").alias("o")), "gid").where("abs(y - o) > 1e-6").count() == 0


def test_model_round_trip(spark, sf, tmp_path):
    from pointloom.sources import colmap

    c, g = table(spark, sf, "c1"), table(spark, sf, "g1")
    pts = g.select("gid", "x", "y", "z", *[F.lit(v).alias(n) for n, v in (("r", 0.2), ("g", 0.4), ("b", 1.0))])
    colmap.write_model(str(tmp_path), c, pts)
    cams, imgs, points = colmap.read_model(spark, str(tmp_path), spark.createDataFrame([("frame_00001.jpg",), ("frame_00003.jpg",)], "filename string"))
    assert cams.count() == c.count() and imgs.count() == 2 and points.count() == g.count()
    r = imgs.where("name = 'frame_00003.jpg'").first()
    assert abs(r["qw"] ** 2 + r["qx"] ** 2 + r["qy"] ** 2 + r["qz"] ** 2 - 1) < 1e-9 and abs(points.first()["b"] - 1) < 1e-9


def test_manifests(spark, sf, tmp_path):
    import json

    from pointloom.sources import manifests as m

    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a/results.json").write_text(json.dumps({"method": "x", "mean_psnr": 30.5}))
    (tmp_path / "b/results.json").write_text("{broken")
    (tmp_path / "c").mkdir()
    nested = {"method": "y", "scene": "s", "metrics": {"mean_psnr": 27.25, "mean_ssim": 0.9}, "config": {"iterations": 7000}, "per_view": [{"name": "v", "psnr": 27.25}]}
    (tmp_path / "c/results.json").write_text(json.dumps(nested, indent=1))
    r = sorted(m.read_results(spark, str(tmp_path)).collect(), key=lambda x: x["method"])
    assert r[1]["mean_psnr"] == 27.25 and r[1]["mean_ssim"] == 0.9 and r[1]["mean_lpips"] is None and r[1]["config"] == {"iterations": "7000"} and r[1]["per_view"][0]["psnr"] == 27.25
    r = r[:1]
    assert len(r) == 1 and r[0]["scene"] == "unknown" and r[0]["mean_psnr"] == 30.5
    doc = {"resolution": 100, "cameras": [{"frame": "f.jpg", "transform": [[1, 0, 0, 5], [0, 1, 0, 6], [0, 0, 1, 7], [0, 0, 0, 1]]}]}
    (tmp_path / "cameras.json").write_text(json.dumps(doc))
    c = m.read_cameras(spark, str(tmp_path / "cameras.json")).first()
    assert (c["fx"], c["fy"], c["cx"], c["t1"], c["width"]) == (85.0, 85.0, 50.0, 6.0, 100)
    seg, mem = table(spark, sf, "m1"), table(spark, sf, "members")
    m.write_segments(seg.select("segment_id", "label", "area", "visible"), mem, str(tmp_path / "manifest"))
    back = spark.read.json(str(tmp_path / "manifest"))
    assert back.select(F.explode("gaussian_ids")).count() == mem.count()
    per = spark.createDataFrame([("s", "v1", 30.0, 0.9, 0.1), ("s", "v2", 31.0, 0.8, 0.2)], "scene string, name string, psnr double, ssim double, lpips double")
    m.write_evaluation(per, str(tmp_path / "eval"), ["scene"])
    assert sorted(map(tuple, m.read_evaluation(spark, str(tmp_path / "eval"), "scene string").collect())) == sorted(map(tuple, per.collect()))
    assert [r["kind"] for r in m.list_media(spark, str(tmp_path)).collect()] == []


def test_locks_replay(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "v1").select("project_id", "seq", "user_id", "type", "segment_id").orderBy("seq").collect()]
    held, want = {}, []
    for p, seq, user, kind, seg in rows:
        mine = held.setdefault(p, {})
        if kind == "transform_start" and seg not in mine:
            mine[seg] = user
            want.append((p, seq, "locked", seg, user))
        elif kind == "transform_end" and mine.get(seg) == user:
            del mine[seg]
            want.append((p, seq, "unlocked", seg, user))
        elif kind == "disconnect":
            for s in sorted(s for s, u in mine.items() if u == user):
                del mine[s]
                want.append((p, seq, "unlocked", s, user))
    from pointloom.plans import QUERIES

    assert sorted(tuple(r) for r in QUERIES["t08_segment_locks"](spark, sf).collect()) == sorted(want)


def test_session_steps():
    state, got = {}, []
    for kind in ["frame", "frame", "ping", "frame", "frame", "frame", "start", "frame", "stop", "frame"]:
        state, out = sessions.session_step(state, kind)
        if out:
            got.append((out["n_frames"], out["phase"], out["export"]))
    assert got == [(1, "accumulating", False), (2, "accumulating", False), (3, "initializing", True), (4, "refining", False), (5, "refining", True), (1, "accumulating", False), (1, "accumulating", False)]


def test_listing_order_and_numbers(spark):
    files = spark.createDataFrame([(f"d/{n}",) for n in ("b10.JPG", "z.mp4", "b9.png", "a.MOV", "x.txt", "none.webp")], "path string")
    got = manifests.media_listing(files)
    assert [r["filename"] for r in got.collect()] == ["a.MOV", "z.mp4", "b10.JPG", "b9.png", "none.webp"]
    assert [r["filename"] for r in manifests.by_number(got.where("kind = 'photo'")).collect()] == ["none.webp", "b9.png", "b10.JPG"]


def test_state_over_several_batches(spark, sf, tmp_path):
    """The same frames whether the messages come in one micro-batch or in five, through restarts of the stream."""
    from pointloom.plans.streams import controls

    events = spark.read.parquet(f"{sf}/events.parquet")
    lo, hi = events.agg({"event_id": "min"}).first()[0], events.agg({"event_id": "max"}).first()[0] + 1
    cuts = [lo + (hi - lo) * i // 5 for i in range(6)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        events.where(f"event_id >= {a} and event_id < {b}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    one = sessions.drained(sessions.ingest(controls(sessions.event_stream(spark, sf))))
    split = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    several = sessions.drained(sessions.ingest(controls(split)))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(one) == key(several) and len(several.inputFiles()) > 5


@pytest.mark.parametrize("most", [1, 50, 10_000])
def test_exact_percentiles_by_brackets(spark, most):
    """Narrowed brackets give the percentiles of all rows, with ties, nulls, two values only and outliers."""
    rng = np.random.default_rng(5)
    rows = [(float(rng.normal()), float(rng.integers(0, 2)), None if i % 3 else float(i) ** 4) for i in range(4000)]
    df = spark.createDataFrame(rows, "x double, y double, z double").repartition(4)
    got = scene.robust_bounds(df, 0.0, most=most).first()
    for j, axis in enumerate("xyz"):
        known = [r[j] for r in rows if r[j] is not None]
        assert got[f"low_{axis}"] == pytest.approx(np.quantile(known, 0.02))
        assert got[f"high_{axis}"] == pytest.approx(np.quantile(known, 0.98))
    none = scene.robust_bounds(df.limit(0), most=most).first()
    assert none["low_x"] is None


def test_nearest_with_far_outliers(spark):
    """Each query finds its true neighbours, also from far outside a dense cloud and among equal points."""
    rng = np.random.default_rng(6)
    at = np.concatenate([rng.normal(size=(150, 3)), rng.normal(size=(6, 3)) * 5000, np.ones((9, 3))])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "gid long, x double, y double, z double")
    for k, capacity in ((1, None), (3, None), (1, 20), (3, 7)):
        got = {(r["gid"], r["rank"]): r["other"] for r in spatial.knn_join(df, df, k, exclude_self=True, capacity=capacity).collect()}
        assert len(got) == k * len(at)
        for i, p in enumerate(at):
            near = sorted((float(((p - q) ** 2).sum()), j) for j, q in enumerate(at) if j != i)
            for r in range(k):
                j = got[i, r + 1]
                assert ((p - at[j]) ** 2).sum() == pytest.approx(near[r][0], rel=1e-9) and (k > 1 or near[r][0] > 0 or j == near[r][1])
