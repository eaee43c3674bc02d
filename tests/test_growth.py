"""Work that must not grow with pairs, copies or keys; keys that aren't unique."""

import os

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F
from tests.conftest import same

from pointloom.operators import camera, frames, neighbours, spatial
from pointloom.scratch import shared_dir
from pointloom.sources import manifests
from pointloom.streaming import sessions


def scratch_bytes(spark):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(shared_dir(spark)) for f in files)


def points(spark, p, opacity):
    rows = [(i, *map(float, q), o) for i, (q, o) in enumerate(zip(p, opacity, strict=True))]
    return spark.createDataFrame(rows, "gid long, x double, y double, z double, opacity double").repartition(4)


def test_deduplicate_over_leaves(spark):
    """Chains through many leaves, copies, an outlier, opacities that are equal, missing or no numbers: the greedy walk's rows."""
    r = np.random.default_rng(3)
    p = np.concatenate([r.normal(size=(500, 3)), np.repeat(r.normal(size=(20, 3)), 5, axis=0), [[i * 0.05, 9.0, 9.0] for i in range(60)], [[1e6, 0, 0]]])
    o = [None if i % 50 == 7 else float("nan") if i % 50 == 9 else float(v) for i, v in enumerate(r.integers(0, 4, len(p)))]
    order = sorted(range(len(p)), key=lambda i: (-(0 if o[i] is None else 2 if o[i] != o[i] else 1), -(o[i] if o[i] is not None and o[i] == o[i] else 0), i))
    want = []
    for i in order:
        if not want or ((p[want] - p[i]) ** 2).sum(axis=1).min() > 0.2 * 0.2:
            want.append(i)
    df = points(spark, p, o)
    for capacity in (15, 100, None):
        assert sorted(x["gid"] for x in spatial.deduplicate(df, 0.2, capacity).collect()) == sorted(want)


def test_deduplicate_writes_no_table_of_pairs(spark):
    """3000 rows within the distance of each other, 4.5 million pairs."""
    r = np.random.default_rng(4)
    df = points(spark, r.uniform(0, 0.01, (3000, 3)), r.uniform(size=3000).tolist())
    before = scratch_bytes(spark)
    assert spatial.deduplicate(df, 0.1).count() == 1
    assert scratch_bytes(spark) - before < 1_000_000


def test_view_sums_are_those_of_the_projection(spark, monkeypatch):
    """Many cameras, some that see nothing, one without a pose, in small blocks; no pair of a row and a camera is made a row."""
    r = np.random.default_rng(4)
    df = points(spark, r.uniform(-10, 10, (900, 3)), [0.5] * 900).unionByName(spark.createDataFrame([(900, None, 0.0, 0.0, 0.5), (901, float("nan"), 0.0, 0.0, 0.5)], "gid long, x double, y double, z double, opacity double"))
    cams = [(c, *map(float, np.linalg.qr(r.normal(size=(3, 3)))[0].ravel()), *map(float, r.uniform(-9, 9, 3)), 45.0, 42.0, 32.0, 30.0, 64, 64) for c in range(60)]
    cams += [(60, *cams[0][1:10], 1e5, 1e5, 1e5, *cams[0][13:]), (61, None, *cams[0][2:])]
    schema = ", ".join(["pos int", *[f"r{i}{j} double" for i in range(3) for j in range(3)], *[f"t{i} double" for i in range(3)], "fx double, fy double, cx double, cy double, width int, height int"])
    cams = spark.createDataFrame(cams, schema)
    monkeypatch.setattr(camera, "BLOCK_ROWS", 64)
    monkeypatch.setattr(camera, "BLOCK_CAMERAS", 10)
    for own in ((), (64.0, 45.0)):
        seen = camera.project(df, cams, *own).groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("u"), F.sum("depth").alias("depth"))
        want = {x["pos"]: x for x in seen.collect()}
        got = {x["pos"]: x for x in camera.view_sums(df, cams, *own).collect()}
        assert got.keys() == want.keys() and 30 < len(got) < 61
        for pos, x in want.items():
            assert got[pos]["n"] == x["n"] and np.isclose(got[pos]["u"], x["u"], rtol=1e-12) and np.isclose(got[pos]["depth"], x["depth"], rtol=1e-12)


def test_one_file_name_of_two_frames(spark):
    """Frame numbers over 99999 are cut to five digits, so names repeat: each row has its own patch, none is doubled or lost."""
    f1 = spark.createDataFrame([(i, n) for i, n in enumerate(["a", "a", "b", "b", "c"])], "idx long, filename string").withColumn("selected", F.lit(False))
    patch = f1.where("idx in (1, 2, 3)").select("idx", "filename", F.lit(True).alias("selected"))
    got = frames.update_selection(f1, patch, ["idx"])
    assert sorted(tuple(x) for x in got.select("idx", "filename", "selected").collect()) == [(0, "a", False), (1, "a", True), (2, "b", True), (3, "b", True), (4, "c", False)]
    some = f1.where("idx in (1, 3)").select("idx", "filename", F.lit(9.0).alias("sharpness"), "selected")
    all_ = manifests.with_missing_frames(some, f1, ["idx", "filename"])
    assert sorted((x["idx"], x["filename"], x["sharpness"]) for x in all_.collect()) == [(0, "a", 0.0), (1, "a", 9.0), (2, "b", 0.0), (3, "b", 9.0), (4, "c", 0.0)]


def test_frame_queries_past_five_digits(spark, duck, tmp_path):
    from pointloom.plans import QUERIES, SQL

    e = spark.createDataFrame([(i, 1, float(i * 37 % 100)) for i in [*range(9990, 10020), *range(99990, 100200)]], "event_id long, user_id long, value double")
    e.write.parquet(f"{tmp_path}/events.parquet")
    for name in ("f12_update_selection", "s11_missing_frames"):
        same(QUERIES[name](spark, str(tmp_path)), duck.sql(SQL[name].replace("from events", f"from '{tmp_path}/events.parquet/*.parquet'")))


def test_nearest_of_copies_without_a_search(spark, monkeypatch):
    """Rows that share a place aren't searched for; equal rows, one gid at two places and outliers too have brute force's answer."""
    r = np.random.default_rng(6)
    p = np.concatenate([r.normal(size=(300, 3)), np.repeat(r.normal(size=(40, 3)), 6, axis=0), [[1e6, 0.0, 0.0], [-0.0, 5.0, 5.0], [0.0, 5.0, 5.0]]])
    gid = r.permutation(len(p)).tolist()
    rows = [(g, *map(float, q)) for g, q in zip(gid, p, strict=True)]
    rows += [rows[0], rows[310], (rows[5][0], 3.0, 3.0, 3.0), (9999, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "gid long, x double, y double, z double").repartition(3)
    met, asked = neighbours._met, []
    monkeypatch.setattr(neighbours, "_met", lambda points, queries, *rest: asked.append(queries.count()) or met(points, queries, *rest))
    for capacity in (20, None):
        got = {x["gid"]: (x["other"], x["d"]) for x in spatial.nn_distance(df, capacity).collect()}
        ids, at = np.array([x[0] for x in rows[:-1]]), np.array([x[1:] for x in rows[:-1]])
        assert got.keys() == set(ids.tolist())
        for g, (other, dist) in got.items():
            d2 = np.where(ids[None] == g, np.inf, ((at[ids == g][:, None] - at[None]) ** 2).sum(axis=2))
            best = d2.min()
            assert dist == np.sqrt(best) and other == min(ids[(d2 == best).any(axis=0)])
    assert max(asked) <= 305


def test_a_run_reads_and_writes_its_state_once_a_batch():
    """Steps in small batches, in any order, some without loss or evaluation: what telemetry_step gives, with one read and one write each."""

    class Value:
        held, calls = None, 0

        def getValueState(self, *_):
            return self

        def get(self):
            self.calls += 1
            return self.held

        def update(self, new):
            self.calls += 1
            self.held = new

    value, made = Value(), sessions.Telemetry(["run_id", "seq", "diverged", "stop", "best"], 6)
    made.init(value)
    r = np.random.default_rng(2)
    rows = [Row(run_id=5, seq=i, loss=float(r.uniform(0, 9)), psnr=None if i < 4 or i % 5 == 0 else float(r.uniform(20, 30))) for i in range(60)]
    state, want, got, batches = {}, [], [], 0
    for x in rows:
        state, flags = sessions.telemetry_step(state, x["loss"], x["psnr"], 6)
        want.append((5, x["seq"], flags["diverged"], flags["stop"], flags["best"]))
    for at in range(0, 60, 4):
        got += [tuple(x) for x in made.handleInputRows((5,), iter(rows[at : at + 4][::-1]), None)]
        batches += 1
    assert got == want and any(x[2] for x in want) and any(x[3] for x in want)
    assert value.calls == 2 * batches
