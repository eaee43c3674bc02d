"""Leaves and the searches in them: clustered clouds with a far outlier, bounded sizes, brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import morton
from pointloom.operators import leaves, neighbours


def clustered(n=3000, seed=1):
    """A wide cloud, a cluster a millionth as wide, equal points, and an outlier."""
    r = np.random.default_rng(seed)
    wide, dense = r.normal(size=(n // 2, 3)) * 10, 3 + r.normal(size=(n // 3, 3)) * 1e-5
    twins = np.repeat(r.normal(size=(5, 3)), 20, axis=0)
    return np.concatenate([wide, dense, twins, [[1e6, -1e6, 1e6]]])


def table(spark, p, first=0):
    return spark.createDataFrame([(i + first, *map(float, q)) for i, q in enumerate(p)], "gid long, x double, y double, z double").repartition(4)


def test_leaves_hold_about_their_capacity(spark):
    p = clustered()
    got = leaves.leaves_of(table(spark, p), 100)
    assert got.counts.sum() == len(p) and (np.diff(got.starts) > 0).all()
    assert got.counts.max() <= 100 and len(got.counts) <= 6 * len(p) / 100
    of = got.of(p)
    assert (np.bincount(of, minlength=len(got.counts)) == got.counts).all()
    for leaf in range(len(got.counts)):
        mine = p[of == leaf]
        assert (got.boxes[leaf] == np.stack([mine.min(axis=0), mine.max(axis=0)])).all()
    placed = leaves.with_leaf(table(spark, p), got).collect()
    assert [r["leaf"] for r in sorted(placed)] == of.tolist()


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_of_other_points(spark, k):
    """Queries inside and far outside; with many queries in one leaf, which is dealt out in chunks."""
    p, r = clustered(900), np.random.default_rng(5)
    q = np.concatenate([p[::7] + 1e-3, r.normal(size=(40, 3)) * 1e4, np.repeat([[5e5, 0.0, 0.0]], 300, axis=0)])
    out = neighbours.knn_join(table(spark, q), table(spark, p), k, capacity=60).collect()
    assert len(out) == k * len(q)
    got = {(o["gid"], o["rank"]): (o["other"], o["d"]) for o in out}
    for i, at in enumerate(q):
        d = np.sqrt(((p - at) ** 2).sum(axis=1))
        want = np.sort(d)[:k]
        assert np.allclose([got[i, j + 1][1] for j in range(k)], want, rtol=1e-12)
        assert all(np.isclose(d[got[i, j + 1][0]], want[j], rtol=1e-12) for j in range(k))


def test_pairs_within_a_radius(spark):
    p = clustered(600)
    for r in (1e-5, 0.8):
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
        want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(d <= r, 1)), strict=True)}
        got = [(x["gid"], x["other"]) for x in neighbours.close_pairs(table(spark, p), r, capacity=50).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        some = neighbours.radius_join(table(spark, p[:50], 1000), table(spark, p), r, capacity=50).collect()
        assert {(x["gid"] - 1000, x["other"]) for x in some} == {(int(a), int(b)) for a, b in zip(*np.nonzero(d[:50] <= r), strict=True)}


def test_coordinates_that_are_no_numbers(spark):
    rows = [(1, 0.0, 0.0, 0.0), (2, None, 0.0, 0.0), (3, float("nan"), 1.0, 1.0), (4, float("inf"), 1.0, 1.0), (5, 1.0, 1.0, 1.0), (5, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "gid long, x double, y double, z double")
    assert {(r["gid"], r["other"]) for r in neighbours.knn_join(df, df, 1, exclude_self=True).collect()} == {(1, 5), (5, 1)}


def test_morton_keys(spark):
    """Interleaved bits, by the definition; what lies outside is in the first or last cell."""
    rows = [(0.0, 0.0, 0.0), (3.5, 1.0, 2.9), (-9.0, 99.0, 4.0)]
    df = spark.createDataFrame(rows, "x double, y double, z double").select(morton.morton(("x", "y", "z"), (0.0,) * 3, (4.0,) * 3, bits=2).alias("k"))
    cells = [(0, 0, 0), (3, 1, 2), (0, 3, 3)]
    want = [sum(((c >> b) & 1) << (3 * b + 2 - i) for i, c in enumerate(cs) for b in range(2)) for cs in cells]
    assert [r["k"] for r in df.collect()] == want
    assert spark.range(1).select(morton.cell(morton.F.lit(5.0), 5.0, 5.0), morton.cell(morton.F.lit(6.0), 5.0, 5.0)).first()[:] == (0, (1 << 21) - 1)


def test_the_large_cloud_query_against_brute_force(spark, sf):
    from pointloom.plans import QUERIES
    from pointloom.plans.registry import table as given

    rows = given(spark, sf, "g2").select("gid", "x", "y", "z").collect()
    p = np.array([r[1:] for r in rows])
    got = {r["gid"]: r["d"] for r in QUERIES["j02_large_cloud"](spark, sf).collect()}
    assert len(got) == len(rows)
    for i in range(0, len(rows), 50):
        d = np.sqrt(((p - p[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        assert got[rows[i]["gid"]] == pytest.approx(d.min(), abs=2e-6)


def test_what_a_radius_search_sends_goes_with_the_rows(spark):
    """Eight times the rows at the same places: scratch tables hold each row once, and no more copies a row are sent than before."""
    from pathlib import Path

    from pointloom import scratch

    p = np.random.default_rng(5).random((600, 3)) * 4
    folder, copies = Path(scratch.shared_dir(spark).removeprefix("file:")), []
    for k in (1, 8):
        rows, before = np.tile(p, (k, 1)), set(folder.glob("*-*"))
        got = neighbours.close_pairs(table(spark, rows), 0.5, capacity=20).select("gid", "other").collect()
        near = ((rows[:, None] - rows[None]) ** 2).sum(axis=2) <= 0.25
        assert sorted(map(tuple, got)) == [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)]
        tables = [x for x in set(folder.glob("*-*")) - before if any(x.glob("*.parquet"))]
        assert sum(spark.read.parquet(str(x)).count() for x in tables) == len(rows)
        leaves = neighbours.leaves_of(table(spark, rows), 20 * k, halved=True)
        sent = neighbours._in_units(table(spark, rows), leaves, 0.5)
        copies.append(sent.selectExpr("sum(size(gid)) n").first()["n"] / len(rows))
    assert copies[1] <= 1.2 * copies[0]


def test_rows_of_one_place_meet_in_units_of_bounded_size(spark):
    p = np.vstack([np.zeros((400, 3)), np.full((300, 3), 0.1), np.random.default_rng(6).random((50, 3)) * 3])
    df = table(spark, p)
    near = ((p[:, None] - p[None]) ** 2).sum(axis=2) <= 0.09
    got = neighbours.close_pairs(df, 0.3, capacity=20).select("gid", "other").collect()
    assert sorted(map(tuple, got)) == [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)]
    units = neighbours._in_units(df, neighbours.leaves_of(df, 20, halved=True), 0.3)
    most = units.groupBy("u", "v", "first").agg(F.sum(F.size("gid")).alias("n")).agg(F.max("n").alias("n")).first()["n"]
    assert most <= 80  # 2 x 20 on average


def test_thinning_sends_few_rows_twice(spark, monkeypatch):
    """Leaves of boxes that overlap sent rows in the midst of one leaf to others, where they wait."""
    from pointloom.operators import thinning

    r, sent, send = np.random.default_rng(21), [], thinning._sent
    rows = [(i, float(x), float(y), float(z), 0.0) for i, (x, y, z) in enumerate(zip(r.integers(1, 51, 12_000), r.random(12_000) * 52, r.integers(0, 19, 12_000), strict=True))]
    monkeypatch.setattr(thinning, "_sent", lambda *a: sent.append(out := send(*a)) or out)
    kept = thinning.thinned(spark.createDataFrame(rows, "gid long, x double, y double, z double, opacity double"), 0.3, capacity=500).count()
    assert 0 < kept < 12_000 and sent[0].count() < 1.15 * 12_000


def test_runs_hold_all_that_is_near():
    from pointloom.operators import thinning

    r = np.random.default_rng(22)
    for t in range(60):
        p = r.random((int(r.integers(1, 120)), 3)) * [1, r.random(), 10.0 ** r.integers(-3, 4)]
        p = np.round(p * 8) / 8 if t % 3 == 0 else p
        radius = float(r.choice([0, 0.05, 0.125, 0.5, 20]))
        order, at, low, high = thinning._runs(p, radius)
        near = ((p[:, None] - p[None]) ** 2).sum(axis=2) <= radius * radius
        for i in range(len(p)):
            held = [j for k in range(at[i], at[i + 1]) for j in order[low[k] : high[k]].tolist()]
            assert len(held) == len(set(held)) and set(np.flatnonzero(near[i]).tolist()) <= set(held)
