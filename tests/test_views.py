"""Frustum culling and run lengths against the plain forms."""

import random

import numpy as np
from pyspark.sql import functions as F

from pointloom.operators import camera, masks


def test_culling_keeps_all_that_is_seen(spark):
    """100 cameras in a wide cloud: the same rows, of few that are looked at."""
    r = np.random.default_rng(4)
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(r.uniform(-10, 10, (12000, 3)))], "gid long, x double, y double, z double").repartition(4)
    cams = []
    for c in range(100):
        q = np.linalg.qr(r.normal(size=(3, 3)))[0]
        cams.append((c, *map(float, q.ravel()), *map(float, r.uniform(-9, 9, 3)), 45.0, 42.0, 32.0, 30.0, 64, 64))
    schema = ", ".join(["pos int", *[f"r{i}{j} double" for i in range(3) for j in range(3)], *[f"t{i} double" for i in range(3)], "fx double, fy double, cx double, cy double, width int, height int"])
    cams = spark.createDataFrame(cams, schema)
    pairs = lambda df: {(x["gid"], x["pos"], round(x["u"], 9)) for x in df.select("gid", "pos", "u").collect()}
    want = pairs(camera.project(points, cams))
    assert pairs(camera.project_culled(points, cams, capacity=32)) == want
    met = camera.met_leaves(points.persist(), cams, capacity=16).count()
    assert len(want) <= met <= 3 * len(want)
    same = camera.project_culled(points, cams, 64.0, 45.0, capacity=50)
    assert pairs(same) == pairs(camera.project(points, cams, 64.0, 45.0))


def test_runs_of_masks(spark):
    r = random.Random(5)
    pixels = {(p, m, u, v) for p in range(2) for m in range(4) for v in range(8) for u in range(40) if r.random() < 0.7}
    df = spark.createDataFrame(sorted(pixels) + sorted(pixels)[:50], "pos int, mask_id int, u int, v int")
    runs = masks.mask_runs(df)
    held = {(x["pos"], x["mask_id"], u, x["v"]) for x in runs.collect() for u in range(x["u0"], x["u1"] + 1)}
    assert held == pixels and runs.count() < len(pixels) / 2
    places = [(i, r.randrange(2), r.uniform(0, 39.99), r.uniform(0, 8.99)) for i in range(400)]
    seen = spark.createDataFrame(places, "gid int, pos int, u double, v double")
    got = sorted((x["gid"], x["mask_id"]) for x in masks.run_hits(seen, masks.row_lists(runs), 40, 9).collect())
    assert got == sorted((i, m) for i, p, u, v in places for m in range(4) if (p, m, int(u), int(v)) in pixels)


def test_binary_search(spark):
    lists = [[], [3], [1, 4, 9], list(range(0, 50, 3))]
    df = spark.createDataFrame([(a, v) for a in lists for v in (-1, 0, 1, 3, 4, 8, 9, 100)], "a array<int>, v int")
    for x in df.select("a", "v", masks.last_not_above(F.col("a"), F.col("v")).alias("at")).collect():
        assert x["at"] == sum(e <= x["v"] for e in x["a"]) - 1
