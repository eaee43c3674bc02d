"""Scenes in Morton order: the same rows, and little read."""

import glob

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pointloom.functions import scalar
from pointloom.operators import edits, scene
from pointloom.plans.registry import table
from pointloom.sources import layout

ROWS = dict(file_rows=4000, group_bytes=8_192, page_rows=200)


@pytest.fixture(scope="module")
def laid(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('scene')}/s"
    g2 = table(spark, "/root/testdata/sf0.01", "g2")
    layout.write_scene(g2, path, **ROWS)
    return path, g2


def scanned(df):
    """(rows that the scan gave, files that it opened)."""
    df.collect()
    m = df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics()
    return m.apply("numOutputRows").value(), m.apply("numFiles").value()


QUERIES = [((10.0, 5.0, 3.0), (14.0, 12.0, 6.0)), ((49.5, 40.0, 0.0), (60.0, 60.0, 20.0)), ((25.0, 20.0, 5.0), (25.0, 21.0, 5.5))]


@pytest.mark.parametrize("box", QUERIES)
def test_boxes_read_little(spark, laid, box):
    path, g2 = laid
    got = layout.Scene(spark, path).box(*box)
    assert {r["gid"] for r in got.collect()} == {r["gid"] for r in scene.query_box(g2, *box).collect()}
    total, files = g2.count(), len(glob.glob(f"{path}/*.parquet"))
    rows, opened = scanned(got)
    assert files >= 14 and opened < files and rows < 0.15 * total
    groups = [pq.ParquetFile(f).metadata.row_group(i) for f in glob.glob(f"{path}/*.parquet") for i in range(pq.ParquetFile(f).metadata.num_row_groups)]
    at = {groups[0].column(i).path_in_schema: i for i in range(groups[0].num_columns)}
    ends = [[(g.column(at[a]).statistics.min, g.column(at[a]).statistics.max) for a in "xyz"] for g in groups]
    met = sum(all(hi >= lo_ and lo <= hi_ for (lo, hi), lo_, hi_ in zip(e, *box, strict=True)) for e in ends)
    assert len(groups) > 100 and met < len(groups) / 10


def test_spheres_and_boxes_without_rows(spark, laid):
    path, g2 = laid
    s = layout.Scene(spark, path)
    got = s.sphere((25.0, 20.0, 6.0), 3.0)
    assert {r["gid"] for r in got.collect()} == {r["gid"] for r in scene.query_sphere(g2, (25.0, 20.0, 6.0), 3.0).collect()}
    assert s.box((1e6,) * 3, (2e6,) * 3).count() == 0 and s.box((1e6,) * 3, (2e6,) * 3).columns == g2.columns
    assert s.rows().count() == g2.count()
    assert s.box(QUERIES[0][0], QUERIES[0][1], exclude_deleted=False).count() == g2.where(scene.in_box(*QUERIES[0])).count()


def test_without_bounds_everything_is_read(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("gid"), *[F.col("id").cast("double").alias(a) for a in "xyz"])
    df.write.parquet(f"{tmp_path}/plain")
    assert layout.Scene(spark, f"{tmp_path}/plain").box((3.0,) * 3, (5.0,) * 3).count() == 3
    layout.write_scene(df.where("false"), f"{tmp_path}/none")
    assert layout.Scene(spark, f"{tmp_path}/none").box((3.0,) * 3, (5.0,) * 3).count() == 0
    odd = df.withColumn("x", F.when(F.col("gid") > 5, F.col("x")))
    layout.write_scene(odd, f"{tmp_path}/nulls")
    assert {r["gid"] for r in layout.Scene(spark, f"{tmp_path}/nulls").box((0.0,) * 3, (8.0,) * 3).collect()} == {6, 7, 8}


def test_snapshots_of_scenes_are_laid_out(spark, tmp_path):
    df = spark.range(50).select(F.col("id").alias("gid"), *[F.col("id").cast("double").alias(a) for a in "xyz"])
    kept = edits.Snapshots(spark, f"{tmp_path}/undo")
    id_ = kept.save(df, "first")
    assert kept.restore(id_).count() == 50 and glob.glob(f"{tmp_path}/undo/1-*/{layout.BOUNDS}/*.parquet")


def test_inverse_against_numpy(spark):
    r = np.random.default_rng(2)
    ms = [*r.normal(size=(30, 4, 4)), np.eye(4), np.zeros((4, 4)), np.diag([1.0, 2.0, 0.0, 1.0]), np.arange(16.0).reshape(4, 4), np.eye(4)[[1, 0, 3, 2]]]
    names = [f"m{i}{j}" for i in range(4) for j in range(4)]
    df = spark.createDataFrame([(n, *map(float, m.ravel())) for n, m in enumerate(ms)], ", ".join(["n int", *[f"{c} double" for c in names]]))
    inv = scalar.inverse([[F.col(f"m{i}{j}") for j in range(4)] for i in range(4)])
    for row in df.select("n", *[inv[i][j].alias(f"i{i}{j}") for i in range(4) for j in range(4)]).collect():
        m = ms[row["n"]]
        if abs(np.linalg.det(m)) < 1e-9:
            assert all(v is None for v in row[1:])
        else:
            assert np.allclose(np.array(row[1:]).reshape(4, 4), np.linalg.inv(m), rtol=1e-8, atol=1e-9)
