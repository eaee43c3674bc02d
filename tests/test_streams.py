"""Streams: typed state against the steps, restarts, expiry, and the table that batches are merged into."""

import glob
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from pointloom.scratch import scratch_path
from pointloom.streaming import sessions
from pointloom.streaming.upserts import UpsertTable

KINDS = ["frame"] * 8 + ["start", "stop", "ping"]
TYPES = ["cursor_move", "select_segment", "transform_start", "transform_start", "transform_end", "disconnect"]
COLUMNS = "project_id long, seq long, kind string, user_id long, type string, segment_id long, run_id long, loss double, psnr double"


def messages(n=400, seed=3):
    r = random.Random(seed)
    return [(r.randrange(3), i, r.choice(KINDS), r.randrange(6), r.choice(TYPES), r.choice([None, 1, 2, 3]), r.randrange(2), r.random() * (1 + i / 40), r.choice([None, r.random()])) for i in range(n)]


def put(spark, rows, path, i):
    """Adds a file to a stream's folder, later than those that are there."""
    at = scratch_path(spark, "part")
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.parquet(at)
    (found,) = glob.glob(f"{at.removeprefix('file:')}/part-*.parquet")
    os.makedirs(path, exist_ok=True)
    os.rename(found, f"{path}/{i:04d}.parquet")
    os.utime(f"{path}/{i:04d}.parquet", (1_000_000 + i, 1_000_000 + i))


def stream(spark, path):
    return spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(path)


def by_steps(rows):
    """What ingest, telemetry and locks give, message by message."""
    out, states = {"ingest": [], "telemetry": [], "locks": []}, {}
    for p, seq, kind, user, type_, seg, run, loss, psnr in rows:
        states["i", p], got = sessions.session_step(states.get(("i", p), {}), kind)
        if got:
            out["ingest"].append((p, seq, got["n_frames"], got["phase"], got["export"]))
        states["t", run], got = sessions.telemetry_step(states.get(("t", run), {}), loss, psnr, 12)
        out["telemetry"].append((run, seq, got["diverged"], got["stop"], got["best"]))
        states["l", p], changes = sessions.lock_step(states.get(("l", p), {}), user, type_, seg)
        out["locks"] += [(p, seq, c, s, u) for c, s, u in changes]
    return {k: sorted(v, key=repr) for k, v in out.items()}


MADE = {"ingest": sessions.ingest, "telemetry": lambda m: sessions.telemetry(m, 12), "locks": sessions.locks}


@pytest.mark.parametrize("name", sorted(MADE))
def test_batches_with_a_restart_equal_the_steps(spark, tmp_path, name):
    """Six micro-batches; after two the query ends and goes on from its checkpoint. Rows of a batch come in any order."""
    rows = messages()
    want = by_steps(rows)[name]
    parts = [rows[i : i + 70] for i in range(0, len(rows), 70)]
    path, at = f"{tmp_path}/in", f"{tmp_path}/run"
    for i, part in enumerate(parts):
        random.Random(i).shuffle(part)
        if i in (0, 1):
            put(spark, part, path, i)
    first = sessions.drained(MADE[name](stream(spark, path)), at).count()
    for i, part in enumerate(parts[2:], 2):
        put(spark, part, path, i)
    out = sessions.drained(MADE[name](stream(spark, path)), at)
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == want and 0 < first < len(want)
    assert len(glob.glob(f"{at}/out/batch=*")) == len(parts)


def test_presence_over_batches(spark, tmp_path):
    rows, users = messages(200), {}
    for i in range(4):
        put(spark, rows[50 * i : 50 * i + 50], f"{tmp_path}/in", i)
    last = {}
    for p, seq, _, user, type_, *_ in rows:
        users[p] = sessions.presence_step(users.get(p, []), user, type_)
        last[p] = seq
    got = {r["project_id"]: r["u"] for r in sessions.drained(sessions.presence(stream(spark, f"{tmp_path}/in")), f"{tmp_path}/run").groupBy("project_id").agg(F.max_by("users", "seq").alias("u")).collect()}
    assert got == users


def test_idle_state_expires(spark, tmp_path):
    """With an idle time a session starts anew after a pause, without one it goes on."""
    frame = [(0, i, "frame", 0, "cursor_move", None, 0, 0.0, None) for i in range(8)]
    for idle, want in ((500, [1, 2, 3, 4, 1, 2, 3, 4]), (None, [1, 2, 3, 4, 5, 6, 7, 8])):
        path, at = f"{tmp_path}/in{idle}", f"{tmp_path}/run{idle}"
        put(spark, frame[:4], path, 0)
        sessions.drained(sessions.ingest(stream(spark, path), idle), at).count()
        time.sleep(1)
        put(spark, frame[4:], path, 1)
        out = sessions.drained(sessions.ingest(stream(spark, path), idle), at)
        assert [r["n_frames"] for r in out.orderBy("seq").collect()] == want


def test_merge_touches_changed_buckets_only(spark, tmp_path):
    df = spark.range(2000).select(F.expr("nullif(id, -1)").alias("id"), (F.col("id") * 2).alias("v"))
    t = UpsertTable(spark, f"{tmp_path}/t", df.schema, ["id"], buckets=16)
    assert t.rows().count() == 0
    t.merge(df, 0)
    size = lambda batch: sum(os.path.getsize(f) for f in glob.glob(f"{tmp_path}/t/data/batch={batch}/*/*.parquet"))
    assert len(glob.glob(f"{tmp_path}/t/data/batch=0/bucket=*")) == 16
    few = spark.createDataFrame([(7, -1), (5000, -2), (None, -3)], df.schema)
    t.merge(few, 1)
    assert 1 <= len(glob.glob(f"{tmp_path}/t/data/batch=1/bucket=*")) <= 3 and size(1) < size(0) / 4
    want = {**{i: 2 * i for i in range(2000)}, 7: -1, 5000: -2, None: -3}
    assert {r["id"]: r["v"] for r in t.rows().collect()} == want and t.rows().count() == len(want)
    t.merge(few, 1)  # tried again
    assert {r["id"]: r["v"] for r in t.rows().collect()} == want and t.rows().count() == len(want)
    t.merge(spark.createDataFrame([(None, -4)], df.schema), 2)
    assert {r["id"]: r["v"] for r in t.rows().collect()} == want | {None: -4}
    t.merge(df.where("false"), 3)
    assert t.rows().count() == len(want)


def test_a_batch_that_failed_before_its_index_is_not_seen(spark, tmp_path):
    df = spark.range(40).withColumn("v", F.lit(1))
    t = UpsertTable(spark, f"{tmp_path}/t", df.schema, ["id"], buckets=4)
    t.merge(df, 0)
    df.withColumn("v", F.lit(9)).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{tmp_path}/t/data/batch=1")
    assert {r["v"] for r in t.rows().collect()} == {1}
    t.merge(df.where("id < 3").withColumn("v", F.lit(2)), 1)
    assert sorted(r["v"] for r in t.rows().collect()) == [1] * 37 + [2] * 3


def test_replayed_ranges_ascend(spark):
    """Each micro-batch begins where the one before has ended."""
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("seq"), F.lit("x").alias("v")).repartition(6)
    at = scratch_path(spark, "ranges")
    spans = []

    def put_(df, batch):
        spans.append(tuple(df.agg(F.min("seq"), F.max("seq"), F.count("seq")).first()))

    q = sessions.replayed(rows, "seq", batches=4).writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(put_).start()
    q.awaitTermination()
    assert len(spans) == 4 and sum(s[2] for s in spans) == 1000
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
