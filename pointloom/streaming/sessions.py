"""Structured Streaming operators over message streams, with typed state.

Each key's state is values and maps of their own in RocksDB (transformWithState, with rows or with pandas):
a micro-batch reads and writes the entries that its rows touch. Rows of one key within a
micro-batch are sorted by seq before they meet the state, so a task holds at most a
micro-batch's rows of a key: the trigger's size bounds it, not the length of the stream.
With an idle time, a key's state expires that long after it was last written.

The functions *_step say for one message what the processors do for a batch of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..scratch import scratch_path
from .upserts import UpsertTable

START_FRAMES, EXPORT_EVERY = 3, 2
#: Rows of a file of a replayed stream.
FILE_ROWS = 1_000_000
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session_step(state: dict, kind: str, start: int = START_FRAMES, every: int = EXPORT_EVERY) -> tuple[dict, dict | None]:
    """One message of a project: the new state, and for a frame what it leads to.

    start replaces the session, stop ends it, the first frame creates one; ping changes nothing.
    """
    if kind == "start":
        return {"n": 0, "exported": 0}, None
    if kind == "stop":
        return {}, None
    if kind != "frame":
        return state, None
    n, exported = state.get("n", 0) + 1, state.get("exported", 0)
    phase = "accumulating" if n < start else "initializing" if n == start else "refining"
    export = n == start or (n > start and n - exported >= every)
    return {"n": n, "exported": n if export else exported}, {"n_frames": n, "phase": phase, "export": export}


def telemetry_step(state: dict, loss: float, psnr: float | None, window: int = 200, factor: float = 1.5, patience: int = 3) -> tuple[dict, dict]:
    """One step of a run: flags for divergence of the loss and for evaluations without a new best."""
    losses = [*state.get("losses", []), loss][-window:]
    half = window // 2
    diverged = len(losses) >= window and round(sum(losses[half:]) / half, 9) > round(factor * sum(losses[:half]) / half, 9)
    best, bad = state.get("best"), state.get("bad", 0)
    first = state.get("first", psnr)
    if psnr is not None:
        best, bad = (psnr, 0) if best is None or psnr > best else (best, bad + 1)
    stopped = state.get("stopped", False) or bad >= patience
    return {"losses": losses, "best": best, "bad": bad, "first": first, "stopped": stopped}, {"diverged": diverged, "stop": stopped, "best": best, "baseline": first}


def presence_step(users: list, user: int, kind: str) -> list:
    """The users in a room after a message; any message but a disconnect shows that its user is there."""
    rest = [u for u in users if u != user]
    return sorted(rest if kind == "disconnect" else [*rest, user])


def lock_step(locks: dict, user: int, kind: str, segment: int | None) -> tuple[dict, list[tuple[str, int, int]]]:
    """(locks, changes): the first transform_start wins, only the owner's transform_end releases, a disconnect releases all of a user's."""
    if kind == "transform_start" and segment is not None and segment not in locks:
        return locks | {segment: user}, [("locked", segment, user)]
    if kind == "transform_end" and segment is not None and locks.get(segment) == user:
        return {s: u for s, u in locks.items() if s != segment}, [("unlocked", segment, user)]
    if kind == "disconnect":
        mine = sorted(s for s, u in locks.items() if u == user)
        return {s: u for s, u in locks.items() if u != user}, [("unlocked", s, user) for s in mine]
    return locks, []


class Keyed(StatefulProcessor):
    """Sorts a key's rows of a micro-batch by seq and hands them to step, which gives the columns of the output."""

    #: Whether rows come and go one by one: for many keys with few rows each, where a pandas table a key costs more than its rows.
    by_rows = False

    def __init__(self, names: list[str], idle_ms: int | None = None):
        self.names, self.idle_ms = names, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states()

    def value(self, name: str, schema: str):
        return self.handle.getValueState(name, schema, self.idle_ms)

    def entries(self, name: str, key: str, schema: str):
        return self.handle.getMapState(name, key, schema, self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = self.step(pd.concat(list(rows)).sort_values("seq", kind="stable"))
        n = len(out[0])
        # Texts as objects: Arrow takes pandas' own string columns in several chunks, which the stream doesn't.
        cols = [*(np.full(n, k) for k in key), *(pd.Series(list(c) if isinstance(c, list) else c.tolist(), dtype=object) if getattr(c, "dtype", None) is None or c.dtype.kind in "UO" else c for c in out)]
        yield pd.DataFrame(dict(zip(self.names, cols, strict=True)))

    def close(self) -> None:
        pass


class Ingest(Keyed):
    """session_step for all messages of a batch: frames are counted from the last start or stop on."""

    def states(self) -> None:
        self.n = self.value("frames", "n long")

    def step(self, rows: pd.DataFrame) -> list:
        kind = rows["kind"].to_numpy()
        frame, cut = kind == "frame", (kind == "start") | (kind == "stop")
        session, total = np.cumsum(cut), np.cumsum(frame)
        before = np.zeros(session[-1] + 1, np.int64)  # frames before each session of this batch
        before[1:] = total[cut]
        before[0] = -(self.n.get()[0] if self.n.exists() else 0)
        n = total - before[session]
        if n[-1] or self.n.exists():
            self.n.update((int(n[-1]),))
        n = n[frame]
        phase = np.where(n < START_FRAMES, "accumulating", np.where(n == START_FRAMES, "initializing", "refining"))
        return [rows["seq"].to_numpy()[frame], n, phase, (n >= START_FRAMES) & ((n - START_FRAMES) % EXPORT_EVERY == 0)]


class Telemetry(Keyed):
    """telemetry_step for all steps of a batch. There are many runs, each with few steps of a batch."""

    by_rows = True

    def __init__(self, names: list[str], window: int, factor: float = 1.5, patience: int = 3, idle_ms: int | None = None):
        super().__init__(names, idle_ms)
        self.window, self.factor, self.patience = window, factor, patience

    def states(self) -> None:
        # One value: a call reads and writes it once, and most calls have few rows.
        self.seen = self.value("seen", "losses array<double>, best double, bad int, stopped boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        got = sorted(rows, key=lambda r: r["seq"])
        number = lambda name: np.array([np.nan if r[name] is None else r[name] for r in got], float)
        diverged, stops, best = self.step(number("loss"), number("psnr"))
        for r, *flags, top in zip(got, diverged.tolist(), stops.tolist(), best.tolist(), strict=True):
            yield Row(**dict(zip(self.names, [*key, r["seq"], *flags, None if top == -np.inf else top], strict=True)))

    def step(self, loss: np.ndarray, psnr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w, half, n = self.window, self.window // 2, len(loss)
        old, best, bad, stopped = self.seen.get() or ([], None, 0, False)
        all_ = np.concatenate([np.array([np.nan if v is None else v for v in old], float), loss])
        diverged = np.zeros(len(all_), bool)
        if len(all_) >= w:
            spans = np.lib.stride_tricks.sliding_window_view(all_, w)
            late, early = spans[:, half:].sum(axis=1) / half, spans[:, :half].sum(axis=1) / half
            diverged[w - 1 :] = np.round(late, 9) > np.round(self.factor * early, 9)
        at = np.flatnonzero(~np.isnan(psnr))
        p = psnr[at]
        top = np.maximum.accumulate(np.concatenate([[-np.inf if best is None else best], p]))
        up = p > top[:-1]
        last = np.maximum.accumulate(np.where(up, np.arange(len(p)), -1))
        since = np.where(last >= 0, np.arange(len(p)) - last, bad + 1 + np.arange(len(p)))
        stops = np.logical_or.accumulate(np.concatenate([[bool(stopped)], since >= self.patience]))
        self.seen.update((all_[-w:].tolist(), None if top[-1] == -np.inf else float(top[-1]), int(since[-1]) if len(p) else bad, bool(stops[-1])))
        so_far = np.searchsorted(at, np.arange(n), side="right")  # evaluations up to each row
        return diverged[len(old) :], stops[so_far], top[so_far]


class Presence(Keyed):
    """presence_step for a batch: each user's last message decides; one row with all who are there."""

    def states(self) -> None:
        self.users = self.entries("users", "user long", "seq long")

    def step(self, rows: pd.DataFrame) -> list:
        last = rows.drop_duplicates("user_id", keep="last")
        for user, kind, seq in zip(last["user_id"].tolist(), last["type"].tolist(), last["seq"].tolist(), strict=True):
            if kind != "disconnect":
                self.users.updateValue((user,), (seq,))
            elif self.users.containsKey((user,)):
                self.users.removeKey((user,))
        return [[int(rows["seq"].iloc[-1])], [sorted(k[0] for k in self.users.keys())]]


class Locks(Keyed):
    """lock_step for each message that can change a lock; only entries that changed are written."""

    def states(self) -> None:
        self.held = self.entries("held", "segment long", "user long")

    def step(self, rows: pd.DataFrame) -> list:
        before = {k[0]: v[0] for k, v in self.held.iterator()}
        now, out = dict(before), []
        some = rows[rows["type"].isin(["transform_start", "transform_end", "disconnect"])]
        for seq, user, kind, seg in zip(some["seq"].tolist(), some["user_id"].tolist(), some["type"].tolist(), some["segment_id"].tolist(), strict=True):
            now, changes = lock_step(now, int(user), kind, None if pd.isna(seg) else int(seg))
            out += [(seq, c, s, u) for c, s, u in changes]
        for segment in before.keys() - now.keys():
            self.held.removeKey((segment,))
        for segment, user in now.items():
            if before.get(segment) != user:
                self.held.updateValue((segment,), (user,))
        return [list(c) for c in zip(*out, strict=True)] or [[]] * 4


def _stateful(df: DataFrame, keys: list[str], schema: str, processor: Callable[[list[str]], Keyed], mode: str = "append") -> DataFrame:
    names = [c.strip().split()[0] for c in schema.split(",")]
    made, grouped = processor(names), df.groupBy(*keys)
    return (grouped.transformWithState if made.by_rows else grouped.transformWithStateInPandas)(made, schema, mode, "ProcessingTime" if made.idle_ms else "None")


def ingest(messages: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Frame ingest per project: (project_id, seq, n_frames, phase, export) for each frame. messages: project_id, seq, kind."""
    schema = "project_id long, seq long, n_frames long, phase string, export boolean"
    return _stateful(messages.select("project_id", "seq", "kind"), ["project_id"], schema, lambda names: Ingest(names, idle_ms))


def telemetry(log: DataFrame, window: int = 200, idle_ms: int | None = None) -> DataFrame:
    """(run_id, seq, diverged, stop, best) for each step. log: run_id, seq, loss, psnr."""
    schema = "run_id long, seq long, diverged boolean, stop boolean, best double"
    return _stateful(log.select("run_id", "seq", "loss", "psnr"), ["run_id"], schema, lambda names: Telemetry(names, window, idle_ms=idle_ms))


def presence(messages: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """(project_id, seq, users): who is in the room after each micro-batch. With an idle time, a user leaves that long after the last message."""
    schema = "project_id long, seq long, users array<long>"
    return _stateful(messages.select("project_id", "seq", "user_id", "type"), ["project_id"], schema, lambda names: Presence(names, idle_ms))


def locks(messages: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """(project_id, seq, change, segment_id, user_id): each lock taken or released."""
    schema = "project_id long, seq long, change string, segment_id long, user_id long"
    return _stateful(messages.select("project_id", "seq", "user_id", "type", "segment_id"), ["project_id"], schema, lambda names: Locks(names, idle_ms))


def latest_state(updates: DataFrame) -> DataFrame:
    """Latest state per job: a streaming aggregation. updates: job_id, seq, status, progress."""
    return updates.groupBy("job_id").agg(F.max_by(F.struct("status", "progress"), "seq").alias("s"), F.max("seq").alias("seq")).select("job_id", "seq", "s.status", "s.progress")


def evidence(observations: DataFrame) -> DataFrame:
    """(gid, n_views): distinct views per row, counted as they arrive. observations: view, gid."""
    return observations.dropDuplicates(["view", "gid"]).groupBy("gid").agg(F.count(F.lit(1)).alias("n_views"))


def last_seen(messages: DataFrame) -> DataFrame:
    """(project_id, user_id, cursor, segment_id): each user's last cursor and selection."""
    cur, sel = F.col("type") == "cursor_move", F.col("type") == "select_segment"
    return messages.groupBy("project_id", "user_id").agg(F.max_by(F.when(cur, F.col("pos_x")), F.when(cur, F.col("seq"))).alias("cursor"), F.max_by(F.when(sel, F.col("segment_id")), F.when(sel, F.col("seq"))).alias("segment_id"))


def scene_versions(messages: DataFrame) -> DataFrame:
    """(project_id, version): how often the scene was changed."""
    return messages.groupBy("project_id").agg(F.count_if(F.col("type") == "transform_end").alias("version"))


#: Settings of the streams that are run here. Without batches of no data, a run over what is there now ends,
#: with idle times too: a state that has expired isn't seen by the next batch.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """For streams started inside. A stream has a session of its own, so the settings can go back."""
    before = {k: spark.conf.get(k) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _run(stream: DataFrame, mode: str, put: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    with _settings(stream.sparkSession):
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()


def drained(stream: DataFrame, at: str | None = None) -> DataFrame:
    """Runs a stream over all that is there now, into Parquet; with a folder of an earlier run it goes on from there.

    Each micro-batch has a folder of its own, which a batch that is tried again overwrites.
    """
    spark, at = stream.sparkSession, at or scratch_path(stream.sparkSession, "stream")
    _run(stream, "append", lambda df, batch: df.write.mode("overwrite").parquet(f"{at}/out/batch={batch}"), f"{at}/state")
    return spark.read.schema(stream.schema).parquet(f"{at}/out").select(*stream.columns)


def merged(stream: DataFrame, keys: list[str], at: str | None = None, buckets: int | None = None) -> DataFrame:
    """Runs a stream in update mode over all that is there now: each micro-batch's changed keys are merged into a table."""
    spark, at = stream.sparkSession, at or scratch_path(stream.sparkSession, "upserts")
    table = UpsertTable(spark, f"{at}/table", stream.schema, keys, *([buckets] if buckets else []))
    _run(stream, "update", table.merge, f"{at}/state")
    return table.rows()


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """The rows of a given table as a stream, in as few micro-batches as it has files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


def replayed(rows: DataFrame, key: str, batches: int = 5, file_rows: int = FILE_ROWS) -> DataFrame:
    """A stream that gives the rows in ascending ranges of a number, in about so many micro-batches.

    Each file is one range of the key. The files' times are set in that order, as the source takes the oldest
    first; so the folder must be of a file system that keeps the times it is told.
    """
    spark, at = rows.sparkSession, scratch_path(rows.sparkSession, "replay")
    files = max(rows.count() // batches // file_rows, 1)  # of a micro-batch
    rows.repartitionByRange(batches * files, F.col(key).asc_nulls_first()).write.parquet(at)
    folder = spark._jvm.org.apache.hadoop.fs.Path(at)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in fs.listStatus(folder))
    for i, name in enumerate(n for n in names if n.startswith("part-")):
        fs.setTimes(spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{name}"), 1_000_000_000_000 + 60_000 * i, -1)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(at)
