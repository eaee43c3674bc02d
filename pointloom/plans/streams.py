"""Queries that replay the events table in several micro-batches to its end; SQL says what a batch would give."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import sessions
from .registry import FIXTURES, QUERIES, SQL, duck


def stream(name: str, sql: str | None = None, uses: tuple[str, ...] = ("v1",)):
    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(sessions.replayed(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id"))

        QUERIES[name] = run
        if sql is not None:
            body = duck(sql.strip())
            ctes = ", ".join(f"{n} as ({duck(FIXTURES[n])})" for n in uses)
            head = "with recursive " if body.startswith("with recursive ") else "with "
            SQL[name] = f"{head}{ctes}, {body[len(head):]}" if body.startswith("with ") else f"with {ctes} {body}"
        return f

    return put


def messages(events: DataFrame) -> DataFrame:
    """The message stream: the same as the fixture v1."""
    return events.sparkSession.sql(re.sub(r"from events", "from {events}", FIXTURES["v1"]), events=events)


def controls(events: DataFrame) -> DataFrame:
    t = F.col("type")
    kind = F.when(t == "cursor_move", "frame").when(t == "select_segment", "start").when(t == "disconnect", "stop").otherwise("ping")
    return messages(events).withColumn("kind", kind)


_SESSIONS = "k as (select project_id, seq, case type when 'cursor_move' then 'frame' when 'select_segment' then 'start' when 'disconnect' then 'stop' else 'ping' end kind from v1), s as (select *, sum((kind in ('start','stop'))::int) over (partition by project_id order by seq) sid from k), n as (select project_id, seq, row_number() over (partition by project_id, sid order by seq) n from s where kind = 'frame')"


@stream("t01_frame_ingest", f"with {_SESSIONS} select project_id::bigint project_id, seq, n n_frames, case when n < 3 then 'accumulating' when n = 3 then 'initializing' else 'refining' end phase from n")
def t01(events):
    return sessions.drained(sessions.ingest(controls(events))).drop("export")


@stream("t02_export_cadence", f"with {_SESSIONS} select project_id::bigint project_id, seq from n where n >= 3 and (n - 3) % 2 = 0")
def t02(events):
    return sessions.drained(sessions.ingest(controls(events))).where("export").select("project_id", "seq")


@stream("t03_session_control", f"with {_SESSIONS} select project_id::bigint project_id, max(n) longest, count(*) filter (where n = 1) n_sessions from n group by 1")
def t03(events):
    out = sessions.drained(sessions.ingest(controls(events)))
    return out.groupBy("project_id").agg(F.max("n_frames").alias("longest"), F.count_if(F.col("n_frames") == 1).alias("n_sessions"))


@stream("t04_job_progress", "select user_id job_id, max(seq) seq, arg_max(type, seq) status, round(arg_max(pos_x, seq),6) progress from v1 group by 1")
def t04(events):
    u = messages(events).select(F.col("user_id").alias("job_id"), "seq", F.col("type").alias("status"), F.col("pos_x").alias("progress"))
    return sessions.merged(sessions.latest_state(u), ["job_id"]).withColumn("progress", F.round("progress", 6))


@stream("t05_view_evidence", "select user_id gid, count(distinct segment_id) n_views from v1 group by 1")
def t05(events):
    seen = messages(events).select(F.col("segment_id").alias("view"), F.col("user_id").alias("gid"))
    return sessions.merged(sessions.evidence(seen), ["gid"])


@stream("t06_training_telemetry", """
with d as (select run_id, step, row_number() over w >= 20 and round(avg(loss) over (w rows between 9 preceding and current row),9) > round(avg(loss) over (w rows between 19 preceding and 10 preceding)*1.5,9) diverged,
max(mean_psnr) over (w rows between unbounded preceding and 1 preceding) m, mean_psnr from t1 window w as (partition by run_id order by step)), b as (select *, m is null or mean_psnr > m up from d),
c as (select *, sum(up::int) over (partition by run_id order by step) isle from b), e as (select *, row_number() over (partition by run_id, isle order by step) - 1 k from c)
select run_id::bigint run_id, count(*) filter (where diverged) n_diverged, min(step) filter (where k >= 3) stop_step, round(max(mean_psnr),6) best from e group by 1""", ("t1",))
def t06(events):
    log = messages(events).select(F.col("user_id").alias("run_id"), "seq", F.col("pos_x").alias("loss"), (F.lit(20.0) + F.col("pos_x") / 50.0).alias("psnr"))
    out = sessions.drained(sessions.telemetry(log, 20))
    from pyspark.sql.window import Window

    n = out.withColumn("step", F.row_number().over(Window.partitionBy("run_id").orderBy("seq")) - 1)
    return n.groupBy("run_id").agg(F.count_if("diverged").alias("n_diverged"), F.min(F.when(F.col("stop"), F.col("step"))).alias("stop_step"), F.round(F.max("best"), 6).alias("best"))


@stream("t07_presence", "with l as (select project_id, user_id, arg_max(type, seq) t from v1 group by 1, 2) select project_id::bigint project_id, count(*) filter (where t <> 'disconnect') n_users, coalesce(sum(user_id) filter (where t <> 'disconnect'), 0)::bigint total from l group by 1")
def t07(events):
    out = sessions.drained(sessions.presence(messages(events)))
    last = out.groupBy("project_id").agg(F.max_by("users", "seq").alias("u"))
    return last.select("project_id", F.size("u").cast("long").alias("n_users"), F.aggregate("u", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


#: A lock lasts until its owner ends it or leaves; the next one is the first start after that.
@stream("t08_segment_locks", """
with recursive ends as (select project_id, user_id, seq, segment_id from v1 where type = 'transform_end' and segment_id is not null
  union all select project_id, user_id, seq, null from v1 where type = 'disconnect'),
starts as (select s.project_id, s.segment_id, s.seq, s.user_id, min(e.seq) as until from v1 s
  left join ends e on e.project_id = s.project_id and e.user_id = s.user_id and e.seq > s.seq and (e.segment_id is null or e.segment_id = s.segment_id)
  where s.type = 'transform_start' and s.segment_id is not null group by all),
steps as (select s.project_id, s.segment_id, s.seq, s.user_id, s.until, n.seq as next from starts s
  asof left join starts n on n.project_id = s.project_id and n.segment_id = s.segment_id and n.seq > s.until),
held as (select * from steps where seq = (select min(f.seq) from starts f where f.project_id = steps.project_id and f.segment_id = steps.segment_id)
  union all select n.* from held h join steps n on n.project_id = h.project_id and n.segment_id = h.segment_id and n.seq = h.next)
select project_id::bigint project_id, seq, 'locked' change, segment_id::bigint segment_id, user_id::bigint user_id from held
union all select project_id, until, 'unlocked', segment_id, user_id from held where until is not null""")
def t08(events):
    return sessions.drained(sessions.locks(messages(events)))


@stream("t09_cursors_and_versions", "with p as (select project_id, count(*) filter (where type = 'transform_end') as version from v1 group by 1) select v.project_id, user_id, round(arg_max(pos_x, seq) filter (where type = 'cursor_move'),6) as cursor, arg_max(segment_id, seq) filter (where type = 'select_segment') segment_id, any_value(version) as version from v1 v join p using (project_id) group by 1, 2")
def t09(events):
    m = messages(events)
    seen = sessions.merged(sessions.last_seen(m), ["project_id", "user_id"])
    versions = sessions.merged(sessions.scene_versions(m), ["project_id"])
    return seen.join(versions, "project_id").withColumn("cursor", F.round("cursor", 6))
