"""Named queries over the given tables, each with its SQL where SQL can say it.

Scene tables are derived from the given ones by the SQL in FIXTURES; it is written
once, for Spark, and turned into DuckDB's dialect by two replacements.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_E = "cast(element_at(embedding,{}) as double)"
FIXTURES = {
    "g1": "select vec_id gid,"
    + ",".join(f"{_E.format(i)}{scale} {name}" for i, name, scale in [(1, "x", ""), (2, "y", ""), (3, "z", ""), (4, "scale_0", "*4.0D-3.0D"), (5, "scale_1", "*4.0D-3.0D"), (6, "scale_2", "*4.0D-3.0D"), (7, "rot_0", ""), (8, "rot_1", ""), (9, "rot_2", ""), (10, "rot_3", ""), (11, "f_dc_0", ""), (12, "f_dc_1", ""), (13, "f_dc_2", ""), (59, "opacity", "*20.0D")])
    + ", label segment_id, vec_id % 11 = 0 deleted from embeddings",
    "g2": "select ((l_orderkey*100000+l_partkey)*10000+l_suppkey)*10+l_linenumber gid, cast(l_quantity as double) x, cast(l_extendedprice as double)/2000.0D y, cast(l_discount+l_tax as double)*100.0D z, (cast(l_discount as double)-0.05D)*100.0D opacity, cast(l_suppkey % 10 as int) segment_id, l_linenumber=7 deleted from lineitem",
    "c1": "select cast(i as int) pos, concat('frame_0000',i,'.jpg') frame, sin(th) r00, 0.0D r01, -cos(th) r02, 0.0D r10, -1.0D r11, 0.0D r12, -cos(th) r20, 0.0D r21, -sin(th) r22, 2.0D*cos(th) t0, 0.0D t1, 2.0D*sin(th) t2, 54.4D fx, 54.4D fy, 32.0D cx, 32.0D cy, 64 width, 64 height from (select s_suppkey i, 2.0D*pi()*s_suppkey/8.0D th from supplier where s_suppkey<8) q",
    "c2": "select cast(i as int) pos, concat('frame_',cast(i as varchar(9)),'.jpg') frame, sin(th) r00, 0.0D r01, -cos(th) r02, 0.0D r10, -1.0D r11, 0.0D r12, -cos(th) r20, 0.0D r21, -sin(th) r22, 2.0D*cos(th) t0, 0.0D t1, 2.0D*sin(th) t2, 54.4D fx, 54.4D fy, 32.0D cx, 32.0D cy, 64 width, 64 height from (select s_suppkey i, cast(s_suppkey as double)*0.618D th from supplier) q",
    "k1": "select c.pos, c.frame, cast(m.s_suppkey as int) mask_id, cast(u.p_partkey as int) u, cast(v.p_partkey as int) v from c1 c, supplier m, part u, part v where m.s_suppkey<8 and u.p_partkey<64 and v.p_partkey<64 and floor(u.p_partkey/16)+4*floor(v.p_partkey/32)=m.s_suppkey",
    "d1": "select view, u, v, base r, ((u+view)%5)/4.0D g, (v%7)/6.0D b, least(1.0D,greatest(0.0D,base+(((u*v+view)%3)-1)*0.02D)) gt_r, ((u+view)%5)/4.0D gt_g, (v%7)/6.0D gt_b, 1.5D+((u*5+v*11+view*2)%13)/13.0D depth, ((u+v+view)%10)/9.0D alpha from (select cast(w.s_suppkey as int) view, cast(a.p_partkey as int) u, cast(b.p_partkey as int) v, ((a.p_partkey*7+b.p_partkey*13+w.s_suppkey*3)%17)/17.0D base from supplier w, part a, part b where w.s_suppkey<8 and a.p_partkey<32 and b.p_partkey<32) q",
    "f1": "select event_id idx, concat('frame_',lpad(cast(event_id as varchar(9)),5,'0'),'.jpg') filename, concat('u',cast(user_id%7 as varchar(9)),'.mp4') source_file, cast(value as double) sharpness from events",
    "t1": "select user_id run_id, row_number() over (partition by user_id order by event_id)-1 step, cast(value as double) loss, 20.0D+cast(value as double)/50.0D mean_psnr from events",
    "v1": "select event_id seq, ts, user_id%10 project_id, user_id, case event_type when 'view' then 'cursor_move' when 'click' then 'select_segment' when 'signup' then 'transform_start' when 'purchase' then 'transform_end' else 'disconnect' end type, event_id%5 segment_id, cast(value as double) pos_x from events",
    "e1": "select vec_id gid, embedding, label from embeddings",
    "m1": "select label segment_id, label pos, concat('object_', cast(label as varchar(9))) label, count(*)*10 area, label % 3 <> 0 visible from embeddings group by label",
    "members": "select label segment_id, vec_id gid from embeddings",
    "projects": "select c_custkey id, c_name name, case c_mktsegment when 'BUILDING' then 'ready' when 'MACHINERY' then 'failed' else 'created' end status, case when cast(c_acctbal as double) > 0 then cast(floor(cast(c_acctbal as double)) as bigint) end gaussian_count, c_custkey created_at from customer",
    "jobs": "select o_orderkey id, o_custkey project_id, case o_orderstatus when 'F' then 'completed' when 'O' then 'pending' else 'running' end status, o_orderdate created_at, cast(o_orderkey % 100 as double)/100.0D progress from orders",
    "scene_objects": "select p_partkey id, p_partkey % 150 project_id, p_size segment_id, p_name label, p_size % 4 <> 0 visible from part",
    "results": "select concat('m_', l_returnflag) method, case when l_suppkey % 9 < 4 then 'indoor' else 'outdoor' end dataset, concat('scene_', cast(l_suppkey % 9 as varchar(9))) scene, round(avg(cast(l_quantity as double)),6) mean_psnr, round(avg(cast(l_discount as double))*10.0D,6) mean_ssim, case when l_suppkey % 9 = 3 then null else round(avg(cast(l_tax as double)),6) end mean_lpips, round(sum(cast(l_extendedprice as double))/100000.0D,4) training_time_sec, count(*) num_gaussians, false is_published from lineitem group by l_returnflag, l_suppkey % 9",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sql: str) -> str:
    return re.sub(r"(\d+\.\d+)D\b", r"\1::double", sql.replace("element_at(embedding,", "list_extract(embedding,"))


def _needs(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for n in names:
        for m in ("c1",) if n == "k1" else ():
            if m not in out:
                out.append(m)
        if n not in out:
            out.append(n)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or one derived from the given ones."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = FIXTURES[name].replace("{", "{{").replace("}", "}}")
    used = [t for t in (*TABLES, "c1") if t != name and re.search(rf"(from|,)\s+{t}\b", sql)]
    for t in used:
        sql = re.sub(rf"((?:from|,)\s+){t}\b", rf"\1{{{t}}}", sql)
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})


def query(name: str, uses: tuple[str, ...] = (), sql: str | None = None):
    """Registers f(*tables, spark) under name; sql sees the same tables."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[table(spark, sf_dir, t) for t in uses])

        run.__name__ = name
        run.__doc__ = f.__doc__
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            ctes = ", ".join(f"{n} as ({duck(FIXTURES[n])})" for n in _needs(uses) if n in FIXTURES)
            body = duck(sql.strip())
            if body.lower().startswith("with "):
                SQL[name] = f"with {ctes}{', ' if ctes else ''}{body[5:]}"
            else:
                SQL[name] = f"with {ctes} {body}" if ctes else body
        return f

    return put
