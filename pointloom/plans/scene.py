"""Queries on splat tables: filters, statistics, spatial joins, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators import scene, spatial
from .registry import query

SIG = "(1.0/(1.0+exp(-greatest(-50.0,least(50.0,{}::double)))))"
XYZ = "round(x,6) x, round(y,6) y, round(z,6) z"


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("f01_box_query", ("g2",), "select gid from g2 where x between 10 and 20 and y between 5 and 15 and z between 3 and 9 and not deleted")
def f01(g2):
    return scene.query_box(g2, (10.0, 5.0, 3.0), (20.0, 15.0, 9.0)).select("gid")


@query("f02_sphere_query", ("g2",), "select gid from g2 where (x-25)*(x-25)+(y-20)*(y-20)+(z-6)*(z-6) <= 64 and not deleted")
def f02(g2):
    return scene.query_sphere(g2, (25.0, 20.0, 6.0), 8.0).select("gid")


@query("f03_delete_region", ("g2",), "select gid, deleted or not (x between 10 and 40 and y between 5 and 45 and z between 1 and 14) as deleted from g2")
def f03(g2):
    return scene.delete_region(g2, scene.in_box((10.0, 5.0, 1.0), (40.0, 45.0, 14.0)), outside=True).select("gid", "deleted")


@query("f04_prune_opacity", ("g1",), f"select gid from (select gid, case when max(abs(opacity)) over () > 1.5 then {SIG.format('opacity')} else opacity end p from g1) where p > 0.01")
def f04(g1):
    return scene.prune(g1, 0.01).select("gid")


@query("f04_prune_counts", ("g1",), f"select count(*) n_before, count(*) filter (where p > 0.5) n_after, count(*) filter (where not p > 0.5) n_pruned from (select {SIG.format('opacity')} p from g1)")
def f04_counts(g1):
    return scene.prune_counts(g1, 0.5, "logit")


@query("f05_soft_deleted", ("g1",), "select gid, opacity * 30.0 <= -50 as deleted from g1")
def f05(g1):
    return scene.mark_deleted(g1.withColumn("opacity", F.col("opacity") * 30.0)).select("gid", "deleted")


@query("f14_trim_rest", ("e1",), "select gid, round(sum(v), 6) total, count(*) n from (select gid, unnest(embedding[14:58])::double v from e1) group by gid")
def f14(e1):
    wide = e1.select("gid", *[F.element_at("embedding", 14 + i).cast("double").alias(f"f_rest_{i}") for i in range(51)])
    kept = scene.trim_rest(wide)
    rest = [c for c in kept.columns if c.startswith("f_rest_")]
    return kept.select("gid", F.round(sum((F.col(c) for c in rest[1:]), F.col(rest[0])), 6).alias("total"), F.lit(len(rest)).cast("long").alias("n"))


@query("l01_top_opacity", ("g2",), "select gid from (select gid, row_number() over (order by opacity desc, gid) r from g2) where r <= 1000")
def l01(g2):
    return scene.top_opacity(g2, 1000).select("gid")


@query("s05_to_splat_schema", ("g1",), "select gid, round((0.25-0.5)/0.28209479177387814,6) f_dc_0, round((abs(x)-0.5)/0.28209479177387814,6) f_dc_1, round(ln(0.8/(1-0.8+1e-8)),6) opacity, round(ln(abs(scale_0)+1e-8),6) scale_0, round(ln(0.01+1e-8),6) scale_1, 1.0::double rot_0 from g1")
def s05(g1):
    out = scene.to_splat_schema(g1.select("gid", "x", "y", "z", F.lit(0.25).alias("r"), F.abs("x").alias("g"), F.col("scale_0").alias("size_0")))
    return rounded(out.select("gid", "f_dc_0", "f_dc_1", "opacity", "scale_0", "scale_1", "rot_0"), "f_dc_0", "f_dc_1", "opacity", "scale_0", "scale_1")


@query("x01_sigmoid", ("g1",), f"select gid, round({SIG.format('opacity*20')},6) p from g1")
def x01(g1):
    return g1.select("gid", F.round(X.sigmoid(F.col("opacity") * 20.0), 6).alias("p"))


@query("x02_logit", ("g1",), "select gid, round(ln(p/(1-p+1e-8)),6) v from (select gid, abs(x)/2.0+0.01 p from g1)")
def x02(g1):
    return g1.select("gid", F.round(X.logit(F.abs("x") / 2.0 + 0.01), 6).alias("v"))


@query("x03_log_scale", ("g1",), "select gid, round(ln(abs(x)+1e-8),6) a, round(exp(scale_0),6) b from g1")
def x03(g1):
    return g1.select("gid", F.round(X.to_log_scale(F.col("x")), 6).alias("a"), F.round(X.from_log_scale(F.col("scale_0")), 6).alias("b"))


@query("x04_sh_color", ("g1",), "select gid, round((abs(x)-0.5)/0.28209479177387814,6) dc, round(greatest(0.0,least(1.0,f_dc_0*0.28209479177387814*8+0.5)),6) rgb from g1")
def x04(g1):
    return g1.select("gid", F.round(X.rgb_to_sh(F.abs("x")), 6).alias("dc"), F.round(X.sh_to_rgb(F.col("f_dc_0") * 8), 6).alias("rgb"))


@query("x05_rotate_about_pivot", ("g1",), """
with r as (select radians(30.0) a, radians(-20.0) b, radians(45.0) c), p as (select avg(x) px, avg(y) py, avg(z) pz from g1)
select gid, round(cos(c)*cos(b)*(x-px)+(cos(c)*sin(b)*sin(a)-sin(c)*cos(a))*(y-py)+(cos(c)*sin(b)*cos(a)+sin(c)*sin(a))*(z-pz)+px,6) x,
round(sin(c)*cos(b)*(x-px)+(sin(c)*sin(b)*sin(a)+cos(c)*cos(a))*(y-py)+(sin(c)*sin(b)*cos(a)-cos(c)*sin(a))*(z-pz)+py,6) y,
round(-sin(b)*(x-px)+cos(b)*sin(a)*(y-py)+cos(b)*cos(a)*(z-pz)+pz,6) z from g1, r, p""")
def x05(g1):
    pivot = F.broadcast(g1.agg(*[F.avg(a).alias(f"p{a}") for a in scene.AXES]))
    d = g1.crossJoin(pivot)
    out = X.applied(X.rotation_matrix((30.0, -20.0, 45.0)), tuple(F.col(a) - F.col(f"p{a}") for a in scene.AXES))
    return d.select("gid", *[F.round(c + F.col(f"p{a}"), 6).alias(a) for a, c in zip(scene.AXES, out, strict=True)])


@query("x06_compose_quaternion", ("g1",), """
with h as (select radians(30.0)/2 a, radians(-20.0)/2 b, radians(45.0)/2 c),
q as (select cos(c)*cos(b)*cos(a)+sin(c)*sin(b)*sin(a) w, cos(c)*cos(b)*sin(a)-sin(c)*sin(b)*cos(a) i, cos(c)*sin(b)*cos(a)+sin(c)*cos(b)*sin(a) j, sin(c)*cos(b)*cos(a)-cos(c)*sin(b)*sin(a) k from h),
m as (select gid, w*rot_0-i*rot_1-j*rot_2-k*rot_3 a, w*rot_1+i*rot_0+j*rot_3-k*rot_2 b, w*rot_2-i*rot_3+j*rot_0+k*rot_1 c, w*rot_3+i*rot_2-j*rot_1+k*rot_0 d from g1, q)
select gid, round(a/sqrt(a*a+b*b+c*c+d*d),6) rot_0, round(b/sqrt(a*a+b*b+c*c+d*d),6) rot_1, round(c/sqrt(a*a+b*b+c*c+d*d),6) rot_2, round(d/sqrt(a*a+b*b+c*c+d*d),6) rot_3 from m""")
def x06(g1):
    out = X.composed(X.rotation_quaternion((30.0, -20.0, 45.0)), tuple(F.col(f"rot_{i}") for i in range(4)))
    return g1.select("gid", *[F.round(c, 6).alias(f"rot_{i}") for i, c in enumerate(out)])


@query("a01_scene_statistics", ("g1",), f"""
with p as (select *, {SIG.format("opacity")} p from g1),
m as (select avg(x) mx, stddev_pop(x) sx, avg(y) my, stddev_pop(y) sy, avg(z) mz, stddev_pop(z) sz from g1),
l as (select unnest([scale_0, scale_1, scale_2]) s from g1),
v as (select (max(x)-min(x))*(max(y)-min(y))*(max(z)-min(z)) v from g1)
select (select count(*) from p) n, (select count(*) from p where p > 0.1) n_effective,
round((select avg((p<0.05)::int) from p),6) transparent, round((select avg((p>0.95)::int) from p),6) opaque,
round((select avg(p) from p),6) opacity_mean, round((select stddev_pop(p) from p),6) opacity_std,
round((select v from v),6) volume, round((select count(*) from p)/(select v from v),4) density,
round((select avg(s) from l),6) scale_mean, round((select stddev_pop(s) from l),6) scale_std, round((select min(s) from l),6) scale_min, round((select max(s) from l),6) scale_max,
round((select avg((abs(x-mx)>3*sx or abs(y-my)>3*sy or abs(z-mz)>3*sz)::int) from g1, m),6) outliers""")
def a01(g1):
    out = scene.statistics(g1)
    return rounded(out.withColumn("density", F.round("density", 4)), *[c for c in out.columns if c not in ("n", "n_effective", "density")])


@query("a02_bounds", ("g2",), "select count(*) n, count(*) filter (where deleted) n_deleted, min(x) min_x, max(x) max_x, round(min(y),6) min_y, round(max(y),6) max_y, round(min(z),6) min_z, round(max(z),6) max_z from g2")
def a02(g2):
    return rounded(scene.bounds(g2), "min_y", "max_y", "min_z", "max_z")


@query("a03_segment_stats", ("g1", "m1"), "select m.segment_id, count(g.gid) n, coalesce(round(avg(x),6),0) cx, coalesce(round(avg(y),6),0) cy, coalesce(round(avg(z),6),0) cz, coalesce(round(min(x),6),0) min_x, coalesce(round(max(x),6),0) max_x from (select segment_id + 2 segment_id from m1) m left join g1 g on g.segment_id = m.segment_id group by 1")
def a03(g1, m1):
    from ..operators.segments import segment_stats

    out = segment_stats(g1, m1.select((F.col("segment_id") + 2).alias("segment_id")))
    return rounded(out, "cx", "cy", "cz", "min_x", "max_x").select("segment_id", "n", "cx", "cy", "cz", "min_x", "max_x")


@query("a04_sampled_centroid", ("g1",), "with n as (select greatest(1, count(*)//100) s from g1), p as (select g1.* from g1, n where gid % s = 0), c as (select avg(x) cx, avg(y) cy, avg(z) cz from p) select round(cx,6) cx, round(cy,6) cy, round(cz,6) cz, round(max(sqrt((x-cx)**2+(y-cy)**2+(z-cz)**2)),6) radius from p, c group by cx, cy, cz")
def a04(g1):
    return rounded(scene.sampled_centroid(g1, 100), "cx", "cy", "cz", "radius")


NN_SQL = "(select a.gid, min(sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2)) d from {0} a join {0} b on a.gid <> b.gid group by a.gid)"


@query("a05_cleanup", ("g1",), f"""
with o as (select *, {SIG.format("opacity")} p from g1), one as (select * from o where p >= 0.005),
m as (select count(*) n, avg(scale_0) m0, stddev_pop(scale_0) s0, avg(scale_1) m1, stddev_pop(scale_1) s1, avg(scale_2) m2, stddev_pop(scale_2) s2 from one),
two as (select one.* from one, m where n <= 100 or not (scale_0 > m0+3*s0 or scale_1 > m1+3*s1 or scale_2 > m2+3*s2)),
nn as {NN_SQL.format("two")}, t as (select median(d) mid, count(*) n from nn)
select two.gid from two join nn using (gid), t where not (d > 5*mid and p <= 0.8 and n > 100)""")
def a05(g1):
    return spatial.cleanup(g1).select("gid")


@query("a06_robust_bounds", ("g2",), "select " + ", ".join(f"round(quantile_cont({a},0.02)-0.5,4) low_{a}, round(quantile_cont({a},0.98)+0.5,4) high_{a}" for a in "xyz") + " from g2")
def a06(g2):
    out = scene.robust_bounds(g2)
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


@query("a17_distribution_metrics", ("g1",), f"with p as (select *, greatest(1e-6,least(1-1e-6,{SIG.format('opacity')})) p from g1) select round(avg(-(p*ln(p)+(1-p)*ln(1-p))),6) opacity_entropy, round((avg(exp(scale_0))+avg(exp(scale_1))+avg(exp(scale_2)))/3,6) mean_scale, round(avg(exp(least(scale_0,scale_1,scale_2))),6) mean_flatness from p")
def a17(g1):
    out = scene.distribution_metrics(g1)
    return rounded(out, *out.columns)


@query("j01_nearest", ("g1",), "with q as (select * from g1 where gid % 7 = 0), p as (select * from g1 where gid % 7 <> 0), d as (select q.gid, p.gid other, sqrt((q.x-p.x)**2+(q.y-p.y)**2+(q.z-p.z)**2) d from q, p) select gid, arg_min(other, (d, other)) other, round(min(d),6) d from d group by gid")
def j01(g1):
    return rounded(spatial.nearest_join(g1.where("gid % 7 = 0"), g1.where("gid % 7 <> 0")), "d")


@query("j02_self_nearest", ("g1",), f"select gid, round(d,6) d from {NN_SQL.format('g1')}")
def j02(g1):
    return rounded(spatial.nn_distance(g1).select("gid", "d"), "d")


@query("j02_large_cloud", ("g2",))
def j02_large(g2):
    """The self-nearest distances of a cloud that grows with lineitem."""
    return rounded(spatial.nn_distance(g2).select("gid", "d"), "d")


KNN3 = "(select gid, avg(d) d from (select a.gid, sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) d, row_number() over (partition by a.gid order by (a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2, b.gid) r from g1 a join g1 b on a.gid <> b.gid and (a.x<>b.x or a.y<>b.y or a.z<>b.z)) where r <= 3 group by gid)"


@query("j03_mean_knn", ("g1",), f"select gid, round(d,6) d from {KNN3}")
def j03(g1):
    return rounded(spatial.mean_knn_distance(g1), "d")


@query("e14_init_from_points", ("g1",), f"select g1.gid, round(ln(greatest(d,1e-6)),6) scale_0, 0.5::double opacity, round((abs(g1.x)-0.5)/0.28209479177387814,6) f_dc_0, 1.0::double rot_0, 45::int n_rest from g1 join {KNN3} k on k.gid = g1.gid")
def e14(g1):
    out = spatial.init_from_points(g1.select("gid", "x", "y", "z", F.abs("x").alias("r"), F.lit(0.2).alias("g"), F.lit(0.3).alias("b")))
    return rounded(out.select("gid", "scale_0", "opacity", "f_dc_0", "rot_0", F.size("f_rest").alias("n_rest")), "scale_0", "f_dc_0")


@query("j04_radius_pairs", ("g2",), "select a.gid a_gid, b.gid b_gid from g2 a join g2 b on a.gid < b.gid and abs(a.x-b.x) <= 0.5 and (a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2 <= 0.25")
def j04(g2):
    return spatial.close_pairs(g2, 0.5).select("a_gid", "b_gid")


@query("j05_deduplicate", ("g2",))
def j05(g2):
    return spatial.deduplicate(g2, 0.3).select("gid")


@query("j15_anchor_isolation", ("g1",), "select a.gid, round(min(d) filter (where d >= 1e-8),6) d from (select a.gid, sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) d from g1 a, (select * from g1 order by md5('0:' || gid), gid limit 4096) b) a group by a.gid")
def j15(g1):
    return rounded(spatial.anchor_isolation(g1, g1), "d")


@query("l10_repeatable_sample", ("g1",), "select gid from g1 order by md5('7:' || gid), gid limit 100")
def l10(g1):
    return scene.repeatable_sample(g1, 100, seed=7).select("gid")
