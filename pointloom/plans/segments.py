"""Queries on segments, selections and edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edits, segments
from .registry import query
from .scene import rounded


def chosen():
    return F.col("gid") % 3 == 0



@query("f07_segment_members", ("g1", "members"), "select g1.gid from g1 where gid in (select gid from members where segment_id = 3)")
def f07(g1, members):
    return segments.members_of(g1, members, 3).select("gid")


@query("f13_manifest_response", ("m1", "members"), "select m1.segment_id, label, '[128, 128, 128]' color, visible, (select count(*) from members m where m.segment_id = m1.segment_id) n_gaussians from m1")
def f13(m1, members):
    return segments.response(m1, members).withColumn("color", F.concat(F.lit("["), F.array_join("color", ", "), F.lit("]")))


@query("s10_manifest_nested", ("m1", "members"), "select m1.segment_id, area, count(*) n, sum(gid)::bigint total from m1 join members using (segment_id) group by 1, 2")
def s10(m1, members):
    back, long = segments.unnest(segments.nest(m1, members))
    return back.join(long, "segment_id").groupBy("segment_id", "area").agg(F.count(F.lit(1)).alias("n"), F.sum("gid").alias("total"))


@query("j10_background", ("g1", "members"), "select 99 segment_id, gid from g1 where gid not in (select gid from members where segment_id < 7)")
def j10(g1, members):
    return segments.background(g1, members.where("segment_id < 7"), 99)


@query("u01_duplicate_segment", ("g1",), "select count(*) n, count(distinct gid) n_gid, max(gid)::bigint top, round(sum(x),6) sx from (select gid, x from g1 union all select (select max(gid) from g1) + row_number() over (order by gid), x + 0.5 from g1 where segment_id = 4)")
def u01(g1):
    return segments.duplicate(g1, F.col("segment_id") == 4).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("gid").alias("n_gid"), F.max("gid").alias("top"), F.round(F.sum("x"), 6).alias("sx"))


@query("u02_compose_scenes", ("g1",), "select gid, round(x,6) x, 'self' origin from g1 where segment_id = 1 union all select gid, round(x+2.0,6), 'other' from g1 where segment_id = 2")
def u02(g1):
    return rounded(segments.compose(g1.where("segment_id = 1"), g1, "other", F.col("segment_id") == 2, translation=(2.0, 0.0, 0.0)).select("gid", "x", "origin"), "x")


@query("u03_merge_segments", ("m1", "members"), "with k as (select max(segment_id) + 1 id from m1 where segment_id not in (1, 2, 5)), m as (select case when segment_id in (1, 2, 5) then id else segment_id end segment_id, gid from members, k) select m.segment_id, count(*) n, (select sum(area) from m1 where case when segment_id in (1,2,5) then (select id from k) else segment_id end = m.segment_id)::bigint area from m group by 1")
def u03(m1, members):
    s, m = segments.merge(m1, members, [1, 2, 5, 777])
    return m.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n")).join(s.select("segment_id", "area"), "segment_id")


@query("u04_selection_algebra", ("g1",), "with a as (select gid from g1 where gid % 3 = 0), b as (select gid from g1 where gid % 2 = 0) select 'add' op, gid from (select gid from a union select gid from b) union all select 'remove', gid from a where gid not in (select gid from b) union all select 'toggle', gid from ((select gid from a except select gid from b) union all (select gid from b except select gid from a))")
def u04(g1):
    a, b = g1.where("gid % 3 = 0"), g1.where("gid % 2 = 0")
    parts = [f(a, b).select(F.lit(n).alias("op"), "gid") for n, f in (("add", segments.select_add), ("remove", segments.select_remove), ("toggle", segments.select_toggle))]
    return parts[0].union(parts[1]).union(parts[2])


@query("w07_range_select", ("m1",), "select segment_id from m1 where segment_id between 2 and 5 or segment_id = 8")
def w07(m1):
    return segments.range_select(m1, m1.where("segment_id = 8"), 5, 2)


_CENTER = "p as (select avg(x) px, avg(y) py, avg(z) pz from g1 where {0})"


@query("e01_transform_rows", ("g1",), f"""
with {_CENTER.format("gid % 3 = 0")}
select gid, round(case when gid % 3 = 0 then -(y-py)*2.0+px+1.0 else x end,6) x, round(case when gid % 3 = 0 then (x-px)*2.0+py else y end,6) y, round(case when gid % 3 = 0 then (z-pz)*2.0+pz else z end,6) z,
round(case when gid % 3 = 0 then scale_0+ln(2.0) else scale_0 end,6) scale_0,
round(case when gid % 3 = 0 then (cos(pi()/4)*rot_0-sin(pi()/4)*rot_3)/sqrt(rot_0**2+rot_1**2+rot_2**2+rot_3**2) else rot_0 end,6) rot_0 from g1, p""")
def e01(g1):
    out = segments.transform(g1, chosen(), translation=(1.0, 0.0, 0.0), rotation=(0.0, 0.0, 90.0), scale=(2.0, 2.0, 2.0))
    return rounded(out.select("gid", "x", "y", "z", "scale_0", "rot_0"), "x", "y", "z", "scale_0", "rot_0")


@query("e02_batch_transform", ("g1",), f"with {_CENTER.format('segment_id in (2, 4)')} select gid, round(case when segment_id in (2,4) then (x-px)*-1.5+px else x end,6) x, round(case when segment_id in (2,4) then y-0.25 else y end,6) y, round(scale_0,6) scale_0 from g1, p")
def e02(g1):
    return rounded(segments.batch_transform(g1, [2, 4], translation=(0.0, -0.25, 0.0), scale=(-1.5, 1.0, 1.0)).select("gid", "x", "y", "scale_0"), "x", "y", "scale_0")


@query("e03_soft_delete", ("g1",), "select gid, case when gid % 5 = 0 then true when gid % 11 = 0 and gid % 2 = 0 then false else deleted end deleted from g1")
def e03(g1):
    undone = segments.flag_deleted(g1, g1.where("gid % 11 = 0 and gid % 2 = 0"), deleted=False)
    return segments.flag_deleted(undone, g1.where("gid % 5 = 0")).select("gid", "deleted")


@query("e04_lighting", ("e1",), "select gid, round((case when gid % 3 = 0 then list_extract(embedding,11)::double*1.5*0.9 else list_extract(embedding,11)::double end),6) f_dc_0, round(list_sum(list_transform(embedding[14:58], lambda v: (case when gid % 3 = 0 then (v*0.5)::float else v end)::double)),5) rest from e1")
def e04(e1):
    g = e1.select("gid", *[F.element_at("embedding", 11 + i).cast("double").alias(f"f_dc_{i}") for i in range(3)], F.slice("embedding", 14, 45).cast("array<float>").alias("f_rest"))
    out = segments.light(g, chosen(), brightness=1.5, tint=(0.9, 1.0, 1.1), sh_scale=0.5)
    return out.select("gid", F.round("f_dc_0", 6).alias("f_dc_0"), F.round(F.aggregate("f_rest", F.lit(0.0), lambda a, v: a + v), 5).alias("rest"))


@query("e05_set_attribute", ("g1",), "select gid, round(case when gid % 4 = 1 then gid * 0.5 else opacity end,6) opacity from g1")
def e05(g1):
    v = g1.where("gid % 4 = 1").select("gid", (F.col("gid") * 0.5).alias("value"))
    return rounded(segments.set_attribute(g1, "opacity", v).select("gid", "opacity"), "opacity")


@query("e06_visibility", ("g1", "members", "m1"), "select g1.gid, round(case when s.visible then opacity else -100.0 end,6) effective_opacity from g1 join members m on m.gid = g1.gid join m1 s on s.segment_id = m.segment_id")
def e06(g1, members, m1):
    return rounded(segments.effective_opacity(g1, members, m1).select("gid", "effective_opacity"), "effective_opacity")


@query("e07_delete_segment", ("g1", "m1", "members"), "select gid, deleted or segment_id = 6 as deleted, (select count(*) - 1 from m1) n_segments from g1")
def e07(g1, m1, members):
    g, s = segments.delete_segment(g1, m1, members, 6)
    return g.crossJoin(F.broadcast(s.agg(F.count(F.lit(1)).alias("n_segments")))).select("gid", "deleted", "n_segments")


@query("e08_split_segment", ("g1", "members"))
def e08(g1, members):
    return segments.split(g1, members, 3, 4).groupBy("segment_id").agg(F.count(F.lit(1)).alias("n"))


@query("e09_rename_segment", ("m1",), "select segment_id, case when segment_id = 4 then 'chair' else label end label from m1")
def e09(m1):
    return segments.rename(m1, 4, "chair").select("segment_id", "label")


@query("e11_index_map", ("g1", "m1", "members"), "select gid, coalesce((select max(pos) + 1 from m1 join members m using (segment_id) where m.gid = g1.gid and pos < 255 and segment_id <> 5), 0)::int as value from g1")
def e11(g1, m1, members):
    return segments.index_map(g1, m1.where("segment_id <> 5"), members)


@query("x11_palette", ("m1",), """
with h as (select segment_id, ((pos * 137.508) % 360.0) / 60.0 h from m1), l as (select segment_id, h, floor(200.0 * (1.0 - abs(h % 2.0 - 1.0)))::int mid from h)
select segment_id, (55 + case when h < 1 then 200 when h < 2 then mid when h < 4 then 0 when h < 5 then mid else 200 end)::int r, (55 + case when h < 1 then mid when h < 3 then 200 when h < 4 then mid else 0 end)::int g, (55 + case when h < 2 then 0 when h < 3 then mid when h < 5 then 200 else mid end)::int b from l""")
def x11(m1):
    c = segments.colored(m1)
    return c.select("segment_id", *[F.element_at("color", i + 1).alias(n) for i, n in enumerate("rgb")])


@query("x12_highlight", ("g1",), "select gid, case when deleted then '0,0,0,0' when gid % 17 = 0 then '255,100,100,200' when gid % 13 = 0 then '255,200,150,200' when gid % 7 = 0 then '200,255,220,255' when gid % 5 = 0 then '200,210,255,240' when gid % 3 = 0 then '180,180,180,220' else '255,255,255,255' end rgba from g1")
def x12(g1):
    parts = [g1.where(f"gid % {k} = 0").select("gid", F.lit(n).alias("kind")) for k, n in ((17, "eraser"), (13, "brush"), (7, "selected"), (5, "hovered"), (3, "dimmed"))]
    state = parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(parts[4])
    return segments.highlight(g1, state).select("gid", F.array_join("rgba", ",").alias("rgba"))


@query("j14_zero_shot_labels", ("e1",), """
with s as (select gid segment_id, embedding::double[] v from e1), w as (select label, arg_min(embedding::double[], gid) w from e1 group by label),
d as (select segment_id, label, 10.0 * list_dot_product(v, w) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(w, w)) s from s, w),
p as (select segment_id, label, exp(s) / sum(exp(s)) over (partition by segment_id) p from d)
select segment_id, case when max(p) >= 0.15 then arg_max(label, (p, label)) end as label, round(max(p), 3) confidence from p group by 1""")
def j14(e1):
    words = e1.groupBy("label").agg(F.min_by("embedding", "gid").alias("w"))
    return segments.classify(e1.select(F.col("gid").alias("segment_id"), F.col("embedding").alias("v")), words, temperature=10.0)


@query("e12_edit_log", ("g1",), "select gid, round(case when gid % 2 = 0 then opacity + 2.0 else opacity end,6) opacity, round(case when gid % 3 = 0 then x + 1.0 else x end,6) x from g1")
def e12(g1):
    log = edits.recorded(g1, 1, "brighten", "opacity", F.col("opacity") + 1.0, F.col("gid") % 2 == 0)
    g = edits.state(g1, log, [1])
    log = log.unionByName(edits.recorded(g, 2, "move", "x", F.col("x") + 1.0, F.col("gid") % 3 == 0))
    log = log.unionByName(edits.recorded(edits.state(g1, log, [1, 2]), 3, "brighten again", "opacity", F.col("opacity") + 1.0, F.col("gid") % 2 == 0))
    cursor = edits.Cursor().did(1).did(2).did(3).undone().redone()
    return rounded(edits.state(g1, log, cursor.active).select("gid", "opacity", "x"), "opacity", "x")


@query("e12_undo_redo_history", ("g1",), "select 1::int edit_id, 'brighten' as label, count(*) filter (where gid % 2 = 0) n from g1 union all select 4::int, 'hide', count(*) filter (where gid % 5 = 0) from g1")
def e12_history(g1):
    log = edits.recorded(g1, 1, "brighten", "opacity", F.col("opacity") + 1.0, F.col("gid") % 2 == 0).unionByName(edits.recorded(g1, 2, "move", "x", F.col("x") + 1.0, F.lit(True))).unionByName(edits.recorded(g1, 4, "hide", "opacity", F.lit(-100.0), F.col("gid") % 5 == 0))
    cursor = edits.Cursor().did(1).did(2).undone().did(4)
    return edits.history(log, cursor.active)
