"""Queries on cameras, masks and pixels."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators import camera, masks, pixels, scene
from .registry import query
from .scene import SIG, rounded

RES, FOCAL = 64.0, 54.4
#: World to camera and to pixels, for g (points) and c (cameras).
CAM = "select {cols}, r00*(x-t0)+r10*(y-t1)+r20*(z-t2) xc, r01*(x-t0)+r11*(y-t1)+r21*(z-t2) yc, r02*(x-t0)+r12*(y-t1)+r22*(z-t2) zc from {src}"
SEEN = f"""cam as ({CAM.format(cols="gid, pos, frame, fx, fy, cx, cy, width, height", src="g1, c1")}),
uv as (select gid, pos, frame, cx, cy, zc, fx*xc/zc+cx u, fy*yc/zc+cy v from cam where zc > 0.01),
seen as (select * from uv where u >= 0 and u < 64 and v >= 0 and v < 64)"""
IOU = "0.7+0.05*(mask_id % 3)"


def ious(k1):
    return k1.select("pos", "mask_id", (F.lit(0.7) + F.lit(0.05) * (F.col("mask_id") % 3)).alias("predicted_iou")).distinct()


@query("f06_visible", ("g1", "c1"), f"with {SEEN} select gid, pos, round(u,6) u, round(v,6) v from seen")
def f06(g1, c1):
    return rounded(camera.project(g1, c1, RES, FOCAL).select("gid", "pos", "u", "v"), "u", "v")


@query("j07_project_own_intrinsics", ("g1", "c1"), f"with {SEEN} select pos, count(*) n, round(sum(u),4) su, round(sum(zc),4) sz from seen group by pos")
def j07(g1, c1):
    return camera.project(g1, c1).groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("u"), 4).alias("su"), F.round(F.sum("depth"), 4).alias("sz"))


@query("j08_mask_hits", ("g1", "c1", "k1"), f"with {SEEN} select s.gid, s.pos, mask_id from seen s join k1 k on k.pos = s.pos and k.u = floor(s.u) and k.v = floor(s.v)")
def j08(g1, c1, k1):
    return camera.mask_hits(camera.project(g1.select("gid", "x", "y", "z"), c1.drop("frame"), RES, FOCAL).select("gid", "pos", "u", "v"), k1, 64, 64).select("gid", "pos", "mask_id")


@query("j08_runs", ("g1", "c1", "k1"), f"with {SEEN} select s.gid, s.pos, mask_id from seen s join k1 k on k.pos = s.pos and k.u = floor(s.u) and k.v = floor(s.v) where (k.u+k.v) % (mask_id+2) <> 0")
def j08_runs(g1, c1, k1):
    """The same from run lengths: an interval join on image rows."""
    lists = masks.row_lists(masks.mask_runs(k1.where("(u+v) % (mask_id+2) <> 0")))
    seen = camera.project(g1.select("gid", "x", "y", "z"), c1.drop("frame"), RES, FOCAL).select("gid", "pos", "u", "v")
    return masks.run_hits(seen, lists, 64, 64).select("gid", "pos", "mask_id")


@query("a21_boxes_from_runs", ("k1",), "select pos, mask_id, count(*) area, min(u) x, min(v) y, max(u)-min(u)+1 w, max(v)-min(v)+1 h from k1 where (u*v) % 5 <> 0 group by 1, 2")
def a21_runs(k1):
    return masks.run_boxes(masks.mask_runs(k1.where("(u*v) % 5 <> 0")))


@query("j07_all_cameras", ("g1", "c2"), f"with {SEEN.replace('c1', 'c2')} select pos, count(*) n, round(sum(u),4) su, round(sum(zc),4) sz from seen group by pos")
def j07_all(g1, c2):
    """A camera for each supplier; blocks that a frustum doesn't touch aren't looked at."""
    return camera.view_sums(g1, c2).select("pos", "n", F.round("u", 4).alias("su"), F.round("depth", 4).alias("sz"))


@query("a07_multi_view_vote", ("g1", "c1", "k1"), f"""
with {SEEN}, votes as (select s.gid, mask_id, round(sum({IOU}),9) votes from seen s join k1 k on k.pos = s.pos and k.u = floor(s.u) and k.v = floor(s.v) group by 1, 2),
best as (select gid, arg_max(mask_id, (votes, -mask_id)) s, max(votes) votes from votes group by gid)
select g1.gid, coalesce(s, -1) segment_id, coalesce(votes, 0.0) votes from g1 left join best using (gid)""")
def a07(g1, c1, k1):
    """The flagship: project, look masks up, vote."""
    return camera.multi_view_vote(g1, c1, k1, ious(k1), RES, FOCAL)


@query("a26_segment_coverage", ("g1", "c1", "k1"), f"""
with {SEEN}, votes as (select s.gid, mask_id, round(sum({IOU}),9) votes from seen s join k1 k on k.pos = s.pos and k.u = floor(s.u) and k.v = floor(s.v) group by 1, 2),
best as (select gid, arg_max(mask_id, (votes, -mask_id)) s from votes group by gid)
select coalesce(s, -1) segment_id, count(*) n from g1 left join best using (gid) group by 1""")
def a26(g1, c1, k1):
    return camera.coverage(camera.multi_view_vote(g1, c1, k1, ious(k1), RES, FOCAL))


@query("a08_visibility_count", ("g1", "c1"), f"with {SEEN} select g1.gid, (select count(*) from seen s where s.gid = g1.gid) n_views from g1")
def a08(g1, c1):
    return camera.visibility(g1, c1, RES, FOCAL)


@query("a09_floaters", ("g1", "c1"), f"""
with {SEEN}, n as (select gid, count(distinct pos) n from seen group by gid), t as (select count(distinct pos) total from seen),
an as (select * from g1 order by md5('0:' || gid), gid limit 4096),
d as (select a.gid, min(sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2)) filter (where sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) >= 1e-8) d from g1 a, an b group by a.gid), m as (select median(d) mid from d)
select g1.gid, (coalesce(n.n,0)::double/greatest(total,1) < 0.9 or coalesce(d > 1.5*mid, false)) and {SIG.format('opacity')} <= 0.8 and total >= 5 as floater from g1 left join n using (gid) left join d using (gid), t, m""")
def a09(g1, c1):
    seen = camera.project(g1, c1, RES, FOCAL).select(F.col("pos").alias("view"), "gid")
    return camera.floaters(g1, seen, g1, least_ratio=0.9, far=1.5, least_views=5)


@query("e10_assign_primary", ("g1", "c1", "k1"), f"with {SEEN} select g1.gid, coalesce(max(mask_id) filter (where mask_id <> 2), -1) segment_id from g1 left join (select s.gid, mask_id from seen s join k1 k on k.pos = s.pos and k.u = floor(s.u) and k.v = floor(s.v) where s.pos = 3) h using (gid) group by g1.gid")
def e10(g1, c1, k1):
    order = k1.select("mask_id").distinct().where("mask_id <> 2").select("mask_id", F.col("mask_id").alias("segment_id"), F.col("mask_id").alias("seg_pos"))
    return camera.assign_primary(g1, c1.where("pos = 3"), k1, order, RES, FOCAL)


_PAIRS = "near as (select a.pos, arg_min(b.pos, (round((a.t0-b.t0)**2+(a.t1-b.t1)**2+(a.t2-b.t2)**2,9), b.pos)) nn from c1 a, c1 b where a.pos <> b.pos group by a.pos), prs as (select distinct least(pos,nn) a, greatest(pos,nn) b from near)"


@query("j06_nearest_camera_pairs", ("c1",), f"with {_PAIRS}, i as (select a, b, row_number() over (order by a, b) - 1 i, count(*) over () n from prs), p as (select distinct floor(k * n / 3.0) i from i, range(3) t(k)) select a, b from i where n <= 3 or i in (select i from p)")
def j06(c1):
    return camera.nearest_pairs(c1, 3)


@query("j09_match_cameras", ("f1", "c1"), "with f as (select filename, idx from f1) select filename, idx, coalesce((select min(pos) from c1 where frame like '%' || filename || '%'), (select pos from c1 where pos = regexp_extract(filename, '_(\\d+)\\.[^.]*$', 1)::int)) pos from f")
def j09(f1, c1):
    return camera.match_cameras(f1.select("filename", "idx"), c1)


@query("j13_best_camera", ("g1", "c1"), f"""
with {SEEN}, s as (select *, round(1-sqrt(((u-cx)/32)**2+((v-cy)/32)**2),9) score from seen)
select gid, arg_max(frame, (score, -pos)) frame, round_even(arg_max(u, (score, -pos)),0)::int u, round_even(arg_max(v, (score, -pos)),0)::int v, max(score) score from s where score > -1 group by gid""")
def j13(g1, c1):
    return camera.best_camera(g1.select("gid", "x", "y", "z"), c1, RES)


@query("l02_masks_by_area", ("k1",), "with a as (select pos, mask_id, count(*) area from k1 where (u+v) % (mask_id+2) <> 0 group by 1, 2) select *, row_number() over (partition by pos order by area desc, mask_id) - 1 as rank from a")
def l02(k1):
    return camera.ordered_masks(k1.where("(u+v) % (mask_id+2) <> 0"))


@query("l03_primary_frame", ("k1",), "with n as (select pos, count(distinct mask_id) n from k1 where mask_id <= pos or pos = 5 group by pos) select arg_max(pos, (n, -pos)) pos from n")
def l03(k1):
    return camera.primary_frame(k1.where("mask_id <= pos or pos = 5"))


@query("a21_mask_boxes", ("k1",), "select pos, mask_id, count(*) area, min(u) x, min(v) y, max(u)-min(u)+1 w, max(v)-min(v)+1 h from k1 where (u*v) % 5 <> 0 group by 1, 2")
def a21(k1):
    return camera.mask_boxes(k1.where("(u*v) % 5 <> 0"))


#: Camera-to-world matrices with shear and unequal scales, one a row of g1.
SHEARED = [["2.0", "x", "0.0", "scale_0"], ["0.0", "1.0", "y", "scale_1"], ["0.0", "0.0", "1.0 + abs(z)", "scale_2"], ["0.0", "0.0", "0.0", "1.0"]]


@query("x07_general", ("g1",), """
with m as (select gid, x a, y b, 1.0+abs(z) s, scale_0 tx, scale_1 ty, scale_2 tz from g1), l as (select *, -a/2 i01, a*b/(2*s) i02, -b/s i12, 1/s i22 from m)
select gid, round(0.5,6)::double i00, round(i01,6) i01, round(i02,6) i02, round(-(tx/2+i01*ty+i02*tz),6) i03, round(i12,6) i12, round(-(ty+i12*tz),6) i13, round(i22,6) i22, round(-i22*tz,6) i23, 1.0::double i33 from l""")
def x07_general(g1):
    """World-to-camera of matrices that aren't rigid."""
    inv = X.inverse([[F.expr(e).cast("double") for e in row] for row in SHEARED])
    cells = [(0, 0), (0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3)]
    return g1.select("gid", *[F.round(inv[i][j], 6).alias(f"i{i}{j}") for i, j in cells])


@query("x07_camera_inverse", ("c1",), "select pos, round(-(r00*t0+r10*t1+r20*t2),6) i0, round(-(r01*t0+r11*t1+r21*t2),6) i1, round(-(r02*t0+r12*t1+r22*t2),6) i2, round(r10,6) r01 from c1")
def x07(c1):
    zero = (F.lit(0.0), F.lit(0.0), F.lit(0.0))
    i = X.camera_space(zero, *camera.pose())
    return c1.select("pos", *[F.round(c, 6).alias(f"i{k}") for k, c in enumerate(i)], F.round("r10", 6).alias("r01"))


@query("x08_project_unproject", ("c1", "d1"), "select view, round(sum(abs((u-16.0)/27.2*depth*27.2/depth+16.0-u)),6) err, round(sum((u-16.0)/27.2*depth),4) sx from d1 group by view")
def x08(c1, d1):
    x, y = (F.col("u") - 16.0) / 27.2 * F.col("depth"), (F.col("v") - 16.0) / 27.2 * F.col("depth")
    u, _ = X.pinhole(x, y, F.col("depth"), F.lit(27.2), F.lit(27.2), F.lit(16.0), F.lit(16.0))
    return d1.groupBy("view").agg(F.round(F.sum(F.abs(u - F.col("u"))), 6).alias("err"), F.round(F.sum(x), 4).alias("sx"))


@query("x09_matrix_to_quaternion", ("c1",), """
with m as (select *, r00+r11+r22 tr from c1), q as (select pos, case when tr > 0 then [sqrt(tr+1)/2, (r21-r12)/(2*sqrt(tr+1)), (r02-r20)/(2*sqrt(tr+1)), (r10-r01)/(2*sqrt(tr+1))]
when r00 > r11 and r00 > r22 then [(r21-r12)/(2*sqrt(1+r00-r11-r22)), sqrt(1+r00-r11-r22)/2, (r01+r10)/(2*sqrt(1+r00-r11-r22)), (r02+r20)/(2*sqrt(1+r00-r11-r22))]
when r11 > r22 then [(r02-r20)/(2*sqrt(1+r11-r00-r22)), (r01+r10)/(2*sqrt(1+r11-r00-r22)), sqrt(1+r11-r00-r22)/2, (r12+r21)/(2*sqrt(1+r11-r00-r22))]
else [(r10-r01)/(2*sqrt(1+r22-r00-r11)), (r02+r20)/(2*sqrt(1+r22-r00-r11)), (r12+r21)/(2*sqrt(1+r22-r00-r11)), sqrt(1+r22-r00-r11)/2] end q from m)
select pos, round(q[1],6) w, round(q[2],6) x, round(q[3],6) y, round(q[4],6) z from q""")
def x09(c1):
    q = X.quaternion_of(camera.pose()[0])
    return c1.where("pos >= 0").select("pos", *[F.round(c, 6).alias(n) for n, c in zip("wxyz", q, strict=True)])


@query("s07_cameras_defaults", ("c1",), "select pos, frame, coalesce(case when pos % 2 = 0 then fx end, 380.8) fx, coalesce(null, 224.0)::double cx, 448 width, round(t0,6) t0 from c1")
def s07(c1):
    from ..sources.manifests import flat_cameras

    m = F.array(*[F.array(*[F.col(f"r{i}{j}") for j in range(3)], F.col(f"t{i}")) for i in range(3)])
    cam = F.struct("pos", "frame", F.when(F.col("pos") % 2 == 0, F.col("fx")).alias("fx"), m.alias("transform"))
    doc = c1.agg(F.sort_array(F.collect_list(cam)).alias("cameras")).withColumn("resolution", F.lit(None).cast("int"))
    return rounded(flat_cameras(doc).select("pos", "frame", "fx", "cx", "width", "t0"), "t0")


# Pixels.

CAM32 = "cams as (select pos, r00,r01,r02,r10,r11,r12,r20,r21,r22,t0,t1,t2, fx/2 fx, fy/2 fy, cx/2 cx, cy/2 cy, 32 width, 32 height from c1)"


def cams32(c1):
    return c1.withColumns({c: F.col(c) / 2 for c in ("fx", "fy", "cx", "cy")}).withColumns({"width": F.lit(32), "height": F.lit(32)})


@query("a10_psnr", ("d1",), "with m as (select view, avg(e) mse from (select view, unnest([(r-gt_r)**2,(g-gt_g)**2,(b-gt_b)**2]) e from d1) group by view) select view, round(-10*log10(mse),6) psnr from m")
def a10(d1):
    return rounded(pixels.psnr(d1), "psnr")


@query("a10_psnr_variants", ("d1",), "with m as (select view, avg(e) mse from (select view, unnest([(g-gt_g)**2]) e from d1) group by view) select view, round(-10*log10(greatest(mse,1e-10)),6) psnr, 'floor' variant from m union all select view, round(-10*log10(mse+1e-8),6), 'guard' from m")
def a10_variants(d1):
    same = d1.select("view", *[F.col(f"{p}g").alias(f"{p}{c}") for c in "rgb" for p in ("", "gt_")])
    return pixels.psnr(same, "floor").withColumn("variant", F.lit("floor")).union(pixels.psnr(same, "guard").withColumn("variant", F.lit("guard"))).withColumn("psnr", F.round("psnr", 6))


_S = "sum(w*{0})"
_W1 = [math.exp(-((i - 5) ** 2) / 4.5) for i in range(11)]


@query("a11_ssim", ("d1",), f"""
with s as (select view, u, v, c, a, b from (select view, u, v, unnest(['r','g','b']) c, unnest([r,g,b]) a, unnest([gt_r,gt_g,gt_b]) b from d1)),
k as (select i-5 o, exp(-((i-5)**2)/4.5)/{sum(_W1)!r} w from range(11) t(i)), w as (select x.o du, y.o dv, x.w*y.w w from k x, k y),
m as (select p.view, p.u, p.v, p.c, {_S.format("q.a")} ma, {_S.format("q.b")} mb, {_S.format("q.a*q.a")} aa, {_S.format("q.b*q.b")} bb, {_S.format("q.a*q.b")} ab
from s p cross join w join s q on q.view = p.view and q.c = p.c and q.u = p.u + du and q.v = p.v + dv group by 1,2,3,4)
select view, round(avg((2*ma*mb+1e-4)*(2*(ab-ma*mb)+9e-4)/((ma*ma+mb*mb+1e-4)*(aa-ma*ma+bb-mb*mb+9e-4))),6) ssim from m group by view""")
def a11(d1):
    return rounded(pixels.ssim(d1), "ssim")


@query("w08_gradient", ("d1",), "select view, u, v, round(sqrt((coalesce(lead(depth) over a, depth)-coalesce(lag(depth) over a, depth))**2+(coalesce(lead(depth) over b, depth)-coalesce(lag(depth) over b, depth))**2),6) gradient from d1 window a as (partition by view, v order by u), b as (partition by view, u order by v)")
def w08(d1):
    return d1.select("view", "u", "v", F.round(pixels.gradient(F.col("depth")), 6).alias("gradient"))


_GRAD = "sqrt((coalesce(lead({0}) over a, {0})-coalesce(lag({0}) over a, {0}))**2+(coalesce(lead({0}) over b, {0})-coalesce(lag({0}) over b, {0}))**2)"
EDGES = f"""gr as (select *, 0.299*r+0.587*g+0.114*b gy from d1), ed as (select view, alpha, {_GRAD.format("gy")} ga, {_GRAD.format("depth")} gd from gr window a as (partition by view, v order by u), b as (partition by view, u order by v)),
al as (select view, greatest(corr(ga,gd),0) alignment from ed where alpha > 0.5 group by view having count(*) >= 100 and stddev_pop(ga) >= 1e-8 and stddev_pop(gd) >= 1e-8)"""


@query("a14_edge_alignment", ("d1",), f"with {EDGES} select view, round(alignment,6) alignment from al")
def a14(d1):
    return rounded(pixels.edge_alignment(d1), "alignment")


COVER = "cv as (select avg(m) mean_alpha, avg(h) frac_holes, avg(c) frac_well_covered, stddev_pop(m) alpha_std, count(*) n_views from (select view, avg(alpha) m, avg((alpha<0.5)::int) h, avg((alpha>0.9)::int) c from d1 group by view))"


@query("a15_alpha_coverage", ("d1",), f"with {COVER} select round(mean_alpha,6) mean_alpha, round(frac_holes,6) frac_holes, round(frac_well_covered,6) frac_well_covered, round(alpha_std,6) alpha_std, n_views from cv")
def a15(d1):
    return rounded(pixels.alpha_coverage(d1), "mean_alpha", "frac_holes", "frac_well_covered", "alpha_std")


MET = f"""{CAM32}, {_PAIRS},
s0 as (select prs.a, prs.b, u, v, (u-c.cx)/c.fx*depth xc, (v-c.cy)/c.fy*depth yc, depth zc from d1 join prs on a = view join cams c on c.pos = a where u % 4 = 0 and v % 4 = 0 and alpha > 0.5),
s1 as (select a, b, u su, v sv, r00*xc+r01*yc+r02*zc+t0 x, r10*xc+r11*yc+r12*zc+t1 y, r20*xc+r21*yc+r22*zc+t2 z, count(*) over (partition by a, b) n0 from s0 join cams on pos = a),
s2 as (select a, b, su, sv, n0, fx, fy, cx, cy, r00*(x-t0)+r10*(y-t1)+r20*(z-t2) xb, r01*(x-t0)+r11*(y-t1)+r21*(z-t2) yb, r02*(x-t0)+r12*(y-t1)+r22*(z-t2) zb from s1 join cams on pos = b),
s3 as (select a, b, su, sv, n0, zb, fx*xb/zb+cx ub, fy*yb/zb+cy vb, count(*) over (partition by a, b) n1 from s2 where zb > 0.01),
s4 as (select *, count(*) over (partition by a, b) n2 from s3 where ub >= 0 and ub < 31 and vb >= 0 and vb < 31),
s5 as (select a, b, su, sv, zb, floor(ub) iu, floor(vb) iv, ub-floor(ub) fu, vb-floor(vb) fv from s4 where n0 >= 10 and n1 >= 10 and n2 >= 10),
s6 as (select s5.*, du, dv, (case when du = 1 then fu else 1-fu end)*(case when dv = 1 then fv else 1-fv end) w from s5, range(2) x(du), range(2) y(dv)),
s7 as (select s6.a, s6.b, su, sv, any_value(zb) z, sum(w*d.depth) depth, sum(w*d.alpha) alpha from s6 join d1 d on d.view = s6.b and d.u = iu+du and d.v = iv+dv group by 1,2,3,4),
met as (select * from (select *, count(*) over (partition by a, b) n from s7 where round(alpha,9) > 0.5) where n >= 10)"""
DEPTH = "dp as (select (select coalesce(avg(ok),0) from (select avg((abs(z-depth)/(depth+1e-6) < 0.2)::int) ok from met group by a, b)) pct_consistent, (select count(*) from (select distinct a, b from met)) n_pairs, coalesce(avg(abs(z-depth)),0) mean_abs_depth_error, coalesce(median(abs(z-depth)),0) median_abs_depth_error from met)"


@query("j11_depth_reprojection", ("c1", "d1"), f"with {MET} select a, b, count(*) n, round(sum(z),4) sz, round(sum(depth),4) sd from met group by a, b")
def j11(c1, d1):
    met = pixels.depth_pairs(d1, cams32(c1), camera.nearest_pairs(c1))
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("z"), 4).alias("sz"), F.round(F.sum("depth"), 4).alias("sd"))


@query("a13_depth_consistency", ("c1", "d1"), f"with {MET}, {DEPTH} select round(pct_consistent,6) pct_consistent, n_pairs, round(mean_abs_depth_error,6) mean_abs_depth_error, round(median_abs_depth_error,6) median_abs_depth_error from dp")
def a13(c1, d1):
    met = pixels.depth_pairs(d1, cams32(c1), camera.nearest_pairs(c1))
    return rounded(pixels.depth_consistency(met, 0.2), "pct_consistent", "mean_abs_depth_error", "median_abs_depth_error")


@query("a16_health_score", ("g1", "c1", "d1"), f"""
with {MET}, {DEPTH}, {EDGES}, {COVER}, st as (select (select avg(({SIG.format('opacity')}<0.05)::int) from g1) transparent,
(select avg((abs(x-mx)>3*sx or abs(y-my)>3*sy or abs(z-mz)>3*sz)::int) from g1, (select avg(x) mx, stddev_pop(x) sx, avg(y) my, stddev_pop(y) sy, avg(z) mz, stddev_pop(z) sz from g1)) outliers),
p as (select pct_consistent g, (select coalesce(avg(alignment),0) from al) e, mean_alpha c, 1-outliers cl, 1-transparent o from dp, cv, st)
select round(30*g+20*e+20*c+15*cl+15*o,1) score, round(g,4) geometry, round(e,4) edge_alignment, round(c,4) coverage, round(cl,4) cleanliness, round(o,4) opacity_health from p""")
def a16(g1, c1, d1):
    met = pixels.depth_pairs(d1, cams32(c1), camera.nearest_pairs(c1))
    return pixels.health_score(scene.statistics(g1), pixels.depth_consistency(met, 0.2), pixels.edge_summary(pixels.edge_alignment(d1)), pixels.alpha_coverage(d1))


@query("a17_image_losses", ("d1",), """
with t as (select abs(lead(depth) over a - depth)*exp(-10*(abs(lead(gt_r) over a-gt_r)+abs(lead(gt_g) over a-gt_g)+abs(lead(gt_b) over a-gt_b))/3) tx, abs(lead(depth) over b - depth)*exp(-10*(abs(lead(gt_r) over b-gt_r)+abs(lead(gt_g) over b-gt_g)+abs(lead(gt_b) over b-gt_b))/3) ty from d1 window a as (partition by view, v order by u), b as (partition by view, u order by v))
select round((select avg(e) from (select unnest([abs(r-gt_r),abs(g-gt_g),abs(b-gt_b)]) e from d1)),6) l1, round(avg(tx)+avg(ty),6) depth_tv from t""")
def a17b(d1):
    return rounded(pixels.image_losses(d1), "l1", "depth_tv")


RANK = "rk as (select view, c, row_number() over (order by case when n <= 2 then 0 else c end desc, view) - 1 as rank from (select view, round(avg(alpha + view*0.001),9) c, count(*) over () n from d1 group by view))"


@query("a20_view_ranking", ("d1",), f"with {RANK} select view, round(c,6) confidence, rank from rk")
def a20(d1):
    return rounded(pixels.view_ranking(d1.withColumn("conf", F.col("alpha") + F.col("view") * 0.001), "conf"), "confidence")


@query("j12_covisible_pixels", ("c1", "d1"), f"""
with {CAM32}, {RANK}, per as (select view, rank, min(depth) lo, max(depth) hi from d1 join rk using (view) group by 1, 2),
tgt as (select view, rank, lo, hi, min(lo) over w p_lo, max(hi) over w p_hi from per window w as (order by rank rows between unbounded preceding and 1 preceding)),
pt as (select rank p_rank, depth p_depth, (u-cx)/fx*depth xc, (v-cy)/fy*depth yc, depth zc, cams.* from d1 join rk using (view) join cams on pos = view),
w as (select p_rank, p_depth, r00*xc+r01*yc+r02*zc+t0 x, r10*xc+r11*yc+r12*zc+t1 y, r20*xc+r21*yc+r22*zc+t2 z from pt),
c as (select view, lo, hi, p_lo, p_hi, p_depth, fx, fy, cx, cy, r00*(x-t0)+r10*(y-t1)+r20*(z-t2) xc, r01*(x-t0)+r11*(y-t1)+r21*(z-t2) yc, r02*(x-t0)+r12*(y-t1)+r22*(z-t2) zc from w join tgt on p_rank < rank join cams on pos = view),
p as (select *, (fx*xc+cx*zc)/(zc+1e-8) u, (fy*yc+cy*zc)/(zc+1e-8) v from c)
select distinct d.view, d.u, d.v from p join d1 d on d.view = p.view and d.u = floor(p.u) and d.v = floor(p.v) where p.u >= 0 and p.u < 32 and p.v >= 0 and p.v < 32
and round(abs(case when p_hi > p_lo then (p_depth-p_lo)/(p_hi-p_lo) else p_depth end - case when hi > lo then (d.depth-lo)/(hi-lo) else d.depth end),9) < 0.05""")
def j12(c1, d1):
    rank = pixels.view_ranking(d1.withColumn("conf", F.col("alpha") + F.col("view") * 0.001), "conf")
    return pixels.covered_pixels(d1, cams32(c1), rank, 0.05)


ORIGIN, VOXEL, DIMS, TRUNC = (-0.8731, -0.8731, -0.8731), 0.1507, (12, 12, 12), 0.4
FUSED = f"""{CAM32}, grid as (select i, j, k, i*{VOXEL}-0.8731 x, j*{VOXEL}-0.8731 y, k*{VOXEL}-0.8731 z from range(12) a(i), range(12) b(j), range(12) c(k)),
vc as ({CAM.format(cols="i, j, k, pos, fx, fy, cx, cy", src="grid, cams")}),
vp as (select *, trunc(fx*xc/zc+cx) u, trunc(fy*yc/zc+cy) v from vc where zc > 0.01),
fu as (select i, j, k, greatest(-1,least(1,(depth-zc)/{TRUNC})) t, r, g, b from vp join d1 on view = pos and d1.u = vp.u and d1.v = vp.v where depth > 0 and depth-zc > -{TRUNC}),
vol as (select i, j, k, avg(t) tsdf, avg(r) r, avg(g) g, avg(b) b, count(*) weight from fu group by 1,2,3)"""


@query("a18_tsdf_fusion", ("c1", "d1"), f"with {FUSED} select i::int i, j::int j, k::int k, round(tsdf,6) tsdf, round(r,6) r, weight from vol")
def a18(c1, d1):
    return rounded(pixels.fuse(d1, cams32(c1), ORIGIN, VOXEL, DIMS, TRUNC).select("i", "j", "k", "tsdf", "r", "weight"), "tsdf", "r")


@query("a19_surface_crossings", ("c1", "d1"), f"""
with {FUSED}, f as (select grid.i, grid.j, grid.k, coalesce(tsdf,1.0) t, coalesce(r,0.0) r from grid left join vol on vol.i=grid.i and vol.j=grid.j and vol.k=grid.k),
e as (select a.i, a.j, a.k, a.t, b.t t2, a.r, b.i-a.i di, b.j-a.j dj, b.k-a.k dk from f a join f b on (b.i=a.i+1 and b.j=a.j and b.k=a.k) or (b.i=a.i and b.j=a.j+1 and b.k=a.k) or (b.i=a.i and b.j=a.j and b.k=a.k+1))
select round((i+di*t/(t-t2))*{VOXEL}-0.8731,5) x, round((j+dj*t/(t-t2))*{VOXEL}-0.8731,5) y, round((k+dk*t/(t-t2))*{VOXEL}-0.8731,5) z, round(r,5) r from e where sign(t)*sign(t2) < 0""")
def a19(c1, d1):
    out = pixels.crossings(pixels.fuse(d1, cams32(c1), ORIGIN, VOXEL, DIMS, TRUNC), ORIGIN, VOXEL, DIMS)
    return out.select(*[F.round(c, 5).alias(c) for c in ("x", "y", "z", "r")])


@query("x19_sharpness", ("d1",), """
with g as (select view, u, v, floor((0.299*r+0.587*g+0.114*b)*255.0+0.5) y from d1),
l as (select view, y, lead(y) over a + lag(y) over a + lead(y) over b + lag(y) over b - 4.0*y l from g window a as (partition by view, v order by u), b as (partition by view, u order by v))
select view, round(var_pop(case when l is null then y-128.0 else greatest(-128.0,least(127.0,l)) end),4) sharpness from l group by view""")
def x19(d1):
    return pixels.sharpness(d1).withColumn("sharpness", F.round("sharpness", 4))
