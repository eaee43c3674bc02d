"""Cameras and splats: projection joins, mask voting, visibility, best views.

Cameras (pos, frame, r00..r22 camera-to-world rotation, t0..t2, fx, fy, cx, cy,
width, height) are a small dimension; they are broadcast behind a check of their
number and joined otherwise by Spark's own choice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import camera_space, pinhole, sigmoid
from ..scratch import written
from .leaves import Leaves, leaves_of, sound, with_leaf
from .scene import AXES, median_of
from .spatial import anchor_isolation

NEAR, DEFAULT_IOU = 0.01, 0.8


def small(df: DataFrame, limit: int = 20_000) -> DataFrame:
    """A broadcast hint if df has at most limit rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def pose(prefix: str = "") -> tuple[dict[str, Column], tuple[Column, Column, Column]]:
    return {f"{i}{j}": F.col(f"{prefix}r{i}{j}") for i in range(3) for j in range(3)}, tuple(F.col(f"{prefix}t{i}") for i in range(3))


def project(df: DataFrame, cams: DataFrame, resolution: float | None = None, focal: float | None = None) -> DataFrame:
    """Adds the camera's columns and u, v, depth for each (row, camera) in which the row is seen.

    With resolution and focal all cameras share intrinsics; else each has its own. Every row meets every camera:
    for many cameras see project_culled.
    """
    return _seen(df.crossJoin(small(cams)), resolution, focal)


def _intrinsics(resolution: float | None, focal: float | None) -> tuple[Column, ...]:
    """(fx, fy, cx, cy, width, height)"""
    if resolution is None:
        return tuple(F.col(c) for c in ("fx", "fy", "cx", "cy", "width", "height"))
    return tuple(F.lit(x) for x in (focal, focal, resolution / 2, resolution / 2, resolution, resolution))


def _seen(met: DataFrame, resolution: float | None, focal: float | None) -> DataFrame:
    xc, yc, zc = camera_space(tuple(F.col(a) for a in AXES), *pose())
    d = met.withColumns({"_x": xc, "_y": yc, "depth": zc}).where(F.col("depth") > NEAR)
    fx, fy, cx, cy, w, h = _intrinsics(resolution, focal)
    u, v = pinhole(F.col("_x"), F.col("_y"), F.col("depth"), fx, fy, cx, cy)
    return d.withColumns({"u": u, "v": v}).where((F.col("u") >= 0) & (F.col("u") < w) & (F.col("v") >= 0) & (F.col("v") < h)).drop("_x", "_y")


def _reached(boxes: np.ndarray, turn: np.ndarray, place: np.ndarray, fx: float, fy: float, cx: float, cy: float, w: float, h: float) -> np.ndarray:
    """Whether each box (leaf, least and greatest, axis) may hold what a camera sees."""
    corners = np.stack([boxes[:, [i, j, k], [0, 1, 2]] for i in (0, 1) for j in (0, 1) for k in (0, 1)], axis=1)  # leaf, corner, axis
    p = (corners - place) @ turn
    x, y, z = p[..., 0], p[..., 1], p[..., 2]
    # Where a corner is inside of a side, the box may reach in; the sides are planes through the camera.
    sides = (z - NEAR, fx * x + cx * z, (w - cx) * z - fx * x, fy * y + cy * z, (h - cy) * z - fy * y)
    room = 1e-9 * (1.0 + np.abs(p).sum(axis=2).max(axis=1))
    ok = np.ones(len(boxes), bool)
    for side in sides:
        ok &= side.max(axis=1) >= -room * max(1.0, abs(fx), abs(fy), abs(w), abs(h))
    return ok


#: Rows of a leaf for culling: small, so that leaves follow the frustum's sides.
CULL_ROWS = 256


def leaves_in_view(cams: DataFrame, leaves: Leaves, resolution: float | None = None, focal: float | None = None) -> DataFrame:
    """The cameras' columns with each leaf that may hold a seen row. A leaf whose box is wholly behind a side of the frustum is left out."""
    spark, names = cams.sparkSession, cams.columns
    at = spark.sparkContext.broadcast(leaves)
    own = [f"{p}{i}" for p, i in [*(("r", f"{i}{j}") for i in range(3) for j in range(3)), *(("t", i) for i in range(3))]]
    intr = dict(zip(("_fx", "_fy", "_cx", "_cy", "_w", "_h"), _intrinsics(resolution, focal), strict=True))
    sides_of = list(intr)

    def run(batches):
        for b in batches:
            col = {n: b.column(i).to_numpy(zero_copy_only=False).astype(float) for i, n in enumerate(b.schema.names) if n in own or n in sides_of}
            rows, found = [], []
            for c in range(b.num_rows):
                turn = np.array([[col[f"r{i}{j}"][c] for j in range(3)] for i in range(3)])
                place = np.array([col[f"t{i}"][c] for i in range(3)])
                ok = _reached(at.value.boxes, turn, place, *(col[n][c] for n in sides_of))
                hit = np.flatnonzero(ok)
                rows.append(np.full(len(hit), c))
                found.append(hit)
            if rows:
                out = b.select(names).take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(found).astype(np.int64))], [*names, "leaf"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in cams.dtypes)
    return cams.withColumns(intr).mapInArrow(run, f"{kinds}, leaf long")


def project_culled(df: DataFrame, cams: DataFrame, resolution: float | None = None, focal: float | None = None, capacity: int = CULL_ROWS) -> DataFrame:
    """What project gives, for many cameras: a row meets the cameras whose frustum touches the leaf that it lies in."""
    rows = written(sound(df), "points")
    return _seen(met_leaves(rows, cams, resolution, focal, capacity), resolution, focal)


def met_leaves(rows: DataFrame, cams: DataFrame, resolution: float | None = None, focal: float | None = None, capacity: int = CULL_ROWS) -> DataFrame:
    """The rows (a written table) with the columns of each camera that their leaf may be seen by."""
    leaves = leaves_of(rows, capacity)
    return with_leaf(rows, leaves).join(leaves_in_view(cams, leaves, resolution, focal), "leaf").drop("leaf")


#: Rows and cameras of a block, cameras met at once, and blocks of a partition.
BLOCK_ROWS, BLOCK_CAMERAS, CAMERAS_AT_ONCE, BLOCKS = 4096, 1024, 8, 4
_POSE = [*[f"r{i}{j}" for i in range(3) for j in range(3)], "t0", "t1", "t2"]
_SIZE = ["_fx", "_fy", "_cx", "_cy", "_w", "_h"]


def _blocks(df: DataFrame, size: int) -> DataFrame:
    """df (of numbers) in blocks of at most so many rows that follow each other, a list for each column."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                cols = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays([c])) for c in part.columns]
                yield pa.RecordBatch.from_arrays(cols, part.schema.names)

    return df.mapInArrow(run, ", ".join(f"`{c}` array<{t}>" for c, t in df.dtypes))


def _sums(points: np.ndarray, cams: np.ndarray) -> np.ndarray:
    """(camera, [n, sum of u, sum of depth]) of the points (axis, n) that each camera (pose and size, n) sees."""
    out = np.zeros((cams.shape[1], 3))
    box = np.stack([points.min(axis=1), points.max(axis=1)])[None]
    reached = [c for c in range(cams.shape[1]) if _reached(box, cams[:9, c].reshape(3, 3), cams[9:12, c], *cams[12:, c])[0]]
    for at in range(0, len(reached), CAMERAS_AT_ONCE):
        some = reached[at : at + CAMERAS_AT_ONCE]
        col = cams[:, some, None]
        r, t, (fx, fy, cx, cy, w, h) = col[:9], col[9:12], col[12:]
        d = [points[i] - t[i] for i in range(3)]
        x, y, z = (r[j] * d[0] + r[3 + j] * d[1] + r[6 + j] * d[2] for j in range(3))
        u, v = fx * x / z + cx, fy * y / z + cy
        ok = (z > NEAR) & (u >= 0) & (u < w) & (v >= 0) & (v < h)
        out[some] = np.stack([ok.sum(axis=1), np.where(ok, u, 0.0).sum(axis=1), np.where(ok, z, 0.0).sum(axis=1)], axis=1)
    return out


def view_sums(df: DataFrame, cams: DataFrame, resolution: float | None = None, focal: float | None = None) -> DataFrame:
    """(pos, n, u, depth): how many rows each camera sees, and the sums of their u and depth; none for a camera that sees none.

    Every pair of a row and a camera is computed, but none becomes a row: blocks of rows near each other meet blocks of
    cameras, and what a frustum doesn't touch is left out. So the time goes with the pairs, memory and disk with the tables.
    """
    rows = written(sound(df.select(*[F.col(a).cast("double").alias(a) for a in AXES])), "points")
    leaves = leaves_of(rows, BLOCK_ROWS)
    parts = lambda n, size: max(1, -(-n // (size * BLOCKS)))
    n, placed = int(leaves.counts.sum()), with_leaf(rows, leaves)
    points = written(_blocks(placed.repartitionByRange(parts(n, BLOCK_ROWS), "leaf").sortWithinPartitions("leaf").select(*AXES), BLOCK_ROWS), "blocks")
    intr = dict(zip(_SIZE, [c.cast("double") for c in _intrinsics(resolution, focal)], strict=True))
    poses = cams.withColumns(intr).select("pos", *[F.col(c).cast("double").alias(c) for c in _POSE], *_SIZE)
    views = written(_blocks(poses, BLOCK_CAMERAS), "cameras")
    met = points.repartition(parts(n, BLOCK_ROWS)).hint("shuffle_replicate_nl").crossJoin(views.repartition(parts(cams.count(), BLOCK_CAMERAS)))

    def run(batches):
        for b in batches:
            lists = {c: b.column(i) for i, c in enumerate(b.schema.names)}
            for i in range(b.num_rows):
                of = {c: lists[c][i].values for c in lists}
                numbers = lambda names: np.stack([of[c].to_numpy(zero_copy_only=False).astype(float) for c in names])  # noqa: B023, E731
                with np.errstate(all="ignore"):
                    out = _sums(numbers(AXES), numbers([*_POSE, *_SIZE]))
                hit = np.flatnonzero(out[:, 0] > 0)
                cols = [of["pos"].take(pa.array(hit)), pa.array(out[hit, 0].astype(np.int64)), pa.array(out[hit, 1]), pa.array(out[hit, 2])]
                yield pa.RecordBatch.from_arrays(cols, ["pos", "n", "u", "depth"])

    kind = dict(cams.dtypes)["pos"]
    return met.mapInArrow(run, f"pos {kind}, n long, u double, depth double").groupBy("pos").agg(*[F.sum(c).alias(c) for c in ("n", "u", "depth")])


def mask_hits(seen: DataFrame, masks: DataFrame, width: int, height: int) -> DataFrame:
    """Projected rows with the masks they fall into: an equi-join on (pos, pixel)."""
    at = seen.withColumns({"ui": F.least(F.floor("u"), F.lit(width - 1)).cast("int"), "vi": F.least(F.floor("v"), F.lit(height - 1)).cast("int")})
    return at.join(masks.select("pos", F.col("u").alias("ui"), F.col("v").alias("vi"), "mask_id"), ["pos", "ui", "vi"])


def multi_view_vote(df: DataFrame, cams: DataFrame, masks: DataFrame, ious: DataFrame, resolution: float, focal: float) -> DataFrame:
    """(gid, segment_id, votes): the mask with the largest sum of predicted IoU; -1 without votes; ties to the lowest.

    Mask columns are matched across frames by their position in the list.
    """
    seen = project(df.select("gid", *AXES), cams.select("pos", "frame", *[f"r{i}{j}" for i in range(3) for j in range(3)], "t0", "t1", "t2"), resolution, focal).select("gid", "pos", "u", "v")
    hits = mask_hits(seen, masks, int(resolution), int(resolution))
    rated = hits.join(small(ious.select("pos", "mask_id", "predicted_iou")), ["pos", "mask_id"], "left")
    votes = rated.groupBy("gid", "mask_id").agg(F.round(F.sum(F.coalesce("predicted_iou", F.lit(DEFAULT_IOU))), 9).alias("votes"))
    best = votes.where("votes > 0").groupBy("gid").agg(F.max_by("mask_id", F.struct("votes", -F.col("mask_id"))).alias("s"), F.max("votes").alias("votes"))
    return df.select("gid").join(best, "gid", "left").select("gid", F.coalesce("s", F.lit(-1)).alias("segment_id"), F.coalesce("votes", F.lit(0.0)).alias("votes"))


def visibility(df: DataFrame, cams: DataFrame, resolution: float, focal: float) -> DataFrame:
    """(gid, n_views), 0 for rows that no camera sees."""
    seen = project(df.select("gid", *AXES), cams, resolution, focal).groupBy("gid").agg(F.count(F.lit(1)).alias("n_views"))
    return df.select("gid").join(seen, "gid", "left").select("gid", F.coalesce("n_views", F.lit(0)).alias("n_views"))


def floaters(df: DataFrame, seen: DataFrame, anchors: DataFrame, least_ratio: float = 0.1, far: float = 5.0, safe_opacity: float = 0.8, least_views: int = 50) -> DataFrame:
    """(gid, floater) from observations (view, gid): seldom seen or isolated, unless opaque; none before 50 views."""
    total = F.broadcast(seen.agg(F.countDistinct("view").alias("_total")))
    n = seen.groupBy("gid").agg(F.countDistinct("view").alias("_n"))
    d = written(anchor_isolation(df, anchors))
    mid = F.broadcast(d.agg(median_of(d, "d").alias("_mid")))
    all_ = df.select("gid", "opacity").join(n, "gid", "left").join(d, "gid", "left").crossJoin(total).crossJoin(mid)
    rare = F.coalesce("_n", F.lit(0)) / F.greatest("_total", F.lit(1)) < least_ratio
    lone = F.coalesce(F.col("d") > far * F.col("_mid"), F.lit(False))
    return all_.select("gid", ((rare | lone) & (sigmoid(F.col("opacity")) <= safe_opacity) & (F.col("_total") >= least_views)).alias("floater"))


def assign_primary(df: DataFrame, cam: DataFrame, masks: DataFrame, order: DataFrame, resolution: float, focal: float) -> DataFrame:
    """(gid, segment_id) from the primary camera alone: of several masks the last in the manifest. order: (mask_id, segment_id, seg_pos)."""
    hits = mask_hits(project(df.select("gid", *AXES), cam, resolution, focal).select("gid", "pos", "u", "v"), masks, int(resolution), int(resolution))
    got = hits.join(small(order), "mask_id").groupBy("gid").agg(F.max_by("segment_id", "seg_pos").alias("s"))
    return df.select("gid").join(got, "gid", "left").select("gid", F.coalesce("s", F.lit(-1)).alias("segment_id"))


def coverage(assigned: DataFrame) -> DataFrame:
    """(segment_id, n) and the unassigned as -1."""
    return assigned.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n"))


def nearest_pairs(cams: DataFrame, n_pairs: int = 20) -> DataFrame:
    """(a, b): each camera with its nearest, every pair once, thinned evenly to n_pairs. Cameras are a small dimension."""
    c = cams.select("pos", "t0", "t1", "t2")
    o = small(c.select(F.col("pos").alias("p2"), *[F.col(f"t{i}").alias(f"s{i}") for i in range(3)]))
    d2 = F.round(sum((F.col(f"t{i}") - F.col(f"s{i}")) * (F.col(f"t{i}") - F.col(f"s{i}")) for i in range(3)), 9)
    near = c.crossJoin(o).where("pos <> p2").groupBy("pos").agg(F.min_by("p2", F.struct(d2, F.col("p2"))).alias("nn"))
    pairs = near.select(F.least("pos", "nn").alias("a"), F.greatest("pos", "nn").alias("b")).distinct()
    i = pairs.select("a", "b", (F.row_number().over(Window.orderBy("a", "b")) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    # Row i is picked if some k has floor(k n / n_pairs) = i.
    k = F.ceil(F.col("i") * n_pairs / F.col("n"))
    return i.where((F.col("n") <= n_pairs) | (F.floor(k * F.col("n") / n_pairs) == F.col("i"))).select("a", "b")


def match_cameras(frames: DataFrame, cams: DataFrame) -> DataFrame:
    """(filename, idx, pos): the first camera of the same name or whose name holds it, else the camera at the frame's number."""
    named = frames.join(small(cams.select("pos", "frame")), F.col("frame").contains(F.col("filename"))).groupBy("filename", "idx").agg(F.min("pos").alias("p"))
    number = F.regexp_extract("filename", r"_(\d+)\.[^.]*$", 1).cast("int")
    by_index = small(cams.select(F.col("pos").alias("_pos")))
    return frames.join(named, ["filename", "idx"], "left").withColumn("_k", number).join(by_index, F.col("_k") == F.col("_pos"), "left").select("filename", "idx", F.coalesce("p", "_pos").alias("pos"))


def best_camera(points: DataFrame, cams: DataFrame, resolution: float) -> DataFrame:
    """(gid, frame, u, v, score): the camera where the point is most central, the first on ties; own intrinsics."""
    seen = project(points, cams)
    half = resolution / 2
    du, dv = (F.col("u") - F.col("cx")) / half, (F.col("v") - F.col("cy")) / half
    s = seen.withColumn("score", F.round(1.0 - F.sqrt(du * du + dv * dv), 9)).where((F.col("u") < resolution) & (F.col("v") < resolution) & (F.col("score") > -1.0))
    m = s.groupBy("gid").agg(F.max_by(F.struct("frame", "u", "v", "score"), F.struct("score", -F.col("pos"))).alias("m"))
    return m.select("gid", F.col("m.frame").alias("frame"), F.bround("m.u").cast("int").alias("u"), F.bround("m.v").cast("int").alias("v"), F.col("m.score").alias("score"))


def ordered_masks(masks: DataFrame) -> DataFrame:
    """Masks per frame, the largest area first, numbered from 0."""
    area = masks.groupBy("pos", "mask_id").agg(F.count(F.lit(1)).alias("area"))
    return area.withColumn("rank", F.row_number().over(Window.partitionBy("pos").orderBy(F.desc("area"), "mask_id")) - 1)


def primary_frame(masks: DataFrame) -> DataFrame:
    """The frame with the most masks, the first on ties."""
    n = masks.groupBy("pos").agg(F.countDistinct("mask_id").alias("n"))
    return n.agg(F.max_by("pos", F.struct("n", -F.col("pos"))).alias("pos"))


def mask_boxes(masks: DataFrame) -> DataFrame:
    """(pos, mask_id, area, x, y, w, h)."""
    return masks.groupBy("pos", "mask_id").agg(F.count(F.lit(1)).alias("area"), F.min("u").alias("x"), F.min("v").alias("y"), (F.max("u") - F.min("u") + 1).alias("w"), (F.max("v") - F.min("v") + 1).alias("h"))
