"""Structure-from-motion models in their binary form: cameras.bin, images.bin, points3D.bin."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import quaternion_of
from .ply import filesystem

#: Parameters per camera model (simple pinhole, pinhole, simple radial, radial, OpenCV).
MODEL_PARAMS = {0: 3, 1: 4, 2: 4, 3: 5, 4: 8}
SCHEMAS = {
    "cameras": "camera_id int, model int, width bigint, height bigint, fx double, fy double, cx double, cy double",
    "images": "image_id int, qw double, qx double, qy double, qz double, tx double, ty double, tz double, camera_id int, name string",
    "points": "point_id bigint, x double, y double, z double, r double, g double, b double",
}


def _records(kind: str, raw: bytes) -> list[tuple]:
    n, at, out = struct.unpack_from("<Q", raw)[0], 8, []
    for _ in range(n):
        if kind == "cameras":
            cid, model, w, h = struct.unpack_from("<IiQQ", raw, at)
            p = struct.unpack_from(f"<{MODEL_PARAMS[model]}d", raw, at + 24)
            at += 24 + 8 * MODEL_PARAMS[model]
            fx, fy, cx, cy = (p[0], p[0], p[1], p[2]) if model in (0, 2, 3) else p[:4]
            out.append((cid, model, w, h, fx, fy, cx, cy))
        elif kind == "images":
            head = struct.unpack_from("<I7dI", raw, at)
            end = raw.index(b"\0", at + 64)
            m = struct.unpack_from("<Q", raw, end + 1)[0]
            out.append((*head, raw[at + 64 : end].decode()))
            at = end + 9 + 24 * m
        else:
            pid, x, y, z, r, g, b, _, track = struct.unpack_from("<Q3d3BdQ", raw, at)
            out.append((pid, x, y, z, r / 255.0, g / 255.0, b / 255.0))
            at += 51 + 8 * track
    return out


def _decoded(files: DataFrame, kind: str) -> DataFrame:
    names = [c.split()[0] for c in SCHEMAS[kind].split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
        kinds = [types[c.split()[1]] for c in SCHEMAS[kind].split(", ")]
        for b in batches:
            for raw in b.column(0).to_pylist():
                rows = _records(kind, raw)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return files.select("content").mapInArrow(run, SCHEMAS[kind])


def read_model(spark: SparkSession, path: str, images: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cameras, images, points). images (filename): rows of missing files are left out."""
    load = lambda n: spark.read.format("binaryFile").load(f"{path}/{n}.bin")
    cams, imgs, pts = _decoded(load("cameras"), "cameras"), _decoded(load("images"), "images"), _decoded(load("points3D"), "points")
    if images is not None:
        imgs = imgs.join(images.select(F.col("filename").alias("name")), "name", "left_semi")
    return cams, imgs, pts


def _write(df: DataFrame, path: str, encode) -> None:
    """Rows in their order as records: tasks write parts beside the target, the driver streams them after the count."""
    run_id, (fs, p) = uuid.uuid4().hex, filesystem(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, p = filesystem(path)
        c = TaskContext.get()
        part, n = f"{p}.{run_id}.part{c.partitionId()}-{c.taskAttemptId()}", 0
        with fs.open_output_stream(part) as f:
            for b in batches:
                f.write(encode(b))
                n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([c.partitionId()], pa.int32()), pa.array([n], pa.int64()), pa.array([part])], ["number", "n", "part"])

    parts = sorted(df.mapInArrow(run, "number int, n long, part string").collect())  # a row per task
    with fs.open_output_stream(f"{p}.{run_id}.tmp") as out:
        out.write(struct.pack("<Q", sum(r["n"] for r in parts)))
        for r in parts:
            with fs.open_input_stream(r["part"]) as f:
                while chunk := f.read(1 << 20):
                    out.write(chunk)
    fs.move(f"{p}.{run_id}.tmp", p)
    for r in parts:
        fs.delete_file(r["part"])


def write_model(path: str, cams: DataFrame, points: DataFrame) -> None:
    """cams (pos, frame, r.., t.., fx, fy, width, height: camera to world) and points (gid, x, y, z, r, g, b in 0-1).

    Ids count from 1; each image has a pinhole camera of its own and no feature tracks.
    """
    w2c = {f"{i}{j}": F.col(f"r{j}{i}") for i in range(3) for j in range(3)}
    t = [-(F.col(f"r0{i}") * F.col("t0") + F.col(f"r1{i}") * F.col("t1") + F.col(f"r2{i}") * F.col("t2")) for i in range(3)]
    rows = cams.select((F.col("pos") + 1).alias("id"), "frame", "fx", "fy", "width", "height", *[q.alias(n) for n, q in zip(("qw", "qx", "qy", "qz"), quaternion_of(w2c), strict=True)], *[c.alias(n) for n, c in zip(("tx", "ty", "tz"), t, strict=True)]).orderBy("id")

    def cameras(b: pa.RecordBatch) -> bytes:
        return b"".join(struct.pack("<IiQQ4d", r["id"], 1, r["width"], r["height"], r["fx"], r["fy"], r["width"] / 2, r["height"] / 2) for r in b.to_pylist())

    def images(b: pa.RecordBatch) -> bytes:
        return b"".join(struct.pack("<I7dI", r["id"], r["qw"], r["qx"], r["qy"], r["qz"], r["tx"], r["ty"], r["tz"], r["id"]) + r["frame"].encode() + b"\0" + struct.pack("<Q", 0) for r in b.to_pylist())

    def points3d(b: pa.RecordBatch) -> bytes:
        out = np.zeros(b.num_rows, np.dtype([("id", "<u8"), ("xyz", "<f8", 3), ("rgb", "u1", 3), ("error", "<f8"), ("track", "<u8")]))
        col = lambda n: b.column(n).to_numpy(zero_copy_only=False)
        out["id"] = col("gid") + 1
        out["xyz"] = np.column_stack([col(n) for n in "xyz"])
        out["rgb"] = np.clip(np.round(np.column_stack([col(n) for n in "rgb"]) * 255), 0, 255)
        return out.tobytes()

    _write(rows, f"{path}/cameras.bin", cameras)
    _write(rows, f"{path}/images.bin", images)
    _write(points.select("gid", *"xyz", *"rgb").repartitionByRange("gid").sortWithinPartitions("gid"), f"{path}/points3D.bin", points3d)
