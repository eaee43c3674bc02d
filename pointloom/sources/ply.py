"""Splat PLY files as a Spark data source: spark.read.format("ply"), df.write.format("ply").

One binary little-endian vertex element whose properties the header names. Rows
have a fixed length, so a file is read in byte ranges by many tasks. Paths may be
local or of any store that pyarrow.fs knows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: PLY's scalar types.
TYPES = {"float": "f4", "float32": "f4", "double": "f8", "float64": "f8", "uchar": "u1", "uint8": "u1", "char": "i1", "int8": "i1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4"}
SQL_TYPES = {"f4": "float", "f8": "double", "u1": "smallint", "i1": "smallint", "i2": "smallint", "u2": "int", "i4": "int", "u4": "bigint"}
HEADER_BYTES, RANGE_BYTES = 1 << 16, 32 << 20


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def parse_header(head: bytes) -> tuple[int, list[tuple[str, str]], int]:
    """(rows, [(property, NumPy type)], bytes of the header)."""
    end = head.find(b"end_header\n")
    if not head.startswith(b"ply") or end < 0:
        raise ValueError("no PLY header")
    rows, props, inside = 0, [], False
    for line in head[:end].decode("ascii", "ignore").splitlines():
        word = line.split()
        if word[:1] == ["format"] and word[1] != "binary_little_endian":
            raise ValueError(f"PLY format {word[1]} is not supported")
        if word[:1] == ["element"]:
            inside = word[1] == "vertex"
            rows = int(word[2]) if inside else rows
        elif word[:1] == ["property"] and inside:
            props.append((word[2], "<" + TYPES[word[1]]))
    return rows, props, end + len(b"end_header\n")


def header_of(path: str) -> tuple[int, list[tuple[str, str]], int]:
    fs, p = filesystem(path)
    with fs.open_input_stream(p) as f:
        return parse_header(f.read(HEADER_BYTES))


class Range(InputPartition):
    def __init__(self, first: int, rows: int):
        self.first, self.rows = first, rows


class PlyReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.path = schema.fieldNames(), options["path"]
        self.rows, self.props, self.offset = header_of(self.path)
        self.dtype = np.dtype(self.props)
        self.step = max(1, int(options.get("rangebytes", RANGE_BYTES)) // self.dtype.itemsize)

    def partitions(self):
        return [Range(i, min(self.step, self.rows - i)) for i in range(0, self.rows, self.step)] or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, p = filesystem(self.path)
        with fs.open_input_file(p) as f:
            f.seek(self.offset + partition.first * self.dtype.itemsize)
            data = np.frombuffer(f.read(partition.rows * self.dtype.itemsize), self.dtype)
        wide = {"u1": "i2", "i1": "i2", "u2": "i4", "u4": "i8"}
        cols = []
        for n in self.names:
            if n == "gid":
                cols.append(pa.array(np.arange(partition.first, partition.first + len(data), dtype=np.int64)))
            else:
                kind = dict(self.props)[n][1:]
                cols.append(pa.array(np.ascontiguousarray(data[n]).astype(wide.get(kind, kind))))
        yield pa.RecordBatch.from_arrays(cols, self.names)


class Part(WriterCommitMessage):
    def __init__(self, path: str, rows: int, number: int):
        self.path, self.rows, self.number = path, rows, number


class PlyWriter(DataSourceArrowWriter):
    """Tasks write headerless parts beside the target; commit() streams them together and renames the result."""

    def __init__(self, schema: StructType, options: dict):
        self.path, self.names = options["path"], [n for n in schema.fieldNames() if n != "gid"]
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        fs, p = filesystem(self.path)
        c = TaskContext.get()
        part, rows = f"{p}.{self.run}.part{c.partitionId()}-{c.taskAttemptId()}", 0
        with fs.open_output_stream(part) as f:
            for b in iterator:
                f.write(np.column_stack([b.column(n).to_numpy(zero_copy_only=False).astype("<f4") for n in self.names]).tobytes() if b.num_rows else b"")
                rows += b.num_rows
        return Part(part, rows, c.partitionId())

    def commit(self, messages: list[Part]) -> None:
        fs, p = filesystem(self.path)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        head = "\n".join(["ply", "format binary_little_endian 1.0", f"element vertex {sum(m.rows for m in parts)}", *[f"property float {n}" for n in self.names], "end_header\n"])
        whole = f"{p}.{self.run}.tmp"
        with fs.open_output_stream(whole) as out:
            out.write(head.encode("ascii"))
            for m in parts:
                with fs.open_input_stream(m.path) as f:
                    while chunk := f.read(1 << 20):
                        out.write(chunk)
        fs.move(whole, p)
        for m in parts:
            fs.delete_file(m.path)

    def abort(self, messages: list[Part]) -> None:
        fs, _ = filesystem(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(m.path)


class PlyDataSource(DataSource):
    """Options: path; columns (a list with commas: only these); rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        _, props, _ = header_of(self.options["path"])
        want = [c.strip() for c in self.options["columns"].split(",")] if self.options.get("columns") else [n for n, _ in props]
        kinds = dict(props)
        return ", ".join(["gid bigint", *[f"`{n}` {SQL_TYPES[kinds[n][1:]]}" for n in want if n in kinds]])

    def reader(self, schema: StructType) -> PlyReader:
        return PlyReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> PlyWriter:
        return PlyWriter(schema, self.options)


def read_ply(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """gid (the row's place) and the file's properties."""
    spark.dataSource.register(PlyDataSource)
    r = spark.read.format("ply").option("path", path)
    return (r.option("columns", ",".join(columns)) if columns else r).load()


def write_ply(df: DataFrame, path: str) -> None:
    """Writes rows in the order of gid, atomically; deleted rows get opacity -100, and `deleted` itself isn't stored."""
    if {"deleted", "opacity"} <= set(df.columns):
        df = df.withColumn("opacity", F.when(F.col("deleted"), F.lit(-100.0)).otherwise(F.col("opacity")))
    df.sparkSession.dataSource.register(PlyDataSource)
    names = [c for c, t in df.dtypes if t in ("float", "double", "int", "smallint", "bigint") and c not in ("gid", "deleted")]
    ordered = df.repartitionByRange("gid").sortWithinPartitions("gid").select("gid", *[F.col(c).cast("float") for c in names])
    ordered.write.format("ply").mode("append").option("path", path).save()


def sh_degree(df: DataFrame) -> int:
    """The degree of the spherical harmonics, from the number of f_rest columns."""
    n = sum(c.startswith("f_rest_") for c in df.columns) // 3
    return int((n + 1) ** 0.5) - 1


def ply_inventory(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, n_vertices, properties, header_bytes) of many files; only their first 64 KiB are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [header_of(p) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([[n for n, _ in g[1]] for g in got], pa.list_(pa.string())), pa.array([g[2] for g in got], pa.int64())], ["path", "n_vertices", "properties", "header_bytes"])

    return spark.createDataFrame([(p,) for p in paths], "path string").mapInArrow(run, "path string, n_vertices bigint, properties array<string>, header_bytes bigint")


def write_positions(df: DataFrame, path: str) -> None:
    """Positions sidecar: uint32 n, float32 centre (3) and radius, then n x 3 float32 in the order of gid."""
    from ..operators.scene import sampled_centroid

    n = df.count()
    c = sampled_centroid(df).first()
    target = f"{path}.{uuid.uuid4().hex}.body"
    write_ply(df.select("gid", "x", "y", "z"), target)
    fs, p = filesystem(path)
    _, _, skip = header_of(target)
    _, body = filesystem(target)
    with fs.open_output_stream(f"{p}.tmp") as out, fs.open_input_file(body) as f:
        out.write(np.array([n], "<u4").tobytes() + np.array([c["cx"], c["cy"], c["cz"], c["radius"]] if c else [0] * 4, "<f4").tobytes())
        f.seek(skip)
        while chunk := f.read(1 << 20):
            out.write(chunk)
    fs.move(f"{p}.tmp", p)
    fs.delete_file(body)


def read_positions(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(rows gid, x, y, z; the header as a dict), read in ranges of 12-byte rows."""
    fs, p = filesystem(path)
    with fs.open_input_stream(p) as f:
        head = f.read(20)
    n, (cx, cy, cz, radius) = int(np.frombuffer(head, "<u4", 1)[0]), np.frombuffer(head, "<f4", 4, 4).tolist()
    step = RANGE_BYTES // 12

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, p = filesystem(path)
        for b in batches:
            for first in b.column(0).to_pylist():
                with fs.open_input_file(p) as f:
                    f.seek(20 + 12 * first)
                    a = np.frombuffer(f.read(12 * min(step, n - first)), "<f4").reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(a), dtype=np.int64)), *[pa.array(np.ascontiguousarray(a[:, k])) for k in range(3)]], ["gid", "x", "y", "z"])

    ranges = spark.range(0, max(n, 1), step).withColumnRenamed("id", "first") if n else spark.createDataFrame([], "first long")
    return ranges.mapInArrow(run, "gid long, x float, y float, z float"), {"n": n, "centroid": [cx, cy, cz], "radius": radius}
