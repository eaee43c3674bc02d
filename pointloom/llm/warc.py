"""Conversion of legacy ARC archives to WARC.

An ARC archive begins with a filedesc record, whose block says the format's version and
names the fields of the header lines: five in version 1, ten in version 2. Each record is
one header line, as many bytes as it declares, and a line end. Header lines are read from
the right, as old URLs may hold spaces; blocks are cut by the declared length and never
searched for what begins the next record.

1. Each archive is read by one task, and each record's payload (what follows the HTTP
   header) is digested. Only digests, lengths and ids are shuffled: of records with equal
   payloads one is the response, the others revisit it.
2. Archives are read again, and each record is written as WARC: an identifier made from
   the archive's name and the offset, the date from the 14 digits, the type from the URL's
   scheme and the HTTP status line, block and payload digests. A revisit keeps its HTTP
   header only. A record that has nothing to look up isn't shuffled.
3. WARC archives are read by declared lengths too, whatever the payload holds.

Records are gzip members of their own, so an archive can be read from any record on. A row
of the table that is written is one archive of ARCHIVE_BYTES before compression (a longer
record makes a longer one), so neither the tasks nor the readers hold more, and archives go to
any file system that Spark writes to. Each file ends with a zero byte, which gzip readers pass over.

Results in special cases: a null html is an empty payload, and empty payloads are equal; a
null url is `-` in ARC and left out of WARC; a null page_id has no header of its own, comes
before all others, and refers_to is null where it is referred to; of rows repeated with one
page_id and payload one is the response; a very long payload is one record; an empty table
gives archives without records; further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, small_side, written

ARCHIVE_BYTES = 16 << 20
#: Rows of references (about 150 bytes each) that may be broadcast.
BROADCAST_REFERENCES = 200_000
DATE = "20000101000000"
#: The field names of the two versions of ARC.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_HEADER = b"X-Page-Id"


def digest(data: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def uri_of(url: str | None) -> str:
    """A URL without what a header line can't hold: spaces, controls and other than ASCII are percent-encoded."""
    from urllib.parse import quote

    return quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else "-"


def http_block(payload: bytes, page_id: int | None, mime: str = "text/html; charset=utf-8") -> bytes:
    own = b"" if page_id is None else PAGE_HEADER + b": %d\r\n" % page_id
    return b"HTTP/1.1 200 OK\r\nContent-Type: %s\r\nContent-Length: %d\r\n%s\r\n" % (mime.encode(), len(payload), own) + payload


def http_parts(block: bytes) -> tuple[bytes, bytes] | None:
    """(header with its blank line, payload) of an HTTP response, or None if it is none."""
    if not block.startswith(b"HTTP/"):
        return None
    m = re.search(rb"\r?\n\r?\n", block)
    return (block[: m.end()], block[m.end() :]) if m else (block, b"")


def header_value(head: bytes, name: bytes) -> bytes | None:
    m = re.search(rb"(?im)^%s:[ \t]*(.*?)[ \t]*\r?$" % re.escape(name), head)
    return m[1] if m else None


def arc_head(name: str, version: int, date: str = DATE) -> bytes:
    """The filedesc record that an archive begins with."""
    block = f"{version} 0 archive\n{ARC_FIELDS[version]}\n".encode()
    line = {1: f"filedesc://{name} 0.0.0.0 {date} text/plain {len(block)}\n", 2: f"filedesc://{name} 0.0.0.0 {date} text/plain 200 - - 0 {name} {len(block)}\n"}[version]
    return line.encode() + block + b"\n"


def arc_record(version: int, url: str, block: bytes, offset: int, name: str, date: str = DATE, mime: str = "text/html") -> bytes:
    if version == 1:
        line = f"{url} 0.0.0.0 {date} {mime} {len(block)}\n"
    else:
        line = f"{url} 0.0.0.0 {date} {mime} 200 {hashlib.md5(block).hexdigest()} - {offset} {name} {len(block)}\n"
    return line.encode() + block + b"\n"


def read_arc(stream: io.BufferedIOBase) -> Iterator[dict]:
    """The records of an archive: name, offset, url, date, mime, block. Lines between records may be empty."""
    fields, name, at = ARC_FIELDS[1].split(), "", 0
    while line := stream.readline():
        begin, at = at, at + len(line)
        if not line.strip():
            continue
        parts = line.decode("utf-8", "surrogateescape").rstrip("\r\n").rsplit(" ", len(fields) - 1)
        if line.startswith(b"filedesc://"):  # its own line may be of either version
            parts = line.decode("utf-8", "surrogateescape").split()
            fields = ARC_FIELDS[2 if len(parts) > 5 else 1].split()
        got = dict(zip((f.lower() for f in fields), parts, strict=True))
        block = stream.read(int(got["archive-length"]))
        if len(block) < int(got["archive-length"]):
            raise ValueError(f"{name}: the record at {begin} is cut off")
        at += len(block)
        if line.startswith(b"filedesc://"):
            name = parts[0].removeprefix("filedesc://")
            about = block.decode("ascii", "replace").split("\n")
            fields = about[1].split()  # the version's own list of fields
            if about[0].split()[0] not in ("1", "2") or not fields:
                raise ValueError(f"{name}: not an ARC version: {about[0]}")
        else:
            yield {"name": name, "offset": begin, "url": parts[0], "date": got["archive-date"], "mime": got["content-type"], "block": block}


def iso_date(digits: str) -> str:
    """The date of an ARC header line: 14 digits, or fewer in old archives."""
    d = re.sub(r"\D", "", digits)[:14]
    d += "00000101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(name: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{offset}')}>"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{head}\r\n".encode("utf-8", "surrogateescape") + block + b"\r\n\r\n"


def warcinfo(name: str, date: str = DATE) -> bytes:
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, 0)), ("WARC-Date", iso_date(date)), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    return warc_record(fields, b"software: arc converter\r\nformat: WARC File Format 1.1\r\n")


def converted(rec: dict, refers: dict | None) -> bytes:
    """The WARC record of an ARC record. refers: id, url and date of the response that this one revisits."""
    http = http_parts(rec["block"])
    kind = "revisit" if refers else "response" if http or rec["url"].startswith("dns:") else "resource"
    payload = http[1] if http else rec["block"]
    block = http[0] if http and refers else b"" if refers else rec["block"]
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(rec["name"], rec["offset"])), ("WARC-Date", iso_date(rec["date"]))]
    fields += [("WARC-Target-URI", rec["url"])] if rec["url"] != "-" else []
    fields += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}")]
    if refers:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers["id"]), ("WARC-Refers-To-Date", iso_date(refers["date"]))]
        fields += [("WARC-Refers-To-Target-URI", refers["url"])] if refers["url"] != "-" else []
    fields += [("Content-Type", "application/http; msgtype=response" if http else rec["mime"])]
    return warc_record(fields, block)


def read_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record; names of fields in lower case."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "surrogateescape").partition(":")
            fields[k.strip().lower()] = v.strip()
        n = int(fields["content-length"])
        block = stream.read(n)
        if len(block) < n:
            raise ValueError("a record is cut off")
        yield fields, block


class _Archive:
    """Collects records as gzip members."""

    def __init__(self, head: bytes):
        self.size, self.parts = 0, []
        self.add(head)

    def add(self, record: bytes) -> None:
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        self.size += len(record)
        self.parts += [z.compress(record), z.flush()]

    def row(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(self.parts)], pa.binary())], ["archive"])


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def put_archives(rows: DataFrame, path: str) -> None:
    """Writes each row (archive binary) as one file, ended by a zero byte."""
    # A cast keeps the bytes as they are, and the text source writes them so.
    rows.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(content) of each archive in a folder."""
    return spark.read.format("binaryFile").load(path).select("content")


def _stream(content: pa.Scalar) -> io.BufferedIOBase:
    raw = content.as_py()
    return gzip.GzipFile(fileobj=io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw.rstrip(b"\0"))


def write_arc(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """pages (page_id, url, html) as ARC archives, of version 1 and 2 in turn."""
    prefix = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0

        def start() -> tuple[_Archive, str, int]:
            name, version = f"{prefix}-{_task():06d}-{n:06d}.arc", 1 + (_task() + n) % 2
            return _Archive(arc_head(name, version)), name, version

        arc, name, version = start()
        for b in batches:
            for i in range(b.num_rows):
                payload = b.column(2)[i].as_py() or b""
                block = http_block(payload, b.column(0)[i].as_py())
                arc.add(arc_record(version, uri_of(b.column(1)[i].as_py()), block, arc.size, name))
                if arc.size >= archive_bytes:
                    yield arc.row()
                    n += 1
                    arc, name, version = start()
        yield arc.row()

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").cast("binary").alias("html"))
    put_archives(rows.mapInArrow(run, "archive binary"), path)


def arc_index(arcs: DataFrame) -> DataFrame:
    """(id, page_id, url, date, bytes, digest) of the records of ARC archives (content): all but the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = []
                for r in read_arc(_stream(content)):
                    http = http_parts(r["block"])
                    payload, page = (http[1], header_value(http[0], PAGE_HEADER)) if http else (r["block"], None)
                    rows.append((record_id(r["name"], r["offset"]), None if page is None else int(page), r["url"], r["date"], len(payload), digest(payload)))
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], ["id", "page_id", "url", "date", "bytes", "digest"])

    return arcs.mapInArrow(run, "id string, page_id long, url string, date string, bytes long, digest string")


def references(index: DataFrame, least: int = 0) -> DataFrame:
    """(id, refers struct<id, url, date>) of the records that revisit another one: that with the largest page_id of those with equal payloads of at least so many bytes."""
    same = index.where(F.col("bytes") >= least)
    first = F.max(F.struct("page_id", "id", "url", "date")).alias("m")
    shared = written(same.groupBy(F.col("digest").alias("d"), F.col("bytes").alias("n")).agg(first, F.count(F.lit(1)).alias("copies")).where("copies > 1").select("d", "n", F.struct("m.id", "m.url", "m.date").alias("refers")), "responses")
    # Both sides are plain shuffles, so AQE can split a payload that many have.
    met = same.join(shared, (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("n")))
    return met.where(F.col("id") != F.col("refers.id")).select("id", "refers")


def arc_to_warc(spark: SparkSession, arc_path: str, path: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Converts the ARC archives in a folder to WARC archives in another."""
    index = written(arc_index(archives(spark, arc_path)), "index")
    refers = written(references(index, least), "references")
    n = refers.count()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rid", "name", "offset", "url", "date", "mime", "block"]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
        for b in batches:
            for content in b.column(0):
                held, size = [], 0
                for r in read_arc(_stream(content)):
                    held.append((record_id(r["name"], r["offset"]), *[r[k] for k in names[1:]]))
                    size += len(r["block"])
                    if size >= 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)

    records = archives(spark, arc_path).mapInArrow(split, "rid string, name string, offset long, url string, date string, mime string, block binary")
    if n:
        refers = small_side(refers, n, BROADCAST_REFERENCES)
        records = records.join(refers, records["rid"] == refers["id"], "left").drop("id")
    else:
        records = records.withColumn("refers", F.lit(None).cast("struct<id:string,url:string,date:string>"))
    prefix = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 0
        start = lambda: _Archive(warcinfo(f"{prefix}-{_task():06d}-{k:06d}.warc.gz"))
        warc = start()
        for b in batches:
            for i in range(b.num_rows):
                rec = {c: b.column(j)[i].as_py() for j, c in enumerate(b.schema.names)}
                warc.add(converted(rec, rec["refers"]))
                if warc.size >= archive_bytes:
                    yield warc.row()
                    k += 1
                    warc = start()
        yield warc.row()

    put_archives(records.select("name", "offset", "url", "date", "mime", "block", "refers").mapInArrow(run, "archive binary"), path)


def warc_index(warcs: DataFrame) -> DataFrame:
    """(id, type, page_id, bytes, digest, refers) of the records of WARC archives (content), warcinfo left out.

    A response's length and digest are those of the payload that was read, and its declared digest must agree; a
    revisit's are those declared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = []
                for f, block in read_warc(_stream(content)):
                    if f["warc-type"] == "warcinfo":
                        continue
                    head, payload = http_parts(block) or (b"", block)
                    page, said = header_value(head, PAGE_HEADER), f["warc-payload-digest"].removeprefix("sha1:")
                    if f["warc-type"] == "revisit":
                        size, own = int(header_value(head, b"Content-Length") or 0), said
                    else:
                        size, own = len(payload), digest(payload)
                    if own != said:
                        raise ValueError(f"{f['warc-record-id']}: the payload isn't what its digest says")
                    rows.append((f["warc-record-id"], f["warc-type"], None if page is None else int(page), size, own, f.get("warc-refers-to")))
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], ["id", "type", "page_id", "bytes", "digest", "refers"])

    return warcs.mapInArrow(run, "id string, type string, page_id long, bytes long, digest string, refers string")


def warc_digest(pages: DataFrame, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """pages written as ARC, converted to WARC and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages, arc, archive_bytes)
    arc_to_warc(spark, arc, warc, least, archive_bytes)
    got = written(warc_index(archives(spark, warc)), "warc-index")
    # Responses that are referred to: one row each; revisits of one may be many, and AQE can split them.
    needed = got.where("refers is not null").select(F.col("refers").alias("id")).distinct()
    to = written(got.join(needed, "id", "left_semi").select(F.col("id").alias("rid"), F.col("page_id").alias("refers_to")), "referred")
    first = got.where("refers is null").withColumn("refers_to", F.lit(None).cast("long"))  # no null keys in the join
    out = first.unionByName(got.join(to, got["refers"] == to["rid"]).drop("rid"))
    return out.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
