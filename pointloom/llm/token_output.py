"""Token-ID output as ORC.

Documents are dealt out by ranges of doc_id, encoded where they lie, and written
as ORC: one file per range, rows in ascending doc_id order. ORC stores the ids as
run-length encoded integers in stripes; row indexes and a Bloom filter on doc_id
let a reader skip stripes, and stripes can be read in parallel.

Encoding is exact: texts are split into pre-tokens, the tokenizers library's model
encodes each distinct one once in a worker's memory, and the ids are put together;
texts with characters outside Latin, or with a special token's string, are encoded
whole by the library.

Results in special cases: a null text counts as empty and yields the end id only;
rows repeated with one doc_id follow each other in the order of their text; null
ids come first; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_dir, text_of

END_ID = 2
#: Fixed value: how byte-level BPE splits a text into pre-tokens, for characters up to U+024F.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
PRETOKEN = rf"'(?:[sdmt]|ll|ve|re)| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+"
#: Texts with these go whole to the tokenizer.
UNUSUAL = r"[\x00-\x08\x0e-\x1f\x7f-\xa0\xadɐ-\U0010ffff]"
#: Bytes of UTF-8 that such characters have; C2 starts some usual ones too.
_SUSPECT = bytes([*range(0x09), *range(0x0E, 0x20), 0x7F, 0xC2, *range(0xC9, 0x100)])
CACHE, BATCH_CHARS = 700_000, 1_000_000


class _Pieces(dict):
    """pre-token → ids as bytes, by the tokenizer's own model; forgotten beyond a bound."""

    def __init__(self, model):
        self.tokenize = model.tokenize
        # The byte-level alphabet: printable bytes stand for themselves, others for U+0100 and on.
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        others = [b for b in range(256) if b not in plain]
        self.alphabet = {b: 0x100 + i for i, b in enumerate(others)}

    def __missing__(self, piece: str) -> bytes:
        plain = piece.isascii() and piece.isprintable()
        tokens = self.tokenize(piece.replace(" ", "\u0120") if plain else piece.encode().decode("latin-1").translate(self.alphabet))
        v = self[piece] = pack(f"<{len(tokens)}i", *[t.id for t in tokens])
        return v


class Encoder:
    """Ids of texts as little-endian 32-bit integers, equal to tokenizer.encode(text, add_special_tokens=False).ids."""

    def __init__(self, spec: str):
        import json
        import re

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        d = json.loads(spec)
        pre = d.get("pre_tokenizer") or {}
        self.by_piece = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not d.get("normalizer") and d["model"]["type"] == "BPE"
        self.special = [t["content"] for t in d.get("added_tokens") or []]
        self.unusual = re.compile(UNUSUAL).search
        self.split = re.compile(PRETOKEN).findall
        self.known = _Pieces(self.tok.model)

    def whole(self, text: str) -> bool:
        """Whether a text must be encoded whole. Most texts have no byte that could mean so, and need no search."""
        raw = text.encode("utf-8", "surrogatepass")
        return any(s in text for s in self.special) or (len(raw.translate(None, _SUSPECT)) < len(raw) and self.unusual(text) is not None)

    @staticmethod
    def of(spec: str) -> Encoder:
        """The encoder of this worker process; later tasks find it warm."""
        import hashlib
        import sys
        import types

        kept = sys.modules.setdefault("_pointloom_encoders", types.ModuleType("_pointloom_encoders")).__dict__
        key = hashlib.sha256(spec.encode()).hexdigest()
        if key not in kept:
            kept[key] = Encoder(spec)
        return kept[key]

    def batch(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece:
            return [np.array(e.ids, "<i4").tobytes() for e in self.tok.encode_batch(texts, add_special_tokens=False)]
        if len(self.known) > CACHE:
            self.known.clear()
        get = self.known.__getitem__
        return [np.array(self.tok.encode(t, add_special_tokens=False).ids, "<i4").tobytes() if self.whole(t) else b"".join(map(get, self.split(t))) for t in texts]


def encoded(docs: DataFrame, tokenizer_json: str, end_id: int | None = END_ID) -> DataFrame:
    """(doc_id, ids array<int>) of documents (doc_id, text), in the same partitions and order."""
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # a vocabulary file: a few MB whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc, end = Encoder.of(spec.value), b"" if end_id is None else end_id.to_bytes(4, "little")
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            start = 0
            while start < len(texts):
                stop, chars = start, 0
                while stop < len(texts) and (stop == start or chars + len(texts[stop]) <= BATCH_CHARS):
                    chars += len(texts[stop])
                    stop += 1
                got = [x + end for x in enc.batch(texts[start:stop])]
                ends = np.append(0, np.cumsum([len(x) // 4 for x in got])).astype(np.int32)
                out = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(got), "<i4")))
                yield pa.RecordBatch.from_arrays([ids.slice(start, stop - start), out], ["doc_id", "ids"])
                start = stop

    return docs.mapInArrow(run, "doc_id long, ids array<int>")


def write_tokens(docs: DataFrame, path: str, tokenizer_json: str, end_id: int | None = END_ID) -> None:
    """Writes documents' ids as ORC under path: columns doc_id, shard, n_tokens, ids; shards ascend with doc_id."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    sorted_docs = own.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ids = encoded(sorted_docs, tokenizer_json, end_id).select("doc_id", F.spark_partition_id().alias("shard"), F.size("ids").cast("long").alias("n_tokens"), "ids")
    (ids.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.row.index.stride", "10000").option("orc.stripe.size", str(64 << 20)).option("compression", "lz4").orc(path))


def placed(t: DataFrame) -> DataFrame:
    """Adds start: the ids of all documents before. t has shard, doc_id, n_tokens and nth, the place in its file.

    Sums run within a shard, and over one row per shard.
    """
    shards = t.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    base = shards.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))
    order = Window.partitionBy("shard").orderBy("doc_id", "nth").rowsBetween(Window.unboundedPreceding, -1)
    return t.withColumn("_in", F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).join(base, "shard").withColumn("start", F.col("base") + F.col("_in"))


def _files(spark, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, shard int, n_tokens long, ids array<int>").orc(path).withColumn("nth", F.monotonically_increasing_id())


def read_tokens(spark, path: str) -> DataFrame:
    """Back from the files: doc_id, start (ids of all documents before it), n_tokens, ids."""
    return placed(_files(spark, path)).select("doc_id", "start", "n_tokens", "ids")


def token_digest(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """Writes, reads back and digests: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer_json)

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for b in batches:
            lists = b.column(1)
            flat, ends = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            sums = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            n = np.diff(ends).astype("i8")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(sums, pa.int64()), b.column(3)], ["doc_id", "shard", "n_tokens", "ids_crc32", "nth"])

    small = _files(spark, path).select("doc_id", "ids", "shard", "nth").mapInArrow(crc, "doc_id long, shard int, n_tokens long, ids_crc32 long, nth long")
    return placed(small).select("doc_id", "start", "n_tokens", "ids_crc32")
