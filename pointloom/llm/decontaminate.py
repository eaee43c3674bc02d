"""Benchmark decontamination by spaced seeds.

Masks of fixed shape pick some of the words in a window and ignore the others, so
that a substituted word at an ignored place does no harm.

1. The masked hashes of all benchmark items are a table of seeds. A bit map of them,
   of bounded size, tells a task which of its documents' hashes may be there.
2. Those hashes are joined with the seeds by Spark. A hit is a diagonal: where the item
   would begin in the document. A hash that follows itself (a repeated word) is one row
   with a range of places, so a hit may be a range of diagonals.
3. Along each diagonal the two texts are compared word by word: an overlap counts if at
   least `share` of its words are equal and it has at least min_words words (or the whole
   item, if shorter). The longest such segment is taken. The masks hit every overlap of
   13 words or more that is 80 % equal; for shorter items, and for weaker rules, runs of
   words are sought that any overlap must have.

Items with equal words are one item, with the smallest item_id. Nothing but the bit map
goes to all tasks, and documents are read once for the hashes, those with hits once more.

Results in special cases: null or empty texts and items match nothing; an item with
fewer than min_words words is sought whole; a null doc_id or item_id is
an id like others; repeated documents yield their rows each; of overlaps of one item
that have equally many equal words the first in the document counts; a very long text or
item is compared whole, one diagonal at a time; empty tables give no
rows; further columns stay in `decontaminated` and are ignored in `overlaps`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, small_side, text_of, written
from .shingles import longest_segment, masked, mixed, sequences

#: 1 is compared, 0 is ignored. The first two survive a substitution at every fifth or third word.
#: Together they hit all placements of substitutions in 13 words or more that leave 80 % (a test enumerates them).
MASKS = ("1111011", "11011011", "110101011", "1110010111", "1111100001")
MIN_WORDS, SHARE = 13, 0.8
#: The bit map has 32 bits a seed, within these bounds (1 MB and 128 MB).
LEAST_BITS, MOST_BITS = 1 << 23, 1 << 30
SCHEMA = "doc_id long, item_id long, n_words long, n_equal long, doc_start long, item_start long"


def _ones(mask: str) -> tuple[int, ...]:
    return tuple(i for i, c in enumerate(mask) if c == "1")


def _run(lengths, share: float) -> int:
    """The equal words in a row that any segment of these lengths has if share of it is equal."""
    least = [(n, int(np.ceil(share * n - 1e-9))) for n in lengths]
    return max(1, min(-(-e // (n - e + 1)) for n, e in least))


def _masks_for(n: int, masks: tuple[str, ...], min_words: int, share: float) -> tuple[str, ...]:
    """The masks that an item of n words is sought with."""
    if n < min_words:
        return ("1" * _run([n], share),)
    return masks if min_words >= MIN_WORDS and share >= SHARE else ("1" * _run(range(min_words, 2 * min_words), share),)


def _hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at each place; different masks have different hashes."""
    return mixed(masked(words, _ones(mask), len(mask)) + np.uint64(int(mask, 2)))


def _ranges(of: np.ndarray, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(of, first, last, h): places of one text that follow each other with the same hash, as one."""
    if not len(at):
        return of, at, at, h
    new = np.append(True, (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1) | (h[1:] != h[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return of[first], at[first], at[last], h[first]


def items_of(benchmark: DataFrame) -> DataFrame:
    """(i, item_id, text): the different items; i is a key of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [0 if not len(w) else int(mixed(np.array([np.add.reduce(mixed(w + mixed(np.arange(len(w), dtype=np.uint64)))) ^ np.uint64(len(w))], np.uint64)).view(np.int64)[0]) for w, _ in sequences(b.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), b.column(0), b.column(1), pa.array([len(w) for w, _ in sequences(b.column(1))], pa.int64())], ["i", "item_id", "text", "n"])

    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text"))
    keyed = own.mapInArrow(run, "i long, item_id long, text string, n long").where("n > 0")
    return written(keyed.groupBy("i").agg(F.min("item_id").alias("item_id"), F.min("text").alias("text"), F.max("n").alias("n")), "items")


def seeds_of(items: DataFrame, masks: tuple[str, ...], min_words: int, share: float) -> DataFrame:
    """(h, i, p0, p1): the masked hashes of the items, and the range of places where each is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (w, _) in zip(b.column(0).to_pylist(), sequences(b.column(1)), strict=True):
                for mask in _masks_for(len(w), masks, min_words, share):
                    h = _hashes(w, mask)
                    _, first, last, h = _ranges(np.zeros(len(h), np.int64), np.arange(len(h)), h)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), i, np.int64)), pa.array(first), pa.array(last)], ["h", "i", "p0", "p1"])

    return written(items.select("i", "text").mapInArrow(run, "h long, i long, p0 long, p1 long"), "seeds")


def _bits(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash in a map of that size (a power of two)."""
    mask = np.uint64(size - 1)
    return (h & mask).astype(np.int64), (mixed(h) & mask).astype(np.int64)


def bit_map(seeds: DataFrame) -> np.ndarray:
    """The bits of all seeds; between 1 and 128 MB whatever the number of seeds."""
    size = 1 << max(LEAST_BITS.bit_length() - 1, min(MOST_BITS.bit_length() - 1, (32 * seeds.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate(_bits(b.column(0).to_numpy().view(np.uint64), size))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)).view(np.int64))], ["at", "w"])

    words = seeds.select("h").mapInArrow(run, "at long, w long").groupBy("at").agg(F.bit_or("w").alias("w")).toArrow()
    out = np.zeros(size >> 6, np.int64)
    out[words.column("at").to_numpy()] = words.column("w").to_numpy()
    return out.view(np.uint64)


def overlaps_along(words: np.ndarray, item: np.ndarray, diagonals: Iterator[int], min_words: int, share: float) -> tuple[int, int, int, int] | None:
    """(words, equal, start in the document, start in the item) of the best overlap on these diagonals: with most equal words, then the first."""
    best = None
    for d in diagonals:
        lo, hi = max(0, -d), min(len(item), len(words) - d)
        if hi <= lo:
            continue
        equal = item[lo:hi] == words[lo + d : hi + d]
        a, b = longest_segment(equal, share)
        n = int(equal[a:b].sum())
        if b > a and b - a >= min(min_words, len(item)) and (best is None or (n, -(lo + a + d), -(lo + a)) > (best[1], -best[2], -best[3])):
            best = (b - a, n, lo + a + d, lo + a)
    return best


def _hits(texts: DataFrame, seeds: DataFrame, masks: list[str]) -> DataFrame:
    """(k, i, ds): for texts (k, text) the items hit, and the ranges of diagonals. Hashes of texts and seeds are joined."""
    bits = texts.sparkSession.sparkContext.broadcast(bit_map(seeds))  # 1 to 128 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value
        size = len(known) * 64
        for b in batches:
            ks, parts, held, count = b.column(0).to_numpy(), [], [], 0

            def flush(held: list[np.ndarray], first: int, parts=parts, ks=ks) -> None:
                lengths = np.array([len(w) for w in held])
                flat, of = np.concatenate(held), np.repeat(np.arange(len(held)), lengths)
                begin = np.cumsum(lengths) - lengths
                for mask in masks:
                    if len(flat) < len(mask):
                        continue
                    h = _hashes(flat, mask)
                    x, y = _bits(h, size)
                    hit = np.flatnonzero((known[x >> 6] >> (x & 63).astype(np.uint64)) & (known[y >> 6] >> (y & 63).astype(np.uint64)) & np.uint64(1))
                    hit = hit[of[hit] == of[hit + len(mask) - 1]]
                    o, q0, q1, hh = _ranges(of[hit], hit - begin[of[hit]], h[hit])
                    parts.append((ks[first + o], q0, q1, hh.view(np.int64)))

            n = 0
            for w, _ in sequences(b.column(1)):
                held.append(w)
                count += len(w)
                n += 1
                if count >= 200_000:
                    flush(held, n - len(held))
                    held, count = [], 0
            if held:
                flush(held, n - len(held))
            cols = [np.concatenate([p[j] for p in parts]) if parts else np.zeros(0, np.int64) for j in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["k", "q0", "q1", "h"])

    found = texts.mapInArrow(run, "k long, q0 long, q1 long, h long").join(seeds, "h")
    at = found.select("k", "i", (F.col("q0") - F.col("p1")).alias("lo"), (F.col("q1") - F.col("p0")).alias("hi")).distinct()
    return written(at.groupBy("k", "i").agg(F.collect_list(F.struct("lo", "hi")).alias("ds")), "hits")


def _text_key():
    return F.xxhash64(text_of())


def overlaps(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, share: float = SHARE, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """A row for each document and benchmark item that overlap."""
    items = items_of(benchmark)
    lengths = [r["n"] for r in items.where(F.col("n") < min_words).select("n").distinct().collect()]  # fewer than min_words numbers
    used = sorted({m for n in (*lengths, min_words) for m in _masks_for(n, masks, min_words, share)})
    seeds = seeds_of(items, masks, min_words, share)
    hits = _hits(docs.select(_text_key().alias("k"), text_of().alias("text")), seeds, used)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            both = zip(sequences(b.column(2)), sequences(b.column(3)), strict=True)
            for doc_id, item_id, ((words, _), (item, _)), ds in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), both, b.column(4).to_pylist(), strict=True):
                got = overlaps_along(words, item, (d for r in ds for d in range(r["lo"], r["hi"] + 1)), min_words, share)
                if got:
                    rows.append((doc_id, item_id, *got))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(6)], SCHEMA.replace(" long", "").split(", "))

    # Only texts with hits move.
    keys = small_side(hits.select("k").distinct())
    own = docs.select(_text_key().alias("k"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(keys, "k", "left_semi")
    both = own.join(hits, "k").join(items.select("i", "item_id", F.col("text").alias("item")), "i")
    return both.select("doc_id", "item_id", "text", "item", "ds").mapInArrow(run, SCHEMA)


def decontaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, share: float = SHARE) -> DataFrame:
    """The documents that overlap with no item, with all their columns."""
    (key,) = fresh(docs, "key")
    # Documents with one text are alike, so the text's key stands for them.
    found = overlaps(docs.select(_text_key().alias("doc_id"), "text"), benchmark, min_words, share)
    gone = written(found.select(F.col("doc_id").alias(key)).distinct(), "overlapping")
    return docs.join(small_side(gone), _text_key() == F.col(key), "left_anti")
