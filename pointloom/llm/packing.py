"""Variable-capacity best-fit packing of documents into training sequences.

Documents longer than the largest capacity are cut into pieces. Pieces are dealt
out to shards by a hash, and each shard packs them in blocks of bounded size: the
longest first, each into the open bin that it fills best. Where none fits, a bin
of the least-cost size is opened: for each bin the size is chosen by what it would
cost a unit, given the pieces that are still to be placed. Three fixed policies (least
cost per unit, largest, smallest that fits) are tried for a block too, and the result
with the least total cost is kept. At the end each bin shrinks to the smallest permitted
capacity that holds its contents.

Only ids and lengths are shuffled, never text.

Results in special cases: null and empty texts have the length of the end mark
(1), so every row is packed; repeated rows are packed each; a null doc_id is an id
like others; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

CAPACITIES = (512, 1024, 2048, 4096)
BLOCK, SHARD_ROWS = 20_000, 40_000
SCHEMA = "doc_id long, piece long, start long, length long, bin_id long, capacity long, offset long"


def cost(capacity: int, fixed: float = 32.0, square: float = 1 / 16384) -> float:
    """The price of a sequence: a fixed part, its length, and attention over it."""
    return fixed + capacity + square * capacity * capacity


def words_and_end() -> Column:
    """The words of the text, and an end mark."""
    return (F.regexp_count(text_of(), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")


def _marginal(caps: list[int], order: list[int], lengths: list[int]):
    """place → the capacity with the least cost a unit that it can hold: the piece there, and of the shorter ones behind it what fits."""
    down = [-lengths[i] for i in order]  # ascending
    behind = [0]
    for x in reversed(down):
        behind.append(behind[-1] - x)
    behind.reverse()  # behind[p]: the lengths from place p on

    def choose(p: int) -> int:
        n = -down[p]

        def price(c: int) -> tuple[float, int]:
            fill = n + min(c - n, behind[max(p + 1, bisect.bisect_left(down, n - c))] if c > n else 0)
            return cost(caps[bisect.bisect_left(caps, fill)]) / fill, c

        return min((c for c in caps if c >= n), key=price)

    return choose


def _fill(order: list[int], lengths: list[int], opening) -> tuple[list[int], list[int], list[int]]:
    """Best fit: the bin and the offset of each piece, and what each bin holds. opening(place in order) → capacity of a new bin."""
    room: list[tuple[int, int]] = []  # (free, bin), ascending
    bins, offsets, held, size = [0] * len(lengths), [0] * len(lengths), [], []
    for p, i in enumerate(order):
        n = lengths[i]
        k = bisect.bisect_left(room, (n, -1))
        if k < len(room):
            _, b = room.pop(k)
        else:
            b = len(held)
            held.append(0)
            size.append(opening(p))
        bins[i], offsets[i] = b, held[b]
        held[b] += n
        if size[b] > held[b]:
            bisect.insort(room, (size[b] - held[b], b))
    return bins, offsets, held


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, its offset, capacity of each bin); each length is at most the largest capacity."""
    caps = sorted(capacities)
    fits = lambda n: caps[bisect.bisect_left(caps, n) :]
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    best = None
    policies = (lambda n: min(fits(n), key=lambda c: (cost(c) / c, c)), lambda n: caps[-1], lambda n: fits(n)[0])
    by_length = [{n: policy(n) for n in set(lengths)} for policy in policies]
    openings = [_marginal(caps, order, lengths), *(lambda p, of=of: of[lengths[order[p]]] for of in by_length)]
    for opening in openings:
        bins, offsets, held = _fill(order, lengths, opening)
        final = [fits(h)[0] for h in held]  # each bin shrinks to its contents
        total = sum(map(cost, final))
        if best is None or total < best[0]:
            best = (total, bins, offsets, final)
    return best[1:] if best else ([], [], [])


def packed(docs: DataFrame, length: Column | None = None, capacities: tuple[int, ...] = CAPACITIES, block: int = BLOCK) -> DataFrame:
    """A row for each piece: doc_id, piece, start and length in the document, bin_id, capacity, offset in the bin."""
    most = max(capacities)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (words_and_end() if length is None else F.greatest(F.coalesce(length, F.lit(0)), F.lit(1)).cast("long")).alias("n"), F.xxhash64("doc_id", text_of()).alias("row"))
    shards = max(1, -(-docs.count() // SHARD_ROWS))
    dealt = own.repartition(shards, "row").sortWithinPartitions("row", "doc_id", "n").select("doc_id", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, number, rows = TaskContext.get().partitionId(), 0, []

        def done() -> pa.RecordBatch:
            nonlocal number, rows
            bins, offsets, caps = pack([r[3] for r in rows], capacities)
            base, number = (shard << 40) + number, number + len(caps)
            cols = [[r[k] for r in rows] for k in range(4)] + [[base + b for b in bins], [caps[b] for b in bins], offsets]
            rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], SCHEMA.replace(" long", "").split(", "))

        for b in batches:
            for doc_id, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for piece, start in enumerate(range(0, n, most)):
                    rows.append((doc_id, piece, start, min(most, n - start)))
                    if len(rows) >= block:
                        yield done()
        if rows:
            yield done()

    return dealt.mapInArrow(run, SCHEMA)
