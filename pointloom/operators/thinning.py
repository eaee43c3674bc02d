"""Thinning of a cloud by priority, without a table of its close pairs.

Of the rows of one place only the first counts: what removes it removes the others too. The
places are decided in leaves, in rounds. A leaf gets its own places and those of other leaves
within r of its box, and walks them in order of priority. An own place is kept if no place before
it within r is kept or still open; what lies within r of a kept place goes. A place of another leaf
stays open, and so do those that wait for it, until the next round brings what its own leaf found.
The first open place of all is always decided, so the rounds end. A kept place is sent once more,
in the round after; then nothing within r of it is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .leaves import Leaves, between_boxes, distances_to_boxes, leaves_of, sound
from .scene import AXES

_ROW = "gid long, x double, y double, z double, grade int, o double, kept boolean"
_SENT = f"leaf long, own boolean, {_ROW}"


def _sent(rows: DataFrame, leaves: Leaves, r: float) -> DataFrame:
    """Each row once for every leaf whose box its ball touches; own marks the leaf that it lies in."""
    at = rows.sparkSession.sparkContext.broadcast(leaves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Leaves = at.value
        for b in batches:
            p = np.stack([b.column(i).to_numpy() for i in (1, 2, 3)], axis=1)
            order, own = np.argsort(tree.keys(p), kind="stable"), tree.of(p)  # near ones together
            for s in range(0, len(order), 256):
                i = order[s : s + 256]
                box = np.stack([p[i].min(axis=0), p[i].max(axis=0)])[None]
                near = np.flatnonzero(between_boxes(box, tree.boxes)[0] <= r * r)
                x, j = np.nonzero(distances_to_boxes(p[i], tree.boxes[near]) <= r * r)
                out = b.take(pa.array(i[x]))
                yield pa.RecordBatch.from_arrays([pa.array(near[j].astype(np.int64)), pa.array(near[j] == own[i[x]]), *out.columns], [c.split()[0] for c in _SENT.split(", ")])

    return rows.mapInArrow(run, _SENT)


def _runs(p: np.ndarray, r: float) -> tuple[np.ndarray, list[int], list[int], list[int]]:
    """(order, at, low, high): what lies within r of place i is among order[low[k]:high[k]], k from at[i] to at[i + 1].

    Places are put into columns along the longest axis, about r wide; a ball meets nine of them at most, each in a run.
    """
    n, axes = len(p), np.argsort(-np.ptp(p, axis=0), kind="stable")
    room = r * (1 + 1e-9) + 1e-9 * float(np.abs(p).max())
    cell = []
    for axis in axes[1:]:
        least, width = p[:, axis].min(), max(room, float(np.ptp(p[:, axis])) / (1 << 29))
        cell.append(np.floor((p[:, axis] - least) / width).astype(np.int64) + 1 if width else np.ones(n, np.int64))
    line = p[:, axes[0]]
    values, (columns, own) = np.sort(line), np.unique((cell[0] << 31) + cell[1], return_inverse=True)
    place = own * (n + 1) + np.searchsorted(values, line, side="left")
    order = np.argsort(place, kind="stable")
    place = place[order]
    first, last = np.searchsorted(values, line - room, side="left"), np.searchsorted(values, line + room, side="right")
    found = []
    for i in (-1, 0, 1):
        for j in (-1, 0, 1):
            column = np.searchsorted(columns, wanted := ((cell[0] + i) << 31) + cell[1] + j)
            who = np.flatnonzero(columns[np.minimum(column, len(columns) - 1)] == wanted)
            begin = column[who] * (n + 1)
            found.append((who, np.searchsorted(place, begin + first[who]), np.searchsorted(place, begin + last[who])))
    who, low, high = (np.concatenate([f[k] for f in found]) for k in range(3))
    some = np.flatnonzero(low < high)
    some = some[np.argsort(who[some], kind="stable")]
    return order, np.append(0, np.cumsum(np.bincount(who[some], minlength=n))).tolist(), low[some].tolist(), high[some].tolist()


def decided(p: np.ndarray, own: np.ndarray, kept: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """(kept, gone) of places in order of priority. Kept ones were so before, or are own and wait for none."""
    kept, gone, waits = kept.copy(), np.zeros(len(p), bool), np.zeros(len(p), bool)
    if not len(p):
        return kept, gone
    order, at, low, high = _runs(p, r)
    x, y, z = (p[order, i] for i in range(3))
    for i in range(len(p)):
        if gone[i]:
            continue
        kept[i] |= own[i] and not waits[i]
        for k in range(at[i], at[i + 1]):
            span = slice(low[k], high[k])
            # The same operations as in the search for close pairs.
            d2 = (x[span] - p[i, 0]) ** 2
            d2 += (y[span] - p[i, 1]) ** 2
            d2 += (z[span] - p[i, 2]) ** 2
            near = order[span][d2 <= r * r]
            (gone if kept[i] else waits)[near[near > i]] = True
    return kept, gone


def _walked(sent: DataFrame, r: float) -> DataFrame:
    """The own rows of each leaf that are kept since this round, or still open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        col = {c: table.column(c).to_numpy() for c in ("own", "gid", *AXES, "grade", "o", "kept")}
        first = np.lexsort((col["z"], col["y"], col["x"], col["gid"], -col["o"], -col["grade"]))
        col = {c: v[first] for c, v in col.items()}
        before = col["kept"].astype(bool)
        own = col["own"].astype(bool)
        kept, gone = decided(np.stack([col[a] for a in AXES], axis=1), own, before, r)
        left = np.flatnonzero(own & ~before & ~gone)
        out = table.take(pa.array(first[left])).drop_columns(["leaf", "own", "kept"]).append_column("kept", pa.array(kept[left]))
        yield from out.combine_chunks().to_batches()

    return sent.groupBy("leaf").applyInArrow(run, _ROW)


def thinned(df: DataFrame, r: float, priority: str = "opacity", capacity: int | None = None) -> DataFrame:
    """The rows of df that a walk by priority (greatest first, ties by the lowest gid) keeps: none within r of a kept one before it.

    Rows with a coordinate that is no number are kept. The disk used grows with the rows, not with their pairs.
    """
    o = F.col(priority).cast("double")
    grade = F.when(o.isNull(), 0).when(F.isnan(o), 2).otherwise(1)  # as Spark sorts them
    ranked = df.select(F.col("gid").cast("long").alias("gid"), *[F.col(a).cast("double").alias(a) for a in AXES], grade.alias("grade"), F.when(grade == 1, o).otherwise(0.0).alias("o"))
    first = sound(ranked).groupBy(*AXES).agg(F.max(F.struct("grade", "o", (-F.col("gid")).alias("g"))).alias("m"))
    live = written(first.select((-F.col("m.g")).alias("gid"), *AXES, "m.grade", "m.o", F.lit(False).alias("kept")), "places")
    leaves, rounds = leaves_of(live, capacity, halved=True), []  # of boxes that do not overlap, so few rows are sent twice or wait
    while not live.where("not kept").isEmpty():
        live = written(_walked(_sent(live, leaves, r), r), "thinned")
        rounds.append(live.where("kept").select(F.col("gid").alias("_gid"), *[F.col(a).alias(f"_{a}") for a in AXES]))
    if not rounds:
        return df
    kept = reduce(DataFrame.unionByName, rounds)
    same = (F.col("gid").cast("long") == F.col("_gid")) & (F.col("x").cast("double") == F.col("_x")) & (F.col("y").cast("double") == F.col("_y")) & (F.col("z").cast("double") == F.col("_z"))
    number = " and ".join(f"({a} is not null and not isnan({a}) and abs({a}) < double('infinity'))" for a in AXES)
    return sound(df).join(kept, same, "left_semi").unionByName(df.where(f"not ({number})"))
