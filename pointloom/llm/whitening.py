"""Whitening of embeddings, the components found by spectrum slicing.

Rows are counted and summed, then their covariance is summed from centred vectors; only
dimension x dimension numbers come to the driver, whatever the rows. There, of the
covariance V:

1. LDL' of V - s I (symmetric pivots of one or two rows) has as many positive pivots as V
   has eigenvalues over s, by Sylvester's law. Bisection with these counts isolates each
   leading eigenvalue between two shifts.
2. From the middle of its interval, inverse iteration gives a first vector, and Rayleigh
   quotient iteration converges cubically. A quotient that leaves the interval is a
   neighbour's: the interval is halved and the iteration begins anew.
3. Counts just beside the eigenvalue certify its number. Eigenvalues closer than the
   arithmetic can tell have vectors made orthogonal to each other.

Entries c become floor(64 c) + 1000000, so sums and deviations are exact integers.

Results in special cases: rows whose vector is null or empty, or holds null or non-finite
entries or such whose integer is beyond 2 ** 62, are dropped, and so are rows that are
shorter or longer than the most frequent length (of several, the longest); equal vectors
and repeated rows count as often as they come; a component whose eigenvalue is nothing but
rounding (rank-deficient tables, a single row) is left out; a deviation beyond 64 bits is
null; an empty table gives no rows; a null vec_id is kept; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
SCALE, OFFSET = 64.0, 1_000_000
_ALPHA = (1 + 17**0.5) / 8
_EPS = float(np.finfo(float).eps)


def pivots(a: np.ndarray) -> int:
    """How many eigenvalues of a symmetric matrix are positive: the positive pivots of LDL'.

    The largest entry is the pivot: a diagonal one alone, another one as a block of two rows, one positive and one negative.
    """
    a = a.copy()
    n, positive, k = len(a), 0, 0
    while k < n:
        rest = a[k:, k:]
        diagonal = np.abs(np.diagonal(rest))
        d = int(np.argmax(diagonal))
        off = np.abs(np.tril(rest, -1))
        p, q = np.unravel_index(int(np.argmax(off)), off.shape)
        if off[p, q] == 0 and diagonal[d] == 0:
            break
        step = 1 if diagonal[d] >= _ALPHA * off[p, q] else 2
        for to, at in ((k, k + d),) if step == 1 else ((k, k + int(q)), (k + 1, k + int(p))):
            a[[to, at]] = a[[at, to]]
            a[:, [to, at]] = a[:, [at, to]]
        if step == 1:
            positive += bool(a[k, k] > 0)
            a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :] / a[k, k])
        else:
            positive += 1
            a[k + 2 :, k + 2 :] -= a[k + 2 :, k : k + 2] @ np.linalg.solve(a[k : k + 2, k : k + 2], a[k : k + 2, k + 2 :])
        k += step
    return positive


def over(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of v are over shift."""
    return pivots(v - shift * np.eye(len(v)))


def _direction(v: np.ndarray, shift: float, x: np.ndarray, size: float) -> np.ndarray:
    """A step of inverse iteration; a shift that is an eigenvalue is moved by rounding."""
    eye = np.eye(len(v))
    for move in (0.0, 1.0, 4.0):
        try:
            y = np.linalg.solve(v - (shift + move * _EPS * size) * eye, x)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(y).all() and (norm := np.linalg.norm(y)) > 0:
            return y / norm
    return x


def _orthogonal(x: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for f in found:
            x = x - (f @ x) * f
    return x / np.linalg.norm(x)


def slices(v: np.ndarray, components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues of a positive semidefinite matrix, falling, and their unit vectors as rows."""
    d = len(v)
    size = float(np.abs(v).sum(axis=1).max(initial=0))  # no eigenvalue is larger
    if d == 0 or size == 0:
        return np.zeros(0), np.zeros((0, d))
    floor_, close = 4 * d * _EPS * size, 8 * _EPS * size
    counts: dict[float, int] = {floor_: over(v, floor_), size * (1 + 1e-9): 0}
    k_most = min(components, counts[floor_], d)
    values: list[float] = []
    vectors: list[np.ndarray] = []
    random = np.random.default_rng(7)
    for k in range(1, k_most + 1):
        # The tightest shifts known so far with at least k, and fewer than k, eigenvalues over them.
        lo = max(s for s, c in counts.items() if c >= k)
        hi = min(s for s, c in counts.items() if c < k)

        def halve(lo: float, hi: float, k: int = k) -> tuple[float, float]:
            mid = (lo + hi) / 2
            counts[mid] = over(v, mid)
            return (mid, hi) if counts[mid] >= k else (lo, mid)

        while (counts[lo] != k or counts[hi] != k - 1) and hi - lo > close:
            lo, hi = halve(lo, hi)
        while True:
            alone = counts[lo] == k and counts[hi] == k - 1
            x = _orthogonal(random.standard_normal(d), vectors)
            shift, e = (lo + hi) / 2, None
            for step in range(40):
                x = _orthogonal(_direction(v, shift, x, size), vectors)
                quotient = float(x @ v @ x)
                residual = float(np.linalg.norm(v @ x - quotient * x))
                if step < 2:  # inverse iteration first
                    continue
                if not lo - close <= quotient <= hi + close:
                    break
                done = residual <= 4 * d * _EPS * size
                if done and (e is not None or residual == 0):
                    e = quotient
                    break
                if done:
                    e = quotient  # one more step, cubically better
                shift = quotient
            inside = e is not None and lo - close <= e <= hi + close
            # Certified: k - 1 eigenvalues over it, and k over just below it.
            if inside and (not alone or (over(v, e + floor_) <= k - 1 and over(v, e - floor_) >= k)):
                break
            if hi - lo <= close:  # can't be told from its neighbours
                e = float(x @ v @ x)
                break
            lo, hi = halve(lo, hi)
        values.append(e)
        vectors.append(x)
    order = np.argsort(-np.array(values), kind="stable") if values else np.zeros(0, int)
    return np.array(values)[order], np.array(vectors).reshape(-1, d)[order]


def fit_rows(df: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, x): the rows that remain, entries as integers."""
    c = F.col(vector).cast("array<double>")
    sound = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < 2.0**56))
    rows = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(F.coalesce(sound, F.lit(False)))
    return rows.select(F.col(key).cast("long").alias("vec_id"), F.transform(c, lambda e: F.floor(F.lit(SCALE) * e).cast("long") + OFFSET).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def totals(rows: DataFrame) -> tuple[int, list[int]]:
    """n and the sums S per dimension, of rows of one length. Sums are exact, of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, None, None
        for b in batches:
            x = _matrix(b.column(0))
            for at in range(0, len(x), 1 << 20):  # high and low halves can't overflow for so many rows
                part = x[at : at + (1 << 20)]
                h, w = (part >> 32).sum(axis=0).astype(object), (part & 0xFFFFFFFF).sum(axis=0).astype(object)
                high, low = (h, w) if high is None else (high + h, low + w)
            n += len(x)
        if n:
            sums = [str((int(h) << 32) + int(w)) for h, w in zip(high, low, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sums], pa.list_(pa.string()))], ["n", "s"])

    parts = rows.select("x").mapInArrow(run, "n long, s array<string>")
    each = parts.select("n", F.posexplode("s").alias("i", "s")).groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # a row a dimension
    if not each:
        return 0, []
    return each[0]["n"], [int(r["s"]) for r in sorted(each, key=lambda r: r["i"])]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, from whole parts and remainders."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(float) - rest


def covariance(rows: DataFrame, image, d: int) -> np.ndarray:
    """The covariance (divisor n) of image(x) over all rows, d wide.

    A task centres each batch by its own mean and joins it to what it has; tasks are joined likewise.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if b.num_rows:
                y = image(_matrix(b.column(0)))
                mean = y.mean(axis=0)
                c = y - mean
                held = joined(held, (len(y), mean, c.T @ c))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1].tolist()]), pa.array([held[2].ravel().tolist()])], ["n", "mean", "m"])

    def joined(a, b):
        if a is None:
            return b
        n = a[0] + b[0]
        gap = b[1] - a[1]
        return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            for n, mean, m in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held = joined(held, (n, np.array(mean), np.array(m).reshape(d, d)))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1].tolist()]), pa.array([held[2].ravel().tolist()])], ["n", "mean", "m"])

    schema = "n long, mean array<double>, m array<double>"
    parts = rows.select("x").mapInArrow(run, schema)
    # A d x d row a task; joined in two rounds, so that neither the driver nor one task holds those of all.
    for width in (64, 1):
        parts = parts.coalesce(width) if width == 1 else parts.repartition(width)
        parts = parts.mapInArrow(merge, schema)
    got = parts.first()
    return np.array(got["m"]).reshape(d, d) / got["n"]


def whitened(df: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each remaining row and component."""
    schema = "vec_id long, n long, deviation long, identity_error double, z array<struct<whitened:double,explained:double>>"
    rows = fit_rows(df, vector, key)
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    n, sums, values, vectors, trace, error = 0, [], np.zeros(0), np.zeros((0, 0)), 0.0, 0.0
    if lengths:
        rows = rows.where(F.size("x") == lengths["d"])
        n, sums = totals(rows)
        v = covariance(rows, lambda x: _centred(x, n, sums), len(sums))
        v = (v + v.T) / 2
        values, vectors = slices(v, components)
        trace = float(np.trace(v))
    scaled = (vectors / np.sqrt(values)[:, None]).T if len(values) else np.zeros((0, 0))
    explained = (values / trace).tolist() if len(values) else []
    if len(values):
        own = covariance(rows, lambda x: _centred(x, n, sums) @ scaled, len(values))
        error = float(np.abs(own - np.eye(len(values))).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("whitened", pa.float64()), ("explained", pa.float64())]))
        for b in batches:
            x = _matrix(b.column(1)) if b.num_rows else np.zeros((0, len(sums)), np.int64)
            z = _centred(x, n, sums) @ scaled
            m = len(x)
            flat = pa.StructArray.from_arrays([pa.array(z.ravel()), pa.array(explained * m, pa.float64())], ["whitened", "explained"])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, max(len(values), 1), dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n] * m, pa.int64()), pa.array(deviations(x, n, sums), pa.int64()), pa.array([error] * m, pa.float64()), lists.cast(kind)], ["vec_id", "n", "deviation", "identity_error", "z"])

    if not len(values):
        return df.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    out = rows.select("vec_id", "x").mapInArrow(run, schema)
    return out.select("vec_id", "n", "deviation", "identity_error", F.posexplode("z").alias("i", "e")).select("vec_id", (F.col("i") + 1).alias("component"), "n", "deviation", "e.whitened", "e.explained", "identity_error")


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Per row the sum of (n x - S) ** 2, exact; None beyond 64 bits."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = [s % n for s in sums]
    most = float(np.abs((x - whole).astype(float)).max(initial=0)) * n + n
    if most * most * max(len(sums), 1) < 2.0**62:
        gap = n * (x - whole) - np.array(rest, np.int64)
        return (gap * gap).sum(axis=1).tolist()
    out = [sum((n * (int(c) - int(w)) - r) ** 2 for c, w, r in zip(row, whole, rest, strict=True)) for row in x]
    return [v if v < 1 << 63 else None for v in out]
