"""Quality classifier by positive-unlabelled learning.

Trusted positives (documents labelled good, outside the held-out fold) and
unlabelled web text (documents, whatever their label) train a small network that
minimises the non-negative unbiased risk: with p the estimated share of good
documents, loss l and output g,

    p E_pos[l(g, +)] + max(0, E_unl[l(g, -)] - p E_pos[l(g, -)]).

Negative labels are never used. The share p is estimated from positives and
unlabelled rows alone: a classifier that tells the two apart is fitted on one half of
each; among the other halves, the rows that score above a threshold are a share of the
unlabelled ones that is at least p times their share of the positives, and the threshold
where a confidence bound of that quotient is least gives the estimate. Features are whole-text statistics: byte classes,
word lengths, repetition and compressibility.

Training uses at most about max_train labelled positives and, as a parameter of its
own, about max_unlabelled unlabelled rows, chosen by a hash of doc_id (a test shows that
the result doesn't move with it). Everything else covers all rows.

Results in special cases: null and empty texts are scored like any (their
statistics are zero); a null doc_id is a row like others; without positives every
score is 0; labels that are all positive are enough; rows repeated yield a row each; a
very long text is measured whole;
further columns stay in quality_kept and are ignored in quality.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, text_of

MAX_TRAIN, MAX_UNLABELLED, THRESHOLD, HIDDEN = 20_000, 20_000, 0.3, 24
#: Classes of bytes whose shares are features.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b"\t\r", b".", b",", b"!", b"?", b"#$%&*^~", b"|", b"<>{}[]=\\/_", b"\"'()", b":;-", b"@+")


def statistics(text: str) -> list[float]:
    import zlib

    raw = text.encode("utf-8", "surrogatepass")
    n = max(len(raw), 1)
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = [float(h[list(c)].sum()) / n for c in CLASSES] + [float(h[128:].sum()) / n]
    words, lines = raw.split(), raw.split(b"\n")
    k = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    packed = len(zlib.compress(raw, 1)) / n
    return [*shares, np.log1p(len(words)), np.log1p(lengths.mean()), np.log1p(lengths.std()), np.log1p(lengths.max()), len(set(words)) / k, len(set(lines)) / len(lines), np.log1p(len(lines)), np.log1p(n / len(lines)), packed, np.log1p(len(words) / max(h[46] + h[33] + h[63], 1))]


N_FEATURES = len(statistics("x"))


@dataclass
class Model:
    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: tuple[np.ndarray, ...] = ()

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), float(self.prior > 0))
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        w1, b1, w2, b2 = self.layers
        return 1 / (1 + np.exp(-np.clip(np.tanh(z @ w1 + b1) @ w2 + b2, -40, 40)))


def nn_pu(pos: np.ndarray, unl: np.ndarray, prior: float, epochs: int = 60, seed: int = 0, hidden: int = HIDDEN, corrected: bool = True) -> Model:
    """Minimises the non-negative risk with logistic loss by Adam; uncorrected, unlabelled rows count as negatives."""
    rng = np.random.default_rng(seed)
    both = np.vstack([pos, unl])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (pos, unl))
    par = [rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in par], [np.zeros_like(a) for a in par], 0
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def forward(x):
        a = np.tanh(x @ par[0] + par[1])
        return a, a @ par[2] + par[3]

    size_p, size_u = min(len(p), 256), min(len(u), 1024)
    rounds = max(1, min(len(u) // size_u, 40))
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 1e-4
        for _ in range(rounds):
            bp, bu = p[rng.integers(0, len(p), size_p)], u[rng.integers(0, len(u), size_u)]
            (ap, gp), (au, gu) = forward(bp), forward(bu)
            share = prior if corrected else 0.0
            negative = np.logaddexp(0, gu).mean() - share * np.logaddexp(0, gp).mean()
            du, dp = sig(gu) / size_u, -share * sig(gp) / size_p  # of the negative part
            if negative < 0:  # over-fitted: step back on it alone
                du, dp = -du, -dp
            else:
                dp = dp - prior * sig(-gp) / size_p
            grads = [0.0, 0.0, 0.0, 0.0]
            for x, a, d in ((bp, ap, dp), (bu, au, du)):
                back = d[:, None] * par[2] * (1 - a * a)
                grads = [grads[0] + x.T @ back, grads[1] + back.sum(0), grads[2] + a.T @ d, grads[3] + d.sum(keepdims=True)]
            step += 1
            for i, g in enumerate(grads):
                g = g + 1e-4 * par[i]
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                par[i] = par[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Model(prior, mean, scale, tuple(par))


def estimated_prior(pos: np.ndarray, unl: np.ndarray, seed: int = 0) -> float:
    """The share of positives among the unlabelled rows."""
    r = np.random.default_rng(seed)
    p, u = pos[r.permutation(len(pos))], unl[r.permutation(len(unl))]
    found = []
    for k in (0, 1):  # either half fits, the other measures
        model = nn_pu(p[k::2], u[k::2], 1.0, epochs=20, seed=seed, corrected=False)
        a, b = (model.score(x[1 - k :: 2]) for x in (p, u))
        if len(a) and len(b):
            at = np.unique(a)
            above = lambda s: 1 - np.searchsorted(np.sort(s), at, "left") / len(s)  # noqa: B023,E731
            qp, qu = above(a), above(b)
            slack = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(a)) + 1 / np.sqrt(len(b)))
            i = int(np.argmin((qu + slack) / qp))
            found.append(qu[i] / qp[i])
    return float(np.clip(np.mean(found) if found else 0.5, 0.01, 0.99))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = pa.array([statistics(t) for t in b.column(0).to_pylist()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), x], ["pos", "unl", "x"])


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN, max_unlabelled: int = MAX_UNLABELLED, prior: float | None = None) -> Model:
    own = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("y")).where("_id is not null and y is not null")
    own = own.where(fold_of(F.col("_id")) != 0).groupBy("_id").agg(F.max("y").alias("y"))
    good = own.where("y = 1").count()
    if not good:
        return Model(0.0)
    unit = 1 << 30
    pick = lambda id_, seed, share: F.pmod(F.xxhash64(id_, F.lit(seed)), F.lit(unit)) < int(min(1.0, share) * unit)
    # At most about max_train trusted positives: safe to broadcast.
    trusted = F.broadcast(own.where("y = 1").where(pick(F.col("_id"), 23, max_train / good)).select("_id", F.lit(True).alias("pos")))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), text_of().alias("text"))
    chosen = rows.join(trusted, "_id", "left").select("text", F.coalesce("pos", F.lit(False)).alias("pos"), pick(F.col("_id"), 29, max_unlabelled / max(docs.count(), 1)).alias("unl")).where("pos or unl")
    got = chosen.mapInArrow(_measured, "pos boolean, unl boolean, x array<double>").collect()  # about max_train + max_unlabelled rows of statistics
    take = lambda k: np.array([r["x"] for r in got if r[k]], np.float64).reshape(-1, N_FEATURES)
    pos, unl = take("pos"), take("unl")
    if not len(pos) or not len(unl):
        return Model(float(bool(len(pos))))
    return nn_pu(pos, unl, estimated_prior(pos, unl) if prior is None else prior)


def quality(docs: DataFrame, labels: DataFrame, model: Model | None = None, **how) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= 0.3), for each row."""
    fitted = model or fit_quality(docs, labels, **how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in b.column(1).to_pylist()], np.float64).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fitted.score(x), pa.float64())], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def quality_kept(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows that the classifier accepts, with all their columns; scored where they lie, without a join."""
    fitted = fit_quality(docs, labels, **how)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(fitted.score(np.array([statistics(x) for x in t], np.float64).reshape(-1, N_FEATURES)))

    return docs.where(scored(text_of()) >= THRESHOLD)
