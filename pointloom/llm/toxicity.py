"""Toxicity by a weighted lexicon.

Texts are folded (lower case, homoglyphs and digit substitutions to plain
letters, other signs to blanks) and matched by an Aho-Corasick automaton against
patterns: whole words and stems at the start of a word. Each pattern has a weight,
the log-odds of toxic documents that hold it. Hits inside exception phrases don't
count. The weights found are normalised by the length of the text and turned into
a score by a logistic function.

Lexicon, exceptions and logistic function are learned from labelled documents
outside the held-out fold, at most about max_train of them (a documented bound on
labelled rows; they are chosen by a hash of doc_id). Pattern counts are Spark
aggregations. All patterns and exceptions that pass the tests are taken: their number is
bounded by that of the labelled rows, three of which must hold each.

Results in special cases: null and empty texts get the score of a text without
hits; a null doc_id is a row like others; without labels, or with one class only,
every score is the share of toxic rows (0 without rows); rows repeated yield a row
each; a very long text is matched whole in one pass; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, text_of

MAX_TRAIN, LEAST_LLR = 20_000, 25.0
STEMS = range(3, 8)
#: Letters that look like Latin ones, and substitutes for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q",
    "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}


class _Fold(dict):
    """For str.translate: code point → folded text."""

    def __missing__(self, cp: int) -> str:
        c = chr(cp)
        if 0xFF01 <= cp <= 0xFF5E:  # full-width forms
            c = chr(cp - 0xFEE0)
        c = c.lower()
        c = HOMOGLYPHS.get(c) or SUBSTITUTES.get(c) or c
        if 0x300 <= cp < 0x370 or cp in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD):  # combining, invisible
            c = ""
        elif not c.isalnum():
            c = " "
        self[cp] = c
        return c


_FOLD = _Fold()


def folded(text: str) -> str:
    """' word word ... ': a blank at either end and one between words."""
    return f" {' '.join(text.translate(_FOLD).split())} "


def _patterns(text: str) -> set[str]:
    words = set(folded(text).split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in STEMS if len(w) > k}


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    logistic: tuple[float, float, float] = (0.0, 0.0, 0.0)  # bias, any hit, weight by length

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for p, w in self.weights.items():
            a.add_word(p, (p, w))
        for p in self.exceptions:
            if p not in self.weights:
                a.add_word(p, (p, None))
        if len(a):
            a.make_automaton()
        return a

    def hits(self, automaton, text: str) -> tuple[list[tuple[int, str, float]], int, str]:
        """(start, pattern, weight) of the hits outside exceptions; the number of words; the folded text."""
        f = folded(text)
        found, shielded = [], []
        if len(automaton):
            for end, (p, w) in automaton.iter(f):
                start = end - len(p) + 1
                if w is None:
                    shielded.append((start, end))
                else:
                    found.append((start, p, w))
        if shielded:
            found = [x for x in found if not any(a <= x[0] and x[0] + len(x[1]) - 1 <= b + 1 for a, b in shielded)]
        return found, max(f.count(" ") - 1, 0), f

    def features(self, automaton, text: str) -> tuple[float, float]:
        found, words, _ = self.hits(automaton, text)
        total = sum(w for _, _, w in found)
        return float(bool(found)), math.log1p(total) / math.log(10 + words) if total > 0 else 0.0

    def score(self, x: tuple[float, float]) -> float:
        z = self.logistic[0] + self.logistic[1] * x[0] + self.logistic[2] * x[1]
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def llr(a: float, b: float, c: float, d: float) -> float:
    """Log-likelihood ratio of the table a, b / c, d."""
    n = a + b + c + d
    return 2 * sum(o * math.log(o * n / (r * k)) for o, r, k in ((a, a + b, a + c), (b, a + b, b + d), (c, c + d, a + c), (d, c + d, b + d)) if o > 0)


def _llr_sql(t: int, n: int) -> str:
    """llr(toxic, t - toxic, clean, n - clean) as a SQL expression."""
    cells = (("toxic", "(toxic + clean)", t), (f"({t} - toxic)", f"({t + n} - toxic - clean)", t), ("clean", "(toxic + clean)", n), (f"({n} - clean)", f"({t + n} - toxic - clean)", n))
    return "2 * (" + " + ".join(f"if({o} > 0, {o} * ln({o} * {t + n}D / ({r} * {c}D)), 0)" for o, r, c in cells) + ")"


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_train: int) -> DataFrame:
    """(text, y) of labelled documents outside the held-out fold, about max_train at most, by a hash of doc_id."""
    own = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("y")).where("_id is not null and y is not null")
    own = own.where(fold_of(F.col("_id")) != 0).groupBy("_id").agg(F.max("y").alias("y"))
    n = own.count()
    share = min(1.0, max_train / max(n, 1))
    own = own.where(F.pmod(F.xxhash64("_id", F.lit(17)), F.lit(1 << 30)) < int(share * (1 << 30)))
    # At most about max_train rows: safe to broadcast.
    return docs.select(F.col("doc_id").cast("long").alias("_id"), text_of().alias("text")).join(F.broadcast(own), "_id").select("text", "y")


def _counted(rows: DataFrame, find) -> DataFrame:
    """(pattern, toxic, clean): documents by pattern; find(text) gives a document's patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        counts = (Counter(), Counter())
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts[int(y)].update(find(t))
                if len(counts[0]) + len(counts[1]) > 500_000:
                    yield _batch(counts)
                    counts = (Counter(), Counter())
        yield _batch(counts)

    def _batch(counts) -> pa.RecordBatch:
        keys = list(counts[0].keys() | counts[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], ["pattern", "toxic", "clean"])

    return rows.mapInArrow(run, "pattern string, toxic long, clean long").groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit_lexicon(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_train: int = MAX_TRAIN, exceptions: tuple[str, ...] = ()) -> Lexicon:
    rows = training_rows(docs, labels, label, max_train).cache()
    try:
        total = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        t, n = total.get(1, 0), sum(v for k, v in total.items() if k != 1)
        if not t or not n:
            share = t / max(t + n, 1)
            return Lexicon(logistic=(math.log(max(share, 1e-9) / max(1 - share, 1e-9)), 0.0, 0.0))
        # A pattern passes only if it is far more common in toxic documents than chance allows.
        counted = _counted(rows, _patterns).where(f"toxic >= 3 and toxic * {n} > 3 * clean * {t}").where(_llr_sql(t, n) + f" >= {LEAST_LLR - 0.01}").collect()
        scored = [(llr(r["toxic"], t - r["toxic"], r["clean"], n - r["clean"]), r["pattern"], math.log((r["toxic"] + 0.5) / (t + 1)) - math.log((r["clean"] + 0.5) / (n + 1))) for r in counted]
        weights: dict[str, float] = {}
        for g, p, w in sorted(scored, key=lambda x: (-x[0], -len(x[1]), x[1])):
            if g < LEAST_LLR:
                break
            stem = p.rstrip()
            if not any(stem.startswith(q.rstrip()) or q.startswith(stem) for q in weights):
                weights[p] = w
        lex = Lexicon(weights=weights)
        auto = lex.automaton()

        def phrases(text: str) -> set[str]:
            found, _, f = lex.hits(auto, text)
            out = set()
            for start, _, _ in found:
                end = f.index(" ", start + 1)
                before, after = f.rfind(" ", 0, start), f.find(" ", end + 1)
                if start > 0:
                    out.add(f[before : end + 1])
                if after > 0:
                    out.add(f[start : after + 1])
            return out

        # Exception phrases: a hit with its neighbour that is common in clean documents and not telling.
        safe = _counted(rows, phrases).where(f"clean >= 3 and toxic * {n} <= 2 * clean * {t}").collect()
        lex.exceptions = frozenset(r["pattern"] for r in safe) | frozenset(folded(x) for x in exceptions)
        lex.logistic = _fit_logistic(lex, rows)
        return lex
    finally:
        rows.unpersist()


def _fit_logistic(lex: Lexicon, rows: DataFrame) -> tuple[float, float, float]:
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = lex.automaton()
        for b in batches:
            x = [lex.features(auto, t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in x], pa.float64()), pa.array([v[1] for v in x], pa.float64()), b.column(1).cast(pa.int32())], ["a", "b", "y"])

    got = np.array([tuple(r) for r in rows.mapInArrow(run, "a double, b double, y int").collect()])  # three numbers a labelled row
    x, y = np.column_stack([np.ones(len(got)), got[:, :2]]), (got[:, 2] == 1).astype(float)
    w = np.zeros(3)
    for _ in range(60):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(3), x.T @ (y - p) - 0.5 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def toxicity(docs: DataFrame, labels: DataFrame, lexicon: Lexicon | None = None, **how) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= 0.5), n_hits, for each row."""
    lex = lexicon or fit_lexicon(docs, labels, **how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = lex.automaton()
        for b in batches:
            scores, hits = [], []
            for t in b.column(1).to_pylist():
                found, words, _ = lex.hits(auto, t)
                total = sum(w for _, _, w in found)
                scores.append(lex.score((float(bool(found)), math.log1p(total) / math.log(10 + words) if total > 0 else 0.0)))
                hits.append(len(found))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(hits, pa.int64())], ["doc_id", "score", "n_hits"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, score double, n_hits long")
    return out.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits")
