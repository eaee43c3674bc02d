"""Rows are known by id and text: nulls, repeated rows, two texts under one id, names in any case; every stage of the pipeline."""

import random

import corpus_pipeline as cp
import pytest
from tests.llm.conftest import EXTRA

from pointloom.llm import line_dedup, ngram_join, substring_dedup

TWO = "doc_id long, text string"


def words(r, n, mark="n"):
    return [f"{mark}{r.randrange(10**6)}" for _ in range(n)]


def test_other_texts_under_an_id_stay(spark):
    r = random.Random(1)
    x = words(r, 60)
    near, other = " ".join([*x[:59], "changed"]), " ".join(words(r, 60))
    x = " ".join(x)
    for id_ in (None, 5):
        kept = ngram_join.near_deduplicated(spark.createDataFrame([(1, x), (id_, near), (id_, other), (id_, "")], TWO)).collect()
        assert sorted((tuple(k) for k in kept), key=repr) == sorted([(1, x), (id_, other), (id_, "")], key=repr)
    kept = ngram_join.near_deduplicated(spark.createDataFrame([(None, x), (None, near), (7, other), (7, other)], TWO)).collect()
    assert len(kept) == 4  # a group without ids stays, and so do repeated rows


def test_passages_of_texts_without_ids(spark):
    """x is like base, base like z, and x unlike z: one class, whatever base's id is."""
    r = random.Random(2)
    base = [f"b{i}" for i in range(60)]
    x, z = list(base), list(base)
    x[30], z[12] = "x1", "z1"
    wrapped = lambda p: " ".join(words(r, 30) + p + words(r, 30))
    texts = [wrapped(x), wrapped(base), wrapped(z)]
    for id_ in (2, None):
        got = substring_dedup.substring_dedup(spark.createDataFrame([(1, texts[0]), (id_, texts[1]), (3, texts[2])], TWO)).collect()
        assert {g["class_id"] for g in got} == {1}
    alone = substring_dedup.substring_dedup(spark.createDataFrame([(None, texts[0]), (None, texts[1]), (9, " ".join(words(r, 70)))], TWO)).collect()
    assert {(g["doc_id"], g["class_id"]) for g in alone} == {(None, None), (9, 9)} and sum(g["n_dup_words"] > 0 for g in alone) == 1


def test_cutting_texts_under_one_id(spark):
    r = random.Random(3)
    p = words(r, 60)
    long, short = " ".join(words(r, 40) + p + words(r, 40)), "short text here"
    rows = [(1, " ".join(p + words(r, 50))), (2, long), (2, short), (2, None), (None, " ".join(words(r, 20) + p)), (2, long)]
    cut = substring_dedup.without_passages(spark.createDataFrame(rows, "doc_id long, TEXT string")).collect()
    got = sorted(((c["doc_id"], len((c["TEXT"] or "").split())) for c in cut), key=repr)
    assert got == sorted([(1, 110), (2, 80), (2, 80), (2, 3), (2, 0), (None, 20)], key=repr)
    assert any(c["TEXT"] is None for c in cut)


def test_name_of_the_text_column_in_any_case(spark):
    df = spark.createDataFrame([(1, "a common line\nx"), (2, "A common line\ny")], "doc_id long, TEXT string")
    assert sorted(tuple(r)[:2] for r in line_dedup.line_dedup(df).collect()) == [(1, "a common line\nx"), (2, "y")]


def test_equal_passages_behind_unlike_leaders(spark):
    """Four earlier documents hold a phrase of the passage that two later ones have whole; nothing of it is lost."""
    rows, want = [], {}
    for f in range(40):
        r = random.Random(100 + f)
        p = words(r, 50, f"p{f}x")
        cut = r.randrange(0, 50 - 32 + 1)
        docs = [words(r, 40) + p[cut : cut + 32] + words(r, 40) for _ in range(4)] + [words(r, 35) + p + words(r, 35) for _ in range(2)]
        rows += [(10 * f + n, " ".join(d)) for n, d in enumerate(docs)]
        want |= {10 * f + n: 10 * f + min(n, 4) for n in range(6)}
    got = {g["doc_id"]: g["class_id"] for g in substring_dedup.substring_dedup(spark.createDataFrame(rows, TWO).repartition(4)).collect()}
    assert got == want


def test_passages_within_a_component_behind_unlike_leaders(spark):
    """Earlier documents hold phrases of a passage, two for each row of it; the two that have it whole are one component by another passage."""
    rows, last = [], []
    for f in range(10):
        r = random.Random(100 + f)
        p, q = words(r, 50, f"p{f}x"), words(r, 60, f"q{f}x")
        docs = [words(r, 40) + p[at : at + 32] + words(r, 40) for at in (0, 7, 14, 18) for _ in range(2)] + [words(r, 35) + p + words(r, 300) + q + words(r, 35) for _ in range(2)]
        rows += [(10 * f + n, " ".join(d)) for n, d in enumerate(docs)]
        last.append(10 * f + 9)
    got = {g["doc_id"]: g for g in substring_dedup.substring_dedup(spark.createDataFrame(rows, TWO).repartition(4)).collect()}
    assert all({i for s in got[d]["spans"] for i in range(s["start"], s["start"] + s["n"])} >= {*range(35, 85), *range(385, 445)} for d in last)
    assert {d for d in got if got[d]["n_dup_words"]} == {*last}


@pytest.fixture
def odd_documents(spark, odd_rows):
    r = random.Random(4)
    x = " ".join(words(r, 80))
    more = [(20, x), (21, x + " tail"), (21, "another text\nunder the same id"), (None, x), (None, "no id either, and another text"), (22, x), (22, x)]
    return spark.createDataFrame([*odd_rows, *((d, t, "en", "s", len(t), 1, "h", "r", "c", "kept", "x", 7, 1) for d, t in more)], EXTRA).repartition(3)


def bag(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_documents(spark, sf, odd_documents, k):
    """Nulls, repeated rows, two texts under one id, very long texts, and columns named as the operators' own."""
    name, stage = cp.STAGES[k]
    before, out = bag(odd_documents), stage(spark, odd_documents, sf)
    if name == "best-fit packing":
        assert {r["doc_id"] for r in out.collect()} == {d for d, _ in before}
        return
    assert out.columns == odd_documents.columns
    after = bag(out)
    if name == "line dedup":
        assert sorted((d for d, _ in after), key=repr) == sorted((d for d, _ in before), key=repr)
    else:
        left = list(before)
        for row in after:
            left.remove(row)  # each row that stays is one of those before, as often as it was
    if name == "n-gram jaccard join":
        kept = {t for d, t in after if d == 21 or d is None}
        assert "another text\nunder the same id" in kept and "no id either, and another text" in kept
        assert {d for d, t in after if d in (20, 21, 22)} == {20, 21}
    if name == "benchmark decontamination":
        assert after == before
