"""The pipeline against its stages written plainly."""

import corpus_pipeline as cp
from tests.llm.test_edges import brute_components, low


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [low(r["text"]).split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    at = docs
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality classifier", "line dedup", "n-gram jaccard join", "benchmark decontamination", "best-fit packing"]
    from pointloom.llm.common import written
    from pointloom.llm.quality import quality

    scores = {r["doc_id"]: r["predicted"] for r in quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    for k, (name, stage) in enumerate(cp.STAGES):
        before = {r["doc_id"]: r["text"] or "" for r in at.collect()}
        at = written(stage(spark, at, sf), f"test{k}")
        if k < 4:
            assert at.columns == docs.columns
            after = {r["doc_id"]: r["text"] or "" for r in at.collect()}
        if name == "quality classifier":
            assert set(after) == {d for d, p in scores.items() if p} and 0 < len(after) < len(before)
        elif name == "line dedup":
            first = {}
            for d in sorted(before):
                for line in before[d].split("\n"):
                    first.setdefault(low(line.strip(" \t\n\x0b\x0c\r")), d)
            for d, t in before.items():
                keys = [(line, low(line.strip(" \t\n\x0b\x0c\r"))) for line in t.split("\n")]
                assert after[d] == "\n".join(line for line, key in keys if len(key) < 10 or first[key] == d)
        elif name == "n-gram jaccard join":
            want = brute_components(list(before.items()))
            assert set(after) == {d for d, (n, c) in want.items() if n == 0 or c == d}
        elif name == "benchmark decontamination":
            for d, t in before.items():
                whole = f" {' '.join(low(t).split())} "
                if any(f" {' '.join(b)} " in whole for b in bench):
                    assert d not in after
            assert len(after) > 0.8 * len(before)
        else:
            assert {r["doc_id"] for r in at.collect()} == set(before)
    assert cp.run(spark, sf).count() > 0


def test_empty_documents(spark, sf, tmp_path):
    empty = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in cp.STAGES:
        out = stage(spark, empty, sf)
        assert out.count() == 0
