"""Merkle manifest, WARC conversion and whitening: brute force, round trips, special cases."""

import gzip
import hashlib
import io
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.test_edges import low

from pointloom.llm import merkle, numbering, warc, whitening
from pointloom.scratch import scratch_path


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    recs = []
    for d, source, lang, n, text in rows:
        def leaf(t, d=d, source=source, lang=lang, n=n):
            return sha("".join(map(field, (d, source, lang, n, t))))

        hit = d is not None and zlib.crc32(str(d).encode()) % 3 == 0
        recs.append((lang, d, leaf(text), leaf(low(text)) if hit and text is not None else leaf(text)))
    groups = [sorted((r for r in recs if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])) for g in sorted({r[0] for r in recs}, key=lambda v: (v is not None, (v or "").encode()))]
    trees = [tree([r[2] for r in g]) for g in groups]
    top = tree([t[-1][0] for t in trees])
    out = []
    for gi, g in enumerate(groups):
        for i, (_, d, leaf, node) in enumerate(g):
            beside = ""
            for levels, p in ((trees[gi], i), (top, gi)):
                for level in levels[:-1]:
                    s = p // 8 * 8
                    left, right = "".join(level[s:p]), "".join(level[p + 1 : s + 8])
                    beside, node, p = beside + left + right, sha(left + node + right), p // 8
            out.append((d, leaf, trees[gi][-1][0], top[-1][0], sha(beside), node, node == top[-1][0]))
    return sorted(out, key=repr)


MANIFEST = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize(("n", "langs", "local"), [(1, 1, 3), (8, 1, 1), (9, 1, 1), (700, 1, 1), (150, 20, 0), (75, 2, 0)])
def test_manifest_against_brute_force(spark, n, langs, local):
    """One group in one block, ragged last nodes on several levels, more groups than a run."""
    rows = [(i * 7, None if i % 5 == 0 else f"s{i % 3}", None if i % langs == 0 else f"é{i % langs}", i, f"Text {i} ÄÖ") for i in range(n)]
    got = merkle.merkle_digest(spark.createDataFrame(rows, MANIFEST).repartition(5), local).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_manifest(rows)


def test_manifest_edges(spark, odd, odd_rows, none):
    out = merkle.merkle_digest(odd)
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in odd_rows]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute_manifest(rows)
    empty = merkle.merkle_digest(none)
    assert empty.count() == 0 and empty.columns == out.columns
    nulls = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None)], MANIFEST)
    got = {r["doc_id"]: r["leaf"] for r in merkle.merkle_digest(nulls).collect()}
    assert got == {None: sha("-----"), 1: sha("1:1----")}


def test_numbers(spark):
    rows = [(g, v) for g in ("a", None, "b") for v in [None, 3, 1, 1, 2] * 40]
    out = numbering.numbered(spark.createDataFrame(rows, "g string, v long").repartition(4), ["g"], ["v"]).collect()
    for g in ("a", None, "b"):
        mine = sorted((r["i"], r["v"], r["n"]) for r in out if r["g"] == g and r["v"] is not None)
        assert [i for i, _, _ in mine] == list(range(40, 200)) and [v for _, v, _ in mine] == [1] * 80 + [2] * 40 + [3] * 40
        assert {r["n"] for r in out if r["g"] == g} == {200}


FAKE = "<p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nhttp://x/ 0.0.0.0 20000101000000 text/html 5\nhello\n"
PAGES = [
    (1, "http://a.example/ with spaces\nand line", "<p>same</p>"), (2, "http://b.example/é", "<p>same</p>"), (9, None, "<p>same</p>"), (4, "http://c/", None), (5, "", ""), (6, "http://d/", FAKE),
    (7, "http://e/", "é" * 40_000), (8, "http://f/", "x\x00y\x00"), (8, "http://f/", "x\x00y\x00"), (None, "http://g/", "<p>same</p>"), (None, "http://h/", "alone"), (3, "http://i/", "HTTP/1.1 404 no\n\n"),
]


def brute_pages(pages):
    """(page_id, bytes, digest, refers_to) of each page, and how many responses a payload has: one."""
    groups = {}
    for p, _, html in pages:
        groups.setdefault((html or "").encode(), []).append(p)
    out = []
    for data, ids in groups.items():
        ids = sorted(ids, key=lambda v: (v is not None, v or 0))
        digest = warc.base64.b32encode(hashlib.sha1(data).digest()).decode()
        out += [(i, len(data), digest, "revisit", ids[-1]) for i in ids[:-1]] + [(ids[-1], len(data), digest, "response", None)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("parts", "size", "most"), [(1, 1 << 24, 200_000), (3, 300, 200_000), (3, 1 << 24, 0)])
def test_pages_through_both_formats(spark, monkeypatch, parts, size, most):
    """Also with archives of a record each, and with references that aren't broadcast."""
    monkeypatch.setattr(warc, "BROADCAST_REFERENCES", most)
    pages = spark.createDataFrame([(*p, 1, "x") for p in PAGES], "page_id long, url string, html string, digest long, id string").repartition(parts)
    out = warc.warc_digest(pages, archive_bytes=size)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute_pages(PAGES)
    assert warc.warc_digest(pages.where("false")).count() == 0


def test_payloads_under_the_least_length_are_no_revisits(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.warc_digest(pages, least=3).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}


def test_files_are_archives_of_gzip_members(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    arc, out = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    warc.write_arc(pages, arc)
    warc.arc_to_warc(spark, arc, out)
    (raw,) = (bytes(r["content"]) for r in warc.archives(spark, out).collect())
    members, at = [], 0
    while raw[at:].strip(b"\0"):
        z = zlib.decompressobj(31)
        members.append(z.decompress(raw[at:]))
        at = len(raw) - len(z.unused_data)
    assert len(members) == len(PAGES) + 1 and all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") for m in members)
    found = list(warc.read_warc(io.BytesIO(gzip.decompress(raw))))
    assert [f["warc-type"] for f, _ in found].count("warcinfo") == 1 and found[0][0]["warc-type"] == "warcinfo"
    ids = {f["warc-record-id"] for f, _ in found}
    assert len(ids) == len(found)
    for f, block in found[1:]:
        assert f["warc-block-digest"] == f"sha1:{warc.digest(block)}" and f["warc-date"] == "2000-01-01T00:00:00Z"
        if f["warc-type"] == "revisit":
            assert f["warc-refers-to"] in ids and f["warc-profile"] == warc.PROFILE and block.endswith(b"\r\n\r\n")
    assert not any("\n" in f.get("warc-target-uri", "") or " " in f.get("warc-target-uri", "") for f, _ in found)


def test_both_versions_of_arc():
    first = b"filedesc://old.arc 0.0.0.0 19960923142103 text/plain 78\n1 0 Some Crawler\nURL IP-address Archive-date Content-type Archive-length\n\n\n"
    first = first.replace(b" 78\n", b" %d\n" % (len(first.split(b"\n", 1)[1]) - 1))
    plain = b"http://a/b c d 1.2.3.4 199609231421 text/plain 12\nno header\n\n\n\ndns:x 1.2.3.4 19960923142103 text/dns 3\nabc\n"
    got = list(warc.read_arc(io.BytesIO(first + plain)))
    assert [(r["url"], r["mime"], r["block"]) for r in got] == [("http://a/b c d", "text/plain", b"no header\n\n\n"), ("dns:x", "text/dns", b"abc")]
    assert got[0]["name"] == "old.arc" and warc.iso_date(got[0]["date"]) == "1996-09-23T14:21:00Z"
    kinds = [next(warc.read_warc(io.BytesIO(warc.converted(r, None))))[0]["warc-type"] for r in got]
    assert kinds == ["resource", "response"]
    head = warc.arc_head("new.arc", 2)
    rec = warc.arc_record(2, "http://a/", warc.http_block(b"body", 7), len(head), "new.arc")
    (r,) = warc.read_arc(io.BytesIO(head + rec))
    assert (r["url"], r["offset"], r["name"], warc.http_parts(r["block"])[1]) == ("http://a/", len(head), "new.arc", b"body")
    with pytest.raises(ValueError, match="cut off"):
        list(warc.read_arc(io.BytesIO((head + rec)[:-4])))
    with pytest.raises(ValueError, match="cut off"):
        list(warc.read_warc(io.BytesIO(warc.converted(r, None)[:-9])))


def check_whitening(rows, vectors):
    """Rows of whitened() against NumPy's own eigenvectors."""
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(32, int((e > 1e-9 * e[0]).sum()))
    assert len(rows) == n * k and {r["n"] for r in rows} == {n}
    got = np.zeros((n, k))
    for r in rows:
        got[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == int(((n * x[r["vec_id"]] - s) ** 2).sum())
        assert abs(r["explained"] / (e[r["component"] - 1] / e.sum()) - 1) < 1e-9 and 0 <= r["identity_error"] < 1e-8
    want = c @ u[:, :k] / np.sqrt(e[:k])
    assert np.abs(got - want * np.sign((got * want).sum(axis=0))).max() < 1e-6


def test_whitening_of_the_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    vectors = [r["embedding"] for r in table.orderBy("vec_id").collect()]
    check_whitening(whitening.whitened(table.repartition(5)).collect(), vectors)


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.5, 2.0, -1.25], [1.0, -2.0, 0.0], [1.0, -2.0, 0.0], [0.0, 0.25, 3.0], [7.0, 0.0, 0.5]]
    bad = [None, [], [1.0, None, 2.0], [nan, 1.0, 1.0], [1.0, inf, 1.0], [1e300, 0.0, 0.0], [1.0, 2.0]]
    kind = "vec_id long, embedding array<double>, n string, x int, component string"
    df = spark.createDataFrame([(i, v, "n", 1, "c") for i, v in enumerate(good)] + [(100 + i, v, "n", 1, "c") for i, v in enumerate(bad)], kind).repartition(4)
    check_whitening(whitening.whitened(df).collect(), good)
    assert whitening.whitened(df.where("false")).count() == 0
    assert whitening.whitened(df.where("vec_id >= 100 and vec_id < 106")).count() == 0
    assert whitening.whitened(df.where("vec_id = 0")).count() == 0  # one row has no variance
    assert whitening.whitened(df.where("vec_id in (1, 2)")).count() == 0
    two = whitening.whitened(df.where("vec_id in (0, 1)")).collect()
    assert sorted((r["vec_id"], r["component"], round(abs(r["whitened"]), 9)) for r in two) == [(0, 1, 1.0), (1, 1, 1.0)]
    ids = spark.createDataFrame([(None, v) for v in good], "vec_id long, embedding array<float>")
    assert whitening.whitened(ids).where("vec_id is null").count() == 15


def test_deviations_beyond_64_bits():
    x = np.array([[1_000_000, 2_000_000], [3, 1 << 40], [5, 7]])
    n, sums = 3, [int(v) for v in x.sum(axis=0)]
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    assert whitening.deviations(x, n, sums) == [v if v < 1 << 63 else None for v in exact]
    assert whitening.deviations(x[:, :1], n, sums[:1]) == [(n * int(r[0]) - sums[0]) ** 2 for r in x]


@pytest.mark.parametrize("seed", range(4))
def test_slices_against_eigenvectors(seed):
    """Random spectra, equal and nearly equal eigenvalues, deficient rank."""
    r = np.random.default_rng(seed)
    d = [3, 9, 40, 64][seed]
    e = np.sort(r.choice([0.0, 1e-9, 1.0, 1.0 + 1e-12, 2.0, 7.5, *r.random(5)], d))[::-1]
    q = np.linalg.qr(r.standard_normal((d, d)))[0]
    v = (q * e) @ q.T
    v = (v + v.T) / 2
    values, vectors = whitening.slices(v)
    k = len(values)
    assert k >= min(32, int((e > 1e-8).sum())) and np.allclose(values, e[:k], atol=1e-12)
    assert np.abs(vectors @ vectors.T - np.eye(k)).max() < 1e-12
    assert np.abs(v @ vectors.T - vectors.T * values).max() < 1e-12
    for s in (e[0] + 1, e.mean() + 1e-3, -1.0):
        assert whitening.over(v, s) == int((e > s).sum())


def test_pivots_against_eigenvalues():
    r = np.random.default_rng(3)
    for n in range(1, 12):
        for _ in range(10):
            a = r.standard_normal((n, n)) * r.choice([0, 1, 1e-6], (n, n))
            a = a + a.T
            e = np.linalg.eigvalsh(a)
            if np.abs(e).min() > 1e-12:
                assert whitening.pivots(a) == int((e > 0).sum())


def test_queries_read_whole_tables(spark, sf):
    from pointloom.llm import entries

    q = entries.queries()
    docs, pages, vectors = (spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("documents", "pages", "embeddings"))
    assert q["op11_merkle_manifest"](spark, sf).count() == docs and q["op12_warc"](spark, sf).count() == pages
    assert q["op13_whitening"](spark, sf).agg(F.countDistinct("vec_id")).first()[0] == vectors


def test_blocks_hold_leaves_only(spark):
    """A row of the table of blocks doesn't hold the siblings of each leaf: bytes a leaf, written without compression."""
    import glob
    import os
    import tempfile

    rows = [(i, "s", "en", i, f"Text {i}") for i in range(1500)]
    docs = spark.createDataFrame(rows, MANIFEST)
    numbered_ = numbering.numbered(merkle.leaves(docs), ["grp"], ["doc_id", "leaf", "other"])
    with tempfile.TemporaryDirectory() as d:
        merkle.blocks(numbered_).write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(f"{d}/blocks")
        size = sum(os.path.getsize(f) for f in glob.glob(f"{d}/blocks/*.parquet"))
    assert size < 250 * len(rows)
