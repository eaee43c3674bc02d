"""Near-duplicate join on 5-word shingles by a token-group matrix.

Documents with equal shingle sets are one class, and only classes are compared.

1. Screening: a class with a partner of similarity 0.8 shares at least a known
   number of its first shingles in hash order with other classes. Classes that
   don't are done. Shingles met twice in a batch are collapsed where they are read,
   so a frequent one crosses the network once a batch.
2. Of the rest the whole sets are taken. Shingles of one class only can't be in
   an overlap: they bound it, and most remaining classes fall away. The others are
   put in the order of their frequency, and the first of them, the prefix, must hold
   one shingle of any partner.
3. Stars: where classes meet at a shingle of their prefixes, in a band of set sizes,
   one leads and the others are compared with it. That joins most of a large group of
   copies, with one comparison each.
4. Groups: the classes that still meet one of another component are partitioned
   into groups of bounded size, by component, else by the shingle where most meet.
   The union of a group's prefix tokens is stored, and two groups whose unions share
   none, or whose sizes can't match, are never opened.
5. Token-group matrix: of two groups that qualify, the overlap of each class with the
   other group's whole token union bounds its overlap with every member. Classes that
   pass open the group: their overlaps with all its members are one matrix product.
   Of the links found, those that join components are kept.

Nothing is emitted per pair of classes but what is compared with a leader. Pairs
inside one component need not be enumerated; no link between components is lost.
Shingles are 64-bit hashes.

Results in special cases: null or empty texts have no shingles and are linked
with nothing; a text of fewer than 5 words has its whole word sequence as one
shingle; a very long text is one set like others (a group's size is bounded by its
tokens, so it may be a group alone); repeated rows yield a row each and are linked;
a null doc_id is linked like others, connects what it is similar to, and takes the
smallest id of its component (null if there is none); equal smallest ids are one; an
empty table gives no rows; further columns are ignored, or kept by
near_deduplicated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batches_of, fresh, small_side, text_of, written
from .components import components
from .shingles import SHINGLE, distinct, mixed, sequences

PERCENT = 80
#: A group has about so many classes at most, and about so many tokens unless it is one class.
GROUP_ROWS, GROUP_TOKENS = 128, 60_000


def _set_of(shingles: np.ndarray) -> tuple[np.ndarray, int]:
    """The distinct shingles, ascending, and the class key of the set."""
    s = distinct(shingles)
    if not len(s):
        return s, 0
    key = mixed(np.array([np.add.reduce(mixed(s ^ np.uint64(0x5BD1E995))) ^ np.uint64(len(s))], np.uint64))
    return s, int(key.view(np.int64)[0])


def classes(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, n, k): the number of distinct shingles and the class of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_set_of(s) for _, s in sequences(b.column(1), size)]
            cols = [b.column(0), b.column(2), pa.array([len(s) for s, _ in got], pa.int64()), pa.array([k for _, k in got], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_hash", "n", "k"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.xxhash64(text_of()).alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n long, k long")


def _misses(n: int, percent: int) -> int:
    """The shingles of a set of n that a partner may lack."""
    return n - -(-percent * n // 100)


def _screen_size(n: int, percent: int) -> tuple[int, int]:
    """How many of the first shingles are looked at, and how many of them a partner must share."""
    extra = max(1, n // 20)
    length = min(n, _misses(n, percent) + extra)
    return length, length - _misses(n, percent)


def _collapsed(parts: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Of a batch of (class, shingles): rows (t, k, known).

    A shingle of one class in this batch: (t, k, null). A shingle of several: one
    row (t, null, null), and per class (null, k, its shingles of that kind).
    """
    if not parts:
        return
    t = np.concatenate([p[1] for p in parts])
    k = np.repeat(np.array([p[0] for p in parts], np.int64), [len(p[1]) for p in parts])
    order = np.lexsort((k, t))
    t, k = t[order], k[order]
    first = np.ones(len(t), bool)
    first[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])  # equal sets once
    t, k = t[first], k[first]
    start = np.ones(len(t), bool)
    start[1:] = t[1:] != t[:-1]
    at = np.flatnonzero(start)
    size = np.diff(np.append(at, len(t)))
    several = np.repeat(size > 1, size)
    ts, ks = t[several], k[several]
    o = np.argsort(ks, kind="stable")
    ts, ks = ts[o].view(np.int64), ks[o]
    cut = np.flatnonzero(np.append(True, ks[1:] != ks[:-1])) if len(ks) else np.zeros(0, np.int64)
    single, common = t[~several].view(np.int64), t[at[size > 1]].view(np.int64)
    n1, n2, n3 = len(single), len(common), len(cut)
    tt = pa.array(np.concatenate([single, common, np.zeros(n3, np.int64)]), mask=np.arange(n1 + n2 + n3) >= n1 + n2)
    kk = pa.array(np.concatenate([k[~several], np.zeros(n2, np.int64), ks[cut]]), mask=(np.arange(n1 + n2 + n3) >= n1) & (np.arange(n1 + n2 + n3) < n1 + n2))
    offsets = np.concatenate([np.zeros(n1 + n2, np.int32), cut.astype(np.int32), [len(ks)]]).astype(np.int32)
    known = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ts, pa.int64()))
    for i in range(0, len(tt), 100_000):
        yield pa.RecordBatch.from_arrays([x.slice(i, 100_000) for x in (tt, kk, known)], ["t", "k", "known"])


def _common() -> Column:
    """Whether a row of _collapsed stands for shingles of several classes. At most a row a batch has the same shingle."""
    by = Window.partitionBy("t", F.when(F.col("t").isNull(), F.col("k")))
    return F.col("t").isNull() | (F.min("k").over(by) < F.max("k").over(by)) | (F.count(F.lit(1)).over(by) > F.count("k").over(by))


def _shared(rows: DataFrame) -> DataFrame:
    """From the rows of _collapsed: (k, known), the shingles of k that other classes have too.

    One shuffle by shingle; of each shingle a batch sends one row.
    """
    return rows.withColumn("_c", _common()).where("_c and k is not null").select("k", F.when(F.col("t").isNull(), F.col("known")).otherwise(F.array("t")).alias("known"))


def candidates(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(k) of the classes that may have a partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for s, k in (_set_of(s) for _, s in sequences(b.column(0), size)):
                if len(s):
                    parts.append((k, s[: _screen_size(len(s), percent)[0]], len(s)))
            need = {k: _screen_size(n, percent)[1] for k, _, n in parts}
            for out in _collapsed([p[:2] for p in parts]):
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array([need.get(x) for x in out.column(1).to_pylist()], pa.int32())], ["t", "k", "known", "need"])

    rows = docs.select(text_of().alias("text")).mapInArrow(run, "t long, k long, known array<long>, need int")
    hits = rows.withColumn("_c", _common()).where("_c and k is not null").select("k", "need", F.when(F.col("t").isNull(), F.size("known")).otherwise(1).alias("hits"))
    return hits.groupBy("k").agg(F.sum("hits").alias("hits"), F.max("need").alias("need")).where("hits >= need").select("k")


def whole_sets(docs: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    """(k, known...) rows of _collapsed for the whole sets of the documents in reps (rep: a doc_id, or null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_set_of(s) for _, s in sequences(b.column(0), size)]
            yield from _collapsed([(k, s) for s, k in got if len(s)])

    own = docs.select(F.col("doc_id").cast("long").alias("id"), text_of().alias("text"))
    return own.join(reps, F.col("id").eqNullSafe(F.col("rep")), "left_semi").select("text").mapInArrow(run, "t long, k long, known array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets have at least that similarity."""
    left = sets.select(F.col("k").alias("a"), F.col("n").alias("na"), F.col("tok").alias("ta"))
    right = sets.select(F.col("k").alias("b"), F.col("n").alias("nb"), F.col("tok").alias("tb"))
    both = pairs.join(left, "a").join(right, "b")
    inter = F.size(F.array_intersect("ta", "tb"))
    return both.where(100 * inter >= percent * (F.col("na") + F.col("nb") - inter)).select("a", "b")


def _may(na: str, nb: str, sa: str, sb: str, percent: int) -> str:
    """Bounds of a pair: sizes, and shingles that any other class has."""
    return f"100 * least({na}, {nb}) >= {percent} * greatest({na}, {nb}) and {100 + percent} * least({sa}, {sb}) >= {percent} * ({na} + {nb})"


def _buckets(prefix: DataFrame, percent: int) -> DataFrame:
    """(t, band, own, k, n, s, lead): the rows of each shingle and size band where several meet, with their leader.

    Sets that can be linked differ in size by at most 100 / percent; bands are a
    little wider, and each set is in its own and the next.
    """
    rows = prefix.withColumn("own", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(101.0 / percent)))).withColumn("band", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    lead = rows.groupBy("t", "band").agg(F.max(F.struct((F.col("s") / F.col("n")).alias("share"), "n", "s", "k")).alias("lead"), F.count(F.lit(1)).alias("m")).where("m > 1")
    met = rows.join(lead.select("t", "band", "m", F.col("lead.k").alias("lead"), F.col("lead.n").alias("nb"), F.col("lead.s").alias("sb")), ["t", "band"])
    # Where two meet, only their own link counts.
    return met.where(f"m > 2 or k = lead or ({_may('n', 'nb', 's', 'sb', percent)})").select("t", "band", "own", "k", "n", "s", "lead")


def links(docs: DataFrame, table: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) of classes that connect all that are connected by similarity. table: written classes()."""
    found = candidates(docs, size, percent)
    reps = table.where("n > 0").groupBy("k").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))
    reps = written(reps.join(found, "k", "left_semi"), "reps")
    shared = _shared(whole_sets(docs, small_side(reps.select("rep").distinct()), size))
    common = shared.groupBy("k").agg(F.array_distinct(F.flatten(F.collect_list("known"))).alias("tok"))
    common = common.join(reps.select("k", "n"), "k").where(100 * F.size("tok") >= percent * F.col("n"))
    sets = by_frequency(written(common, "common"), percent)
    prefix = written(prefixes(sets, percent), "prefix")

    buckets = _buckets(prefix, percent)
    stars = written(_verified(buckets.where("k <> lead").select(F.col("k").alias("a"), F.col("lead").alias("b")).distinct(), sets, percent), "stars")
    joined = components(stars).select(F.col("id").alias("k"), F.col("component").alias("g"))
    opened = group_links(sets, prefix, joined, percent)
    with batches_of(docs.sparkSession, 16):
        opened = written(opened, "links")
    return stars.unionByName(opened)


def by_frequency(common: DataFrame, percent: int) -> DataFrame:
    """(k, n, s, tok): the shingles that several of these classes have, rarest first; classes with too few are left out."""
    tokens = common.select("k", "n", F.explode("tok").alias("t"))
    # Written, so that both sides of the join are plain shuffles and AQE can split a frequent shingle.
    df = written(tokens.groupBy("t").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "df")
    ranked = tokens.join(df, "t").groupBy("k", "n").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("r"))
    sets = ranked.select("k", "n", F.size("r").cast("long").alias("s"), F.transform("r", lambda x: x["t"]).alias("tok"))
    return written(sets.where(f"100 * s >= {percent} * n"), "sets")


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(k, n, s, t): the rarest shingles of each class, of which any two linked classes have one in common."""
    misses = F.expr(f"n - cast(ceil({percent} * n / 100) as long)")
    # The shingles that no one else has come first, and they can't meet.
    return sets.select("k", "n", "s", F.explode(F.slice("tok", 1, (misses + 1 - (F.col("n") - F.col("s"))).cast("int"))).alias("t"))


def group_links(sets: DataFrame, prefix: DataFrame, joined: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect the components of joined (k, g) wherever classes of two of them are linked."""
    at = written(prefix.join(joined, "k", "left").withColumn("g", F.coalesce("g", "k")), "at")
    # Shingles at which components meet.
    meet = written(at.groupBy("t").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo < hi").select("t", "m"), "meet")
    at = written(at.join(meet, "t"), "open")
    own = at.groupBy("k").agg(F.first("g").alias("g"), F.first("s").alias("s"), F.max(F.struct("m", "t"))["t"].alias("t"))
    large = own.groupBy("g").count().where("count > 1").select("g", F.lit(True).alias("large"))
    own = own.join(large, "g", "left").withColumn("home", F.when(F.col("large"), F.xxhash64(F.lit("g"), "g")).otherwise(F.xxhash64(F.lit("t"), "t")))
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / GROUP_ROWS), F.ceil(F.sum("s") / GROUP_TOKENS)).cast("long")
    parts = written(own.groupBy("home").agg(parts.alias("parts")), "homes")
    group = F.when(F.col("parts") > 1, F.xxhash64("home", F.pmod(F.xxhash64("k"), F.col("parts")))).otherwise(F.col("home"))
    own = written(own.join(parts, "home").select("k", "g", group.alias("p")), "groups")

    unions = at.select("t", "k", "n").join(own, "k").groupBy("t", "p").agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("g").alias("g0"), F.max("g").alias("g1"))
    unions = written(unions, "unions")
    other = unions.select("t", *[F.col(c).alias(f"o{c}") for c in ("p", "n0", "n1", "g0", "g1")])
    several = F.least("g0", "og0") < F.greatest("g1", "og1")
    sizes = f"100 * n1 >= {percent} * on0 and 100 * on1 >= {percent} * n0"
    pairs = written(unions.join(other, "t").where("p <= op").where(sizes).where(several).select("p", "op").distinct(), "qualifying")

    member = own.join(sets.select("k", "n", "tok"), "k").groupBy("p").agg(F.collect_list(F.struct("k", "g", "n", "tok")).alias("m"))
    of = lambda c: F.transform("m", lambda x: x[c])
    member = written(member.select("p", of("k").alias("k"), of("g").alias("g"), of("n").alias("n"), F.transform("m", lambda x: F.size(x["tok"])).alias("s"), F.flatten(of("tok")).alias("tok")), "matrix")
    cols = ("k", "g", "n", "s", "tok")
    both = pairs.join(member, "p").join(member.select(F.col("p").alias("op"), *[F.col(c).alias(f"o{c}") for c in cols]), "op")
    return both.select((F.col("p") == F.col("op")).alias("same"), *cols, *[f"o{c}" for c in cols]).mapInArrow(_opened(percent), "a long, b long").distinct()


def overlaps(tok: np.ndarray, sizes: np.ndarray, other: np.ndarray, other_sizes: np.ndarray, least: np.ndarray, other_least: np.ndarray, columns: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two groups (tokens row after row, and their number by row): the rows i and j that may reach their least
    overlap with the other's token union, and their overlaps as a matrix."""
    union = np.intersect1d(tok, other)
    row, at = [], []
    for t, n in ((tok, sizes), (other, other_sizes)):
        c = np.minimum(np.searchsorted(union, t), max(len(union) - 1, 0))
        ok = union[c] == t if len(union) else np.zeros(len(t), bool)
        row.append(np.repeat(np.arange(len(n)), n)[ok])
        at.append(c[ok])
    keep = [np.flatnonzero(np.bincount(r, minlength=len(n)) >= m) for r, n, m in zip(row, (sizes, other_sizes), (least, other_least), strict=True)]
    inter = np.zeros((len(keep[0]), len(keep[1])), np.float32)
    if inter.size:
        for c0 in range(0, len(union), columns):
            sides = []
            for r, c, k, n in zip(row, at, keep, (sizes, other_sizes), strict=True):
                new = np.full(len(n), -1)
                new[k] = np.arange(len(k))
                here = (c >= c0) & (c < c0 + columns) & (new[r] >= 0)
                m = np.zeros((len(k), min(columns, len(union) - c0)), np.float32)
                m[new[r[here]], c[here] - c0] = 1
                sides.append(m)
            inter += sides[0] @ sides[1].T
    return keep[0], keep[1], inter


def _opened(percent: int):
    """Opens pairs of groups; of the links between components, a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int]] = []
            for i in range(b.num_rows):
                same, *cols = (c[i] for c in b.columns)
                k, g, n, s, tok, ok, og, on, os_, otok = (c.values.to_numpy(zero_copy_only=False) for c in cols)
                x, y, inter = overlaps(tok, s, otok, os_, -(-percent * n // 100), -(-percent * on // 100))
                linked = 100 * inter >= percent * (n[x][:, None] + on[y][None, :] - inter) - 1e-3
                linked &= g[x][:, None] != og[y][None, :]
                if same.as_py():
                    linked = np.triu(linked, 1)
                root: dict[int, int] = {}

                def find(v: int, root=root) -> int:
                    while root.setdefault(v, v) != v:
                        root[v] = root[root[v]]
                        v = root[v]
                    return v

                for p, q in np.argwhere(linked).tolist():
                    u, v = find(int(g[x[p]])), find(int(og[y[q]]))
                    if u != v:
                        root[u] = v
                        out.append((int(k[x[p]]), int(ok[y[q]])))
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], pa.int64()) for j in (0, 1)], ["a", "b"])

    return run


def components_of(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id for each row: the smallest doc_id reachable by links."""
    table = written(classes(docs, size), "classes")
    label = components(links(docs, table, size, percent))
    reps = table.where("n > 0").groupBy("k").agg(F.min("doc_id").alias("rep"))
    named = reps.join(label, F.col("k") == F.col("id"), "left").select("k", "rep", F.coalesce("component", "k").alias("c"))
    least = named.groupBy("c").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    named = named.join(least, "c", "left").select(F.col("k").alias("_k"), F.coalesce("component_id", "rep").alias("c"))
    full = table.join(named, F.when(F.col("n") > 0, F.col("k")) == F.col("_k"), "left")
    own = F.when(F.col("n") > 0, F.col("c")).otherwise(F.col("doc_id"))
    return full.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), own.alias("component_id"))


def ngram_join(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row: the smallest doc_id reachable by links."""
    return components_of(docs, size, percent).drop("text_hash")


def near_deduplicated(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each group of linked documents, with all columns: that with the smallest doc_id.

    A row goes by its doc_id and its text: other texts under the same id, null ids too, are not touched.
    """
    id_, hash_ = fresh(docs, "gone", "text")
    gone = components_of(docs, size, percent).where("n_shingles > 0 and not (doc_id <=> component_id)")
    gone = written(gone.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).distinct(), "gone")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(text_of()) == F.col(hash_))
    return docs.join(small_side(gone), same, "left_anti")
