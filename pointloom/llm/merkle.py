"""Merkle manifest of a dataset by butterfly exchange (native).

Each row is a leaf, the leaves of a group (lang) ascend by doc_id, and FANOUT consecutive
nodes become one until one is left, the group's subroot; subroots become the root likewise.

1. Leaves are numbered within their group by ranges of the sort key, so no group is held
   by one task. A partition of the exchange is an aligned block of FANOUT ** local leaves:
   it hashes its own subtree, and again in the end, when its leaves get their way up.
2. Butterfly: in round r, the FANOUT neighbouring subtrees of height r swap their roots.
   Partitions with the same lane (their number modulo FANOUT ** r) meet, one of each
   subtree; each of them learns its siblings and hashes their parent itself. So after
   log(partitions) rounds every partition has the root and its proof's upper part, and
   nothing is sent down. Where the last subtree has fewer partitions than lanes, these
   serve the other lanes too.
3. The groups' subroots swap in the same way, a row a group, and blocks look up the row of
   their group.

A group of partitions that meets has FANOUT rows at most; each round is one shuffle of a
row a partition. Texts are read once and don't move.

Results in special cases: a null in any column is the field `-`, unlike an empty text; null
groups are one group, the first; null doc_ids come first; rows with one doc_id in one group
are ordered by their leaves, and repeated rows are leaves of their own; a very long text is
hashed whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, small_side, written
from .numbering import numbered

#: Nodes that become one, and levels that a partition hashes by itself (8 ** 2 leaves a partition, about 10 KB).
FANOUT, LOCAL = 8, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A step up: what stands left and right of the node in its run.
_STEP = "array<struct<l:string,r:string>>"


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon, and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_of(**values: Column) -> Column:
    return F.sha2(F.concat(*[field(values[c]) for c in FIELDS]), 256)


def leaves(docs: DataFrame, tampered: Column | None = None, text: Column | None = None) -> DataFrame:
    """(doc_id, grp, leaf, other): other is the leaf of the row with that text instead where tampered, else the leaf."""
    own = {c: F.col(c) for c in FIELDS}
    leaf = leaf_of(**own)
    other = leaf if tampered is None else F.when(tampered, leaf_of(**own | {"text": text})).otherwise(leaf)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("grp"), leaf.alias("leaf"), other.alias("other"))


def _parents(nodes: Column) -> Column:
    """The level above an array of nodes."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT)), lambda i: F.sha2(F.array_join(F.slice(nodes, i * FANOUT + 1, FANOUT), ""), 256))


def _beside(nodes: Column, at: Column) -> Column:
    """What stands left and right of the node at that place (from 0) in its run."""
    first = F.floor(at / FANOUT).cast("int") * FANOUT
    left = F.array_join(F.slice(nodes, first + 1, at - first), "")
    right = F.array_join(F.slice(nodes, at + 2, first + FANOUT - 1 - at), "")
    return F.struct(left.alias("l"), right.alias("r"))


def _with_levels(own: DataFrame, local: int) -> DataFrame:
    """own (n, m) with the levels above the leaves in m as level0, level1, ...; those that the group doesn't have are null."""
    own = own.withColumn("level0", F.transform("m", lambda x: x["leaf"]))
    for k in range(local):  # several nodes of the group on this level
        own = own.withColumn(f"level{k + 1}", F.when(F.col("n") > FANOUT**k, _parents(F.col(f"level{k}"))))
    return own


def blocks(rows: DataFrame, local: int = LOCAL) -> DataFrame:
    """(grp, b, parts, n, node, m): each aligned block of leaves with its subtree's root; m holds its leaves, and what they become if that is another.

    rows: grp, doc_id, leaf, other, i (number within the group), n (leaves of the group).
    """
    size = FANOUT**local
    b = F.floor(F.col("i") / size)
    leaf = F.struct("i", "doc_id", "leaf", F.when(F.col("other") != F.col("leaf"), F.col("other")).alias("other"))
    own = rows.groupBy("grp", b.alias("b")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(leaf)).alias("m"))
    own = _with_levels(own, local)
    node = F.coalesce(*[F.col(f"level{k}")[0] for k in range(local, -1, -1)])
    m = F.transform("m", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["leaf"].alias("leaf"), x["other"].alias("other")))
    return own.select("grp", "b", F.ceil(F.col("n") / size).alias("parts"), "n", node.alias("node"), m.alias("m"))


def _leaves_of(own: DataFrame, local: int, *columns: str) -> DataFrame:
    """(doc_id, leaf, other, up, *columns) of each leaf of blocks (n, m, *columns), with its steps up within the block.

    The steps are some hundred bytes a leaf and level, so they are made here, row by row, and never lie in a block.
    """
    levels = [f"level{k}" for k in range(local)]
    rows = _with_levels(own, local).select(*columns, "n", *levels, F.posexplode("m").alias("j", "x"))
    steps = [F.when(F.col("n") > FANOUT**k, F.array(_beside(F.col(x), F.floor(F.col("j") / FANOUT**k).cast("int")))).otherwise(F.array().cast(_STEP)) for k, x in enumerate(levels)]
    return rows.select("x.doc_id", "x.leaf", F.coalesce("x.other", "x.leaf").alias("other"), F.concat(F.array().cast(_STEP), *steps).alias("up"), *columns)


def butterfly(nodes: DataFrame, rounds: int) -> DataFrame:
    """(grp, b, root, up) of partitions (grp, b, parts, node): parts is their number in the group, b runs from 0.

    After rounds exchanges (enough if FANOUT ** rounds >= parts) each partition has its group's root and the steps up.
    """
    at = nodes.select("grp", "b", "parts", "node", F.array().cast(_STEP).alias("up"))
    for r in range(rounds):
        width = F.lit(FANOUT**r).cast("long")  # partitions below a node of this round
        block, last = F.floor(F.col("b") / width), F.floor((F.col("parts") - 1) / width)
        there = F.col("parts") - last * width  # of them in the last node
        lane = F.col("b") % width
        # A partition of the last node also serves the lanes that this node has no partition for.
        lanes = F.when((block == last) & (there < width) & (lane + there < width), F.sequence(lane, width - 1, there)).otherwise(F.array(lane))
        sent = at.select("grp", "b", "parts", "node", "up", block.alias("block"), lane.alias("own"), F.explode(lanes).alias("lane"))
        sent = sent.withColumn("up", F.when(F.col("own") == F.col("lane"), F.col("up")))  # null: serves only
        met = sent.groupBy("grp", F.floor(F.col("block") / FANOUT).alias("g"), "lane").agg(F.max("parts").alias("parts"), F.sort_array(F.collect_list(F.struct("block", "node", "b", "up"))).alias("m"))
        met = met.withColumn("nodes", F.transform("m", lambda x: x["node"])).where(F.exists("m", lambda x: x["up"].isNotNull()))
        parent = F.when(F.col("parts") > width, F.sha2(F.array_join("nodes", ""), 256)).otherwise(F.col("nodes")[0])
        met = met.withColumn("parent", parent).select("grp", "parts", "nodes", "parent", F.posexplode("m").alias("j", "x")).where("x.up is not null")
        step = F.when(F.col("parts") > width, F.array(_beside(F.col("nodes"), F.col("j")))).otherwise(F.array().cast(_STEP))
        at = met.select("grp", F.col("x.b").alias("b"), "parts", F.col("parent").alias("node"), F.concat(F.col("x.up"), step).alias("up"))
    return at.select("grp", "b", F.col("node").alias("root"), "up")


def _rounds(parts: int, local: int = 0) -> int:
    k = 0
    while FANOUT ** (k + local) < parts:
        k += 1
    return k


def folded(leaf: Column, up: Column) -> Column:
    """The root that a leaf and its steps up give."""
    return F.aggregate(up, leaf, lambda acc, s: F.sha2(F.concat(s["l"], acc, s["r"]), 256))


def siblings(up: Column) -> Column:
    """All siblings, level by level, left to right."""
    return F.array_join(F.transform(up, lambda s: F.concat(s["l"], s["r"])), "")


def manifest(docs: DataFrame, tampered: Column | None = None, text: Column | None = None, local: int = LOCAL) -> DataFrame:
    """(doc_id, leaf, other, subroot, root, up): each leaf with its steps up to the root."""
    rows = numbered(written(leaves(docs, tampered, text), "leaves"), ["grp"], ["doc_id", "leaf", "other"])
    parts = written(blocks(rows, local), "blocks", wide=True)
    most = parts.agg(F.max("parts")).first()[0]
    if most is None:
        return rows.select("doc_id", "leaf", "other", F.lit("").alias("subroot"), F.lit("").alias("root"), F.array().cast(_STEP).alias("up"))
    up = written(butterfly(parts, _rounds(most)).withColumnsRenamed({"root": "subroot", "up": "up1"}), "butterfly")
    # The groups, in order, are the partitions of the last exchange.
    groups = written(numbered(up.where("b = 0").select("grp", "subroot"), [], ["grp"], "b", "parts"), "groups")
    tops = groups.select(F.lit(0).alias("grp"), "b", "parts", F.col("subroot").alias("node"))
    tops = butterfly(tops, _rounds(groups.count())).select("b", "root", F.col("up").alias("up2"))
    tops = written(groups.select("grp", "b").join(tops, "b").select(F.col("grp").alias("grp2"), "root", "up2"), "roots")
    up = up.join(small_side(tops), F.col("grp").eqNullSafe(F.col("grp2"))).select(F.col("grp").alias("grp1"), F.col("b").alias("b1"), "subroot", "root", F.concat("up1", "up2").alias("top"))
    # A row a block on both sides.
    both = parts.join(up, F.col("grp").eqNullSafe(F.col("grp1")) & (F.col("b") == F.col("b1")))
    return _leaves_of(both, local, "subroot", "root", "top").select("doc_id", "leaf", "other", "subroot", "root", F.concat("up", "top").alias("up"))


def merkle_digest(docs: DataFrame, local: int = LOCAL) -> DataFrame:
    """Each document's leaf, the roots, the digest of its proof, and whether it verifies after the tampering.

    Tampering lower-cases A-Z of the text where 3 divides the crc32 of doc_id as text; a null doc_id is left alone.
    """
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    out = manifest(docs, tampered, ascii_lower(F.col("text").cast("string")), local)
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("up")), 256).alias("proof_sha256"), folded(F.col("other"), F.col("up")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
