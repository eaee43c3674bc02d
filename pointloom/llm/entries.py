"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import chat_digest

    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return chat_digest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))


def tokenizer_json(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_output import token_digest

    return token_digest(table(spark, sf_dir, "documents"), tokenizer_json())


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import overlaps

    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed

    return packed(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import merkle_digest

    return merkle_digest(table(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import warc_digest

    return warc_digest(table(spark, sf_dir, "pages"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whitened

    return whitened(table(spark, sf_dir, "embeddings"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""
with t as (select doc_id, {_LOWER.format("coalesce(text, '')")} as norm from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, sha256(norm) as text_sha256
from t window w as (partition by norm)
"""

OP5_SQL = f"""
with split as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
lines as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as pos from split),
keyed as (select doc_id, pos, line, {_LOWER.format("trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')")} as k from lines),
counted as (select k, min(doc_id) as first_id from keyed where length(k) >= 10 group by k having min(doc_id) < max(doc_id)),
marked as (select d.doc_id, d.pos, d.line, coalesce(d.doc_id > c.first_id, false) as gone
           from keyed d left join counted c on d.k = c.k)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""

OP8_SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
           union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, replace(text, '\', '\\') as doubled from c),
m as (select *, length(role) + 10 + length(regexp_replace(doubled,
             '(<\||</s>|<s>|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\])', '\1#', 'g')) as turn_len from e)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(turn_len)::bigint as formatted_chars
from m group by conv_id
"""


OP3_SQL = f"""
with recursive words as (
  select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') as w from documents),
shingles as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) as s from words),
sized as (select doc_id, len(s) as n, list_sort(s) as s from shingles),
class as (select min(doc_id) as c, n, s from sized where n > 0 group by n, s),
tokens as (select c, n, unnest(s) as t from class),
pairs as (select a.c as x, b.c as y, a.n + b.n as total, count(*) as i from tokens a join tokens b on a.t = b.t and a.c < b.c
          and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by 1, 2, 3),
links as (select x, y from pairs where 100 * i >= 80 * (total - i)),
edges as (select x as a, y as b from links union all select y, x from links),
reach(a, b) as (select c, c from class union select r.a, e.b from reach r join edges e on r.b = e.a),
label as (select a, min(b) as component_id from reach group by a)
select d.doc_id, d.n as n_shingles, coalesce(l.component_id, d.doc_id) as component_id
from sized d left join class k on d.n = k.n and d.s = k.s left join label l on k.c = l.a
"""

def _field(name: str) -> str:
    return f"coalesce(strlen({name}::varchar)::varchar || ':' || {name}::varchar, '-')"


_UP = "list_transform(range(0, (len({0}) + 7) // 8), lambda i: sha256(array_to_string({0}[i * 8 + 1:i * 8 + 8], '')))"
#: crc32 by its definition, as DuckDB has none: of up to 20 digits, each of 8 bits.
_CRC = "list_reduce(list_transform(string_split({0}, ''), lambda c: ascii(c)::bigint), lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(0, 8)), lambda v, k: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end), 4294967295::bigint)"

OP11_SQL = f"""
with recursive langs as (select lang, row_number() over (order by lang nulls first) - 1 as g from (select distinct lang from documents)),
docs as (select d.doc_id, l.g, d.text, {" || ".join(_field(f"d.{c}") for c in ("doc_id", "source", "lang", "n_chars"))} as head,
  xor({_CRC.format("d.doc_id::varchar")}, 4294967295) % 3 = 0 as tampered from documents d join langs l on d.lang is not distinct from l.lang),
leaves as (select *, sha256(head || {_field("text")}) as leaf,
  sha256(head || case when tampered then {_field("(" + _LOWER.format("text") + ")")} else {_field("text")} end) as other from docs),
tree(g, h, nodes) as (select g, 0, list(leaf order by doc_id) from leaves group by g
  union all select g, h + 1, {_UP.format("nodes")} from tree where len(nodes) > 1),
subroots as (select g, nodes[1] as subroot from tree where len(nodes) = 1),
top(h, nodes) as (select 0, list(subroot order by g) from subroots
  union all select h + 1, {_UP.format("nodes")} from top where len(nodes) > 1),
placed as (select *, row_number() over (partition by g order by doc_id) - 1 as i from leaves),
fold(doc_id, g, i, h, node, proof) as (select doc_id, g, i, 0, other, '' from placed
  union all select f.doc_id, f.g, f.i // 8, f.h + 1,
    sha256(array_to_string(t.nodes[f.i // 8 * 8 + 1:f.i], '') || f.node || array_to_string(t.nodes[f.i + 2:f.i // 8 * 8 + 8], '')),
    f.proof || array_to_string(t.nodes[f.i // 8 * 8 + 1:f.i], '') || array_to_string(t.nodes[f.i + 2:f.i // 8 * 8 + 8], '')
  from fold f join tree t on t.g = f.g and t.h = f.h and len(t.nodes) > 1),
up(doc_id, i, h, node, proof) as (select doc_id, g, 0, node, proof from fold f where h = (select max(t.h) from tree t where t.g = f.g)
  union all select f.doc_id, f.i // 8, f.h + 1,
    sha256(array_to_string(t.nodes[f.i // 8 * 8 + 1:f.i], '') || f.node || array_to_string(t.nodes[f.i + 2:f.i // 8 * 8 + 8], '')),
    f.proof || array_to_string(t.nodes[f.i // 8 * 8 + 1:f.i], '') || array_to_string(t.nodes[f.i + 2:f.i // 8 * 8 + 8], '')
  from up f join top t on t.h = f.h and len(t.nodes) > 1),
root as (select nodes[1] as root from top where len(nodes) = 1)
select p.doc_id, p.leaf, s.subroot, r.root, sha256(u.proof) as proof_sha256, u.node as folded_root, u.node = r.root as verified
from placed p join subroots s using (g) cross join root r join up u on u.doc_id = p.doc_id and u.h = (select max(h) from top)
"""

OP12_SQL = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages),
d as (select page_id, html, strlen(html) as payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, i // 4 * 5 + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int, 1)), '') as payload_digest from p),
m as (select *, max(page_id) over (partition by html) as last from d)
select page_id, payload_bytes, payload_digest, case when page_id = last then 'response' else 'revisit' end as record_type,
       case when page_id <> last then last end as refers_to from m
"""


def queries() -> dict:
    found = (
        op1_exact_dedup, op2_decontaminate, op3_ngram_join, op4_packing, op5_line_dedup, op6_toxicity, op7_quality, op8_chat_formatting, op9_token_output, op10_substring_dedup,
        op11_merkle_manifest, op12_warc, op13_whitening,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op3_ngram_join": OP3_SQL, "op5_line_dedup": OP5_SQL, "op8_chat_formatting": OP8_SQL, "op11_merkle_manifest": OP11_SQL, "op12_warc": OP12_SQL}
