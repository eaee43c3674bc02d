r"""Chat formatting by event-sourced reconstruction.

A log holds events of conversations: messages, streamed deltas, edits and
regenerations. The log is partitioned by conversation and sorted by sequence;
each turn's events fold into its final text, regenerations also drop the later
turns that they outdate, and the final messages are rendered with a template.

Template: `<|role|>`, newline, text, `</s>`, newline for each turn. Control
strings inside texts and roles are escaped reversibly with a backslash after
their first character, and `|>` inside roles likewise; a backslash itself is doubled. The loss mask is a list of
spans (start, length in code points) over the assistant texts.

Results in special cases: null text or role counts as empty; rows with equal
(conv_id, turn) are turns of their own, in the order of role and text; events
with equal sequence numbers are applied in the order kind, text; a null conv_id
is a conversation like others; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: The control strings of common chat templates, as one pattern.
_CONTROL = r"([<\[])(?=\||/?s>|<SYS>>|</SYS>>|/?INST\])"
DELTA_CHARS = 512


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def events_of(conversations: DataFrame, delta_chars: int = DELTA_CHARS) -> DataFrame:
    """The event log of a table of turns: assistant turns as streamed deltas, others as messages.

    (conv_id, seq, turn, kind, role, text); turn counts from 0 in the order of the rows.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("turn", (F.row_number().over(order) - 1).cast("long"))
    deltas = F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{delta_chars}}}"), F.lit(0))
    parts = F.when((F.col("role") == "assistant") & (F.size(deltas) > 0), deltas).otherwise(F.array("text"))
    kind = F.when(F.col("role") == "assistant", "delta").otherwise("message")
    return rows.select("conv_id", "turn", "role", kind.alias("kind"), F.posexplode(parts).alias("part", "text")).select("conv_id", F.struct("turn", "part").alias("seq"), "turn", "kind", "role", "text")


def folded(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text).

    message and edit set a turn's text, delta appends to it, regenerate empties it
    and drops all that earlier events put into later turns.
    """
    conv = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    redone = F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(conv)
    live = events.withColumn("_cut", redone).where("_cut is null or seq > _cut")
    turn = live.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("e"))
    last = F.coalesce(F.array_max(F.transform("e", lambda x, i: F.when(x["kind"] != "delta", i))), F.lit(-1))
    tail = F.slice("e", F.greatest(last, F.lit(0)) + 1, F.size("e"))
    text = F.array_join(F.transform(tail, lambda x: F.when(x["kind"] == "regenerate", F.lit("")).otherwise(F.coalesce(x["text"], F.lit("")))), "")
    return turn.select("conv_id", "turn", F.coalesce(F.element_at("e", 1)["role"], F.lit("")).alias("role"), text.alias("text"))


def rendered(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): one row per conversation; loss is an array of (start, length)."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    m = messages.select("conv_id", "turn", "role", F.concat(F.lit("<|"), F.replace(escaped(F.col("role")), F.lit("|>"), F.lit("|\\>")), F.lit("|>\n")).alias("head"), escaped(F.col("text")).alias("body"))
    m = m.withColumn("piece", F.concat("head", "body", F.lit("</s>\n")))
    at = F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head")
    m = m.withColumn("span", F.when(F.col("role") == "assistant", F.struct(at.cast("long").alias("start"), F.length("body").cast("long").alias("length"))))
    g = m.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "piece", "span"))).alias("p"))
    spans = F.filter(F.transform("p", lambda x: x["span"]), lambda x: x.isNotNull())
    return g.select("conv_id", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """Conversations by turn → (conv_id, formatted, loss)."""
    return rendered(folded(events_of(conversations)))


def parsed(formatted: DataFrame) -> DataFrame:
    """Back from (conv_id, formatted, loss): adds turns (array of role, text) and loss_text, both unescaped."""
    pieces = F.filter(F.split("formatted", "</s>\n", -1), lambda x: x != "")
    role = lambda x: unescaped(F.regexp_extract(x, r"(?s)^<\|(.*?)\|>\n", 1))
    body = lambda x: unescaped(F.regexp_extract(x, r"(?s)^<\|.*?\|>\n(.*)$", 1))
    turns = F.transform(pieces, lambda x: F.struct(role(x).alias("role"), body(x).alias("text")))
    masked = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.withColumns({"turns": turns, "loss_text": F.array_join(masked, "")})


def chat_digest(conversations: DataFrame) -> DataFrame:
    """Formats, writes the result as Parquet in the shared folder, reads it back and digests it."""
    back = parsed(written(format_chats(conversations), "chats"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
