"""Chat formatting from an event log, with DataFrame operations only.

A log holds events of conversations: ``message`` starts a message with a role and a text, ``delta`` appends to
it, ``edit`` replaces its text, ``regenerate`` clears it and takes back every message begun after it. Events are
gathered per message, sorted by sequence, and folded to the text after the last start, edit or regeneration;
the messages of a conversation, sorted, are rendered to one training text with the spans of the loss mask.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Control strings inside texts and roles
are broken up by codes that start with a backslash (and backslashes become codes too), so nothing a text says
can end its turn, and reading back gives the text unchanged.

Defined results: a null role or text is empty; a null conversation id is a conversation of its own. Rows with
the same turn keep all, ordered by role and text. Deltas before a message's start are dropped; events of one
sequence number apply in the order start, regenerate, edit, delta, then by text. An empty log gives no rows.
A conversation is one row of the result, so one conversation is gathered in one place; no other group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The marks of the template.
START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    """Codes for the backslash and for the first character of every control string of common templates."""
    coded = F.replace(text, F.lit("\\"), F.lit("\\e"))
    coded = F.regexp_replace(coded, r"<(\||/?s>|</?SYS>)", r"\\l$1")
    return F.regexp_replace(coded, r"\[(/?INST\])", r"\\b$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))
    return F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit("\\e"), F.lit("\\"))


def fold(events: DataFrame) -> DataFrame:
    """Final messages of a log (conv_id, seq, event, message, role, text): conv_id, message, role, text,
    ordered inside the conversation by ``message``."""
    rank = F.element_at(F.create_map(*[F.lit(x) for pair in (("message", 0), ("regenerate", 1), ("edit", 2), ("delta", 3)) for x in pair]), F.col("event"))
    rows = events.select("conv_id", "message", F.struct("seq", rank.alias("rank"), F.coalesce("text", F.lit("")).alias("text")).alias("at"), "event", F.coalesce("role", F.lit("")).alias("role"))
    resets = F.col("event") != "delta"
    one = rows.groupBy("conv_id", "message").agg(
        F.min(F.when(F.col("event") == "message", F.col("at.seq"))).alias("began"),
        F.max(F.when(F.col("event") == "regenerate", F.col("at.seq"))).alias("again"),
        F.max_by("role", F.when(F.col("event") == "message", F.col("at"))).alias("role"),
        F.max(F.when(resets, F.col("at"))).alias("reset"),
        F.array_sort(F.collect_list("at")).alias("all"),
    ).where(F.col("began").isNotNull())
    # What counts: the text of the last reset (a regeneration has none) and the deltas after it.
    after = F.filter("all", lambda e: e > F.col("reset"))
    text = F.concat(F.when(F.col("reset.rank") == 1, F.lit("")).otherwise(F.col("reset.text")), F.array_join(F.transform(after, lambda e: e["text"]), ""))
    later = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    one = one.select("conv_id", "message", "role", text.alias("text"), "began", F.max("again").over(later).alias("taken_back"))
    return one.where(F.col("taken_back").isNull() | (F.col("taken_back") <= F.col("began"))).select("conv_id", "message", "role", "text")


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (begin and size in code points of the escaped
    texts that the loss covers)."""
    turn = F.struct("message", escape_role(F.col("role")).alias("role"), escape(F.col("text")).alias("text"))
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END))), "")
    # A running position over turns, and a span wherever the role is the one to learn.
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,size:int>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.lit(len(START) + 1) + F.length(t["role"])
        span = F.array(F.struct(begin.alias("begin"), F.length(t["text"]).alias("size")))
        spans = F.when(t["role"] == loss_role, F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((begin + F.length(t["text"]) + F.lit(len(END))).alias("at"), spans.alias("spans"))

    spans = F.aggregate("turns", empty, step, lambda s: s["spans"])
    return turns.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, roles and texts unescaped: array of (role, text)."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        text = F.substring(p, F.length(role) + 2, F.length(p) - F.length(role) - F.lit(1 + len(END)))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["begin"] + 1, s["size"]))), "")
