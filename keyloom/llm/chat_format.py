"""Chat formatting with a grammar round trip, in DataFrame expressions alone.

Grammar (deterministic, one way to read any string it accepts)::

    conversation := turn*
    turn         := OPEN role SEP text CLOSE

A role never holds SEP, OPEN or CLOSE and a text never holds OPEN or CLOSE, so splitting at CLOSE and then at the
first SEP reads every turn back.  Each turn is first rendered as it is and read again by that parser.  Where the
turns that come back differ from the source, the turn is escaped one step further:

* level 0: the text as it is,
* level 1: control strings of role and text become two-character escapes,
* level 2: backslashes become escapes as well.

Reading always undoes escapes.  In a level-2 text every backslash is followed by its escape's letter and no control
string is left, so level 2 always comes back identical: the search ends there at the latest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SEP, CLOSE = "### ", ": ", " </turn>\n"
#: What stands for a control string or a backslash; the order is that of escaping, undone from the end.
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\c"), (": ", "\\s"))


def _swap(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column, level: int, role: bool = False) -> Column:
    """text under escape level 0, 1 or 2; only a role needs SEP escaped."""
    pairs = ESCAPES if role else ESCAPES[:3]
    return _swap(text, () if level == 0 else pairs[1:] if level == 1 else pairs)


def unescape(text: Column, role: bool = False) -> Column:
    return _swap(text, [(new, old) for old, new in reversed(ESCAPES if role else ESCAPES[:3])])


def _render(role: Column, text: Column, level: int) -> Column:
    return F.concat(F.lit(OPEN), escape(role, level, True), F.lit(SEP), escape(text, level), F.lit(CLOSE))


def _pieces(formatted: Column) -> Column:
    """The formatted turns without their CLOSE; the last piece of a well-formed string is empty and dropped."""
    return F.filter(F.split(formatted, r"\Q" + CLOSE + r"\E", -1), lambda x: x != "")


def parse(formatted: Column) -> Column:
    """Formatted string -> array of (role, text), escapes undone; the inverse of format_conversations."""

    def turn(piece: Column) -> Column:
        body = F.substring(piece, len(OPEN) + 1, 2147483647)
        role = F.substring_index(body, SEP, 1)
        text = F.substr(body, F.length(role) + F.lit(len(SEP) + 1))
        return F.struct(unescape(role, True).alias("role"), unescape(text).alias("text"))

    return F.transform(_pieces(formatted), turn)


def _identical(role: Column, text: Column, rendered: Column, escaped: bool) -> Column:
    """Whether the parser reads exactly this turn from its rendering, and no bare control string is in it."""
    back = parse(rendered)
    free = ~(F.contains(role, F.lit("###")) | F.contains(role, F.lit("</turn>")) | F.contains(text, F.lit("###")) | F.contains(text, F.lit("</turn>")))
    return (free | F.lit(escaped)) & (F.size(back) == 1) & (F.get(back, F.lit(0))["role"] == role) & (F.get(back, F.lit(0))["text"] == text)


def format_conversations(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) -> one row per conversation.

    Columns: conv_id, n_turns, formatted, turns (the source turns with `level`, the escape level each needed) and
    loss_spans (start, length in code points of every assistant text within `formatted`).

    Defined cases: a null or empty text or role counts as empty; turns follow `turn`, nulls first, and ties or
    repeated rows follow role, then text; a null conv_id is a conversation of its own; other columns are ignored; an
    empty table gives no rows.  A conversation is one output row, so its length is bounded by what a row can hold.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    turns = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    plain, light = (_render(F.col("role"), F.col("text"), k) for k in (0, 1))
    level = F.when(_identical(F.col("role"), F.col("text"), plain, False), 0).when(_identical(F.col("role"), F.col("text"), light, True), 1).otherwise(2)
    turns = turns.withColumn("level", level)
    shown_role = F.when(F.col("level") == 0, F.col("role")).when(F.col("level") == 1, escape(F.col("role"), 1, True)).otherwise(escape(F.col("role"), 2, True))
    shown_text = F.when(F.col("level") == 0, F.col("text")).when(F.col("level") == 1, escape(F.col("text"), 1)).otherwise(escape(F.col("text"), 2))
    turns = turns.withColumn("head", F.concat(F.lit(OPEN), shown_role, F.lit(SEP))).withColumn("body", shown_text)
    one = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "level", "head", "body"))).alias("t"))
    whole = F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "")
    spans = F.aggregate(
        "t",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["head"]) + F.length(x["body"]) + F.lit(len(CLOSE))).alias("at"),
            F.when(x["role"] == "assistant", F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(x["head"])).alias("start"), F.length(x["body"]).alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    turns_out = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"), x["level"].alias("level")))
    return one.select("conv_id", F.size("t").cast("long").alias("n_turns"), whole.alias("formatted"), turns_out.alias("turns"), spans.alias("loss_spans"))


def verify(formatted: DataFrame) -> DataFrame:
    """Add `round_trip`: whether the whole string reads back as the source turns."""
    source = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return formatted.withColumn("round_trip", parse(F.col("formatted")) == source)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, cut from the formatted string and unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader of the formatted strings gets back, as digests."""
    read = F.array_join(F.transform(parse(F.col("formatted")), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = loss_text(F.col("formatted"), F.col("loss_spans"))
    return formatted.select(
        "conv_id",
        F.size(parse(F.col("formatted"))).cast("long").alias("n_turns"),
        F.sha2(read, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
