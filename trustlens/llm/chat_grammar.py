"""Chat formatting with a grammar round trip.

Grammar of a formatted conversation::

    conversation := turn*
    turn         := "<s>" role "[INST]" text "[/INST]" "</s>"

The four control strings mark turns. A turn is first rendered as it is and parsed back; if the
parser (which also undoes escapes) does not recover exactly the source's role and text, the content is
escaped and rendered again: a control string gets one backslash more than it has
(``<s>`` becomes ``<\\s>``, ``<\\s>`` becomes ``<\\\\s>``), which the parser takes off again. The
joined conversation is parsed once more and compared with the source; a difference fails the
job. All of it is column expressions; turns are rendered before the one shuffle on the
conversation. The formatted text is one string, so one conversation's turns meet in one task.

**Loss.** ``loss_mask`` tells for each turn whether its text bears loss (role ``assistant``);
``loss_spans`` gives those texts' (start, length) in code points of ``formatted``.

**Cases.** A null text or role is empty. Turns are in the order of ``turn`` (null first), then role
and text; repeated rows are repeated turns. A null ``conv_id`` is a conversation of its own. An
empty table has no conversations. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
LOSS_ROLE = "assistant"


def escape(content: Column) -> Column:
    once = F.regexp_replace(content, r"<(\\*)(/?)s>", r"<\\$1$2s>")
    return F.regexp_replace(once, r"\[(\\*)(/?)INST\]", r"[\\$1$2INST]")


def unescape(content: Column) -> Column:
    once = F.regexp_replace(content, r"<\\(\\*)(/?)s>", r"<$1$2s>")
    return F.regexp_replace(once, r"\[\\(\\*)(/?)INST\]", r"[$1$2INST]")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit(OPEN), text, F.lit(CLOSE), F.lit(END))


def parse(formatted: Column) -> Column:
    """Array of (role, text) of a formatted text, escapes undone. Pieces end at END; a piece is
    START, the role up to the first OPEN, and the text up to the final CLOSE."""
    pieces = F.filter(F.split(formatted, END), lambda p: p != "")

    def turn(piece: Column) -> Column:
        role = F.substring_index(F.substr(piece, F.lit(len(START) + 1)), OPEN, 1)
        begin = F.length(role) + len(START) + len(OPEN) + 1
        text = F.substr(piece, begin, F.length(piece) - begin + 1 - len(CLOSE))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, role, text, and the rendered turn."""
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    source = F.array(F.struct("role", "text"))
    plain = render(F.col("role"), F.col("text"))
    same = F.coalesce(parse(plain) == source, F.lit(False))
    escaped = turns.withColumn("own", F.struct("role", "text")).withColumn("plain", same)
    shown = [F.when(F.col("plain"), F.col(c)).otherwise(escape(F.col(c))).alias(f"shown_{c}") for c in ("role", "text")]
    return escaped.select("conv_id", "turn", "role", "text", *shown)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask, loss_spans of every conversation, checked by parsing back."""
    turns = format_turns(conversations).withColumn("rendered", render(F.col("shown_role"), F.col("shown_text")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length("rendered")).over(before), F.lit(0)) + F.length("shown_role")
    turns = turns.withColumn("place", F.row_number().over(order)).withColumn("start", begin + len(START) + len(OPEN))
    row = F.struct("place", "role", "text", "rendered", "start", F.length("shown_text").cast("long").alias("size"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    made = grouped.select(
        "conv_id",
        F.concat_ws("", F.transform("turns", lambda t: t["rendered"])).alias("formatted"),
        F.transform("turns", lambda t: t["role"] == LOSS_ROLE).alias("loss_mask"),
        F.transform(
            F.filter("turns", lambda t: t["role"] == LOSS_ROLE), lambda t: F.struct(t["start"], t["size"])
        ).alias("loss_spans"),
        F.transform("turns", lambda t: F.struct(t["role"], t["text"])).alias("source"),
    )
    identical = parse(F.col("formatted")) == F.col("source")
    checked = F.when(identical, F.col("formatted")).otherwise(
        F.raise_error(F.concat(F.lit("conversation does not parse back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    )
    return made.select("conv_id", checked.alias("formatted"), "loss_mask", "loss_spans")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role, text) and loss_texts, from the formatted text and mask alone."""
    out = formatted.select("conv_id", "formatted", "loss_mask", parse(F.col("formatted")).alias("turns"))
    under = F.filter(F.zip_with("turns", "loss_mask", lambda t, m: F.when(m, t["text"])), lambda x: x.isNotNull())
    return out.select("conv_id", "formatted", "turns", under.alias("loss_texts"))
