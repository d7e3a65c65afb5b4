"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns as
context, and that reply alone under the loss mask. What follows the last
assistant turn is kept in one closing example without a target, so that the
examples hold every turn. Turns are marked with control strings, which are
escaped reversibly inside roles and texts. All of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Openings of control strings, of this template and of others; a backslash goes in after the first character.
GUARDED = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    """``text`` without control strings: backslashes are doubled, and one splits each guarded opening."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for g in GUARDED:
        out = F.replace(out, F.lit(g), F.lit(f"{g[0]}\\{g[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target_role: str = "assistant") -> DataFrame:
    """Examples: conv_id, example (from 0), context, target, formatted, loss_start, loss_end, whole.

    ``formatted`` is the context, the target turn and its end mark; code points
    from ``loss_start`` up to ``loss_end`` are trainable and hold the escaped
    reply. A closing example without a target has an empty range. ``whole``
    marks the one example per conversation that holds all turns. Turns are in
    the order of ``turn``; null turns come first, ties go by role, then text.
    Null roles and texts count as empty, a null id is a conversation like any
    other, and repeated rows are turns of their own. Other columns are ignored.

    The work and the output of this method grow with the square of the turns
    of a conversation, whose text must fit into one row.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = conversations.select(F.col(id_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    opening = lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(SEP))
    pieces = F.transform("turns", lambda t: F.struct(opening(t).alias("open"), escape(t["text"]).alias("text"), (t["role"] == target_role).alias("target")))
    convs = convs.select("conv_id", pieces.alias("p")).withColumn("n", F.size("p"))
    segments = F.transform("p", lambda t: F.concat(t["open"], t["text"], F.lit(END)))
    places = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: F.element_at("p", i)["target"] | (i == F.col("n")))
    rows = convs.select("conv_id", "n", "p", segments.alias("segments"), F.posexplode(places).alias("example", "at"))
    rows = rows.select(
        "conv_id",
        "example",
        (F.col("at") == F.col("n")).alias("whole"),
        F.array_join(F.slice("segments", F.lit(1), F.col("at") - 1), "").alias("before"),
        F.element_at("segments", F.col("at")).alias("segment"),
        F.element_at("p", F.col("at")).alias("last"),
    )
    target = F.col("last.target")
    rows = rows.select(
        "conv_id",
        "example",
        F.concat("before", F.when(target, F.col("last.open")).otherwise(F.col("segment"))).alias("context"),
        F.when(target, F.col("last.text")).alias("target"),
        F.concat("before", "segment").alias("formatted"),
        "whole",
    )
    start = F.char_length("context")
    return rows.select("conv_id", "example", "context", "target", "formatted", start.alias("loss_start"), (start + F.coalesce(F.char_length("target"), F.lit(0))).alias("loss_end"), "whole")


def read_turns(formatted: Column) -> Column:
    """The (role, text) structs that a formatted text holds."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>"), lambda s: s != "")
    inner = lambda s: F.substring(s, F.lit(len(START) + 1), F.char_length(s))
    return F.transform(
        parts,
        lambda s: F.struct(
            unescape(F.split_part(inner(s), F.lit(SEP), F.lit(1))).alias("role"),
            unescape(F.split_part(inner(s), F.lit(SEP), F.lit(2))).alias("text"),
        ),
    )


def loss_text(formatted: Column, start: Column, end: Column) -> Column:
    """The unescaped text under the loss mask."""
    return unescape(F.substring(formatted, start + 1, end - start))
