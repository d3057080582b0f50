"""Chat formatting as relational expressions.

A conversation's rows become sorted turn structs; neighbours in the sorted array decide where a
block of one role opens and closes, so adjacent turns of one role share a block; the pieces are
joined with Spark expressions only. Every piece is `{text, loss}`: the formatted text is their
concatenation and the loss mask is their flag, both linear in the conversation's length.

Template: `<turn ROLE>text<next>text</turn>\\n`. Inside texts and roles a backslash becomes `\\\\`, `<`
becomes `\\l` and `>` becomes `\\g`, so no control string can appear there, and unescaping is exact.

Defined results: null text and null role are empty strings; a null turn sorts first; equal turns sort by
role, then text; rows that repeat are turns of their own; rows with a null conv_id form one
conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

LOSS_ROLE = "assistant"
OPEN, MID, NEXT, CLOSE = "<turn ", ">", "<next>", "</turn>\n"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    """Splitting at double backslashes from the left meets exactly the escaped ones."""
    parts = F.transform(
        F.split(text, r"\\\\", -1),
        lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")),
    )
    return F.when(F.contains(text, F.lit("\\")), F.array_join(parts, "\\")).otherwise(text)


def format_conversations(rows: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, pieces array<struct<text, loss>>, formatted)."""
    escaped = rows.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            escape(F.coalesce(F.col("role"), F.lit(""))).alias("role"),
            escape(F.coalesce(F.col("text"), F.lit(""))).alias("text"),
        ).alias("t"),
    )
    sorted_turns = escaped.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def pieces(turns: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            same_before = F.coalesce(F.get(turns, i - 1)["role"] == t["role"], F.lit(False))
            same_after = F.coalesce(F.get(turns, i + 1)["role"] == t["role"], F.lit(False))
            head = F.when(same_before, F.lit(NEXT)).otherwise(F.concat(F.lit(OPEN), t["role"], F.lit(MID)))
            tail = F.when(same_after, F.lit("")).otherwise(F.lit(CLOSE))
            no = F.lit(False)
            return F.array(piece(head, no), piece(t["text"], t["role"] == loss_role), piece(tail, no))

        return F.flatten(F.transform(turns, one))

    return sorted_turns.select("conv_id", let(F.col("turns"), pieces).alias("pieces")).withColumn(
        "formatted", F.array_join(F.transform("pieces", lambda p: p["text"]), "")
    )


def parse_formatted(formatted: Column) -> Column:
    """The turns that a formatted text holds: array<struct<role, text>>."""

    def block(b: Column) -> Column:
        role = F.substring_index(b, MID, 1)
        body = F.substr(b, F.char_length(role) + 2)
        name = unescape(F.substr(role, F.lit(len(OPEN) + 1)))
        return F.transform(F.split(body, NEXT, -1), lambda t: F.struct(name.alias("role"), unescape(t).alias("text")))

    blocks = F.filter(F.split(formatted, CLOSE, -1), lambda b: b != "")
    return F.flatten(F.transform(blocks, block))


def loss_text(pieces: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    kept = F.filter(pieces, lambda p: p["loss"])
    return F.array_join(F.transform(kept, lambda p: unescape(p["text"])), "")
