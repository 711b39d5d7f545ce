"""Chat formatting with Spark expressions only.

Rows (conversation, turn, role, text) become one formatted string per conversation: turns are sorted,
adjacent turns of one role are merged into a block, and blocks are concatenated between control strings.
Control strings all begin with ``<|``; in roles and texts ``&`` is written ``&amp;`` and ``<|`` is
written ``&lt;|``, so a text can never be taken for a control string and reads back exactly.
Merged turns keep a separator inside their block, so the turns themselves read back too.

Defined results: a null text or role is empty; rows with equal turn numbers are ordered by role, then
text, nulls as empty; repeated rows are turns of their own; a null conversation id is a conversation;
a null turn sorts first; other columns, whatever their names, are left out; an empty table gives an empty result; a text
of any length is part of one row, a conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: The control strings of the template.
OPEN, BODY, JOIN, CLOSE = "<|turn|>", "<|says|>", "<|also|>", "<|end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def merge_turns(turns: Column) -> Column:
    """Sorted turn structs (role, text) to blocks (role, texts): adjacent turns of one role share a block."""

    def blocks(t: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(t) - 1)
        first = F.filter(places, lambda i: (i == 0) | ~F.get(t, i)["role"].eqNullSafe(F.get(t, i - 1)["role"]))

        def cut(s: Column) -> Column:
            def block(i: Column, k: Column) -> Column:
                after = F.coalesce(F.get(s, k + 1), F.size(t))
                return F.struct(F.get(t, i)["role"].alias("role"), F.transform(F.slice(t, i + 1, after - i), lambda x: x["text"]).alias("texts"))

            return F.transform(s, block)

        return let(first, cut)

    return let(turns, blocks)


def render(blocks: Column) -> Column:
    one = lambda b: F.concat(F.lit(OPEN), escape(b["role"]), F.lit(BODY), F.array_join(F.transform(b["texts"], escape), JOIN), F.lit(CLOSE))
    return F.array_join(F.transform(blocks, one), "")


def format_chats(rows: DataFrame) -> DataFrame:
    """Per conversation: conv_id and ``formatted``."""
    filled = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return filled.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", render(merge_turns(F.col("turns"))).alias("formatted"))


def parse_chats(formatted: DataFrame, column: str = "formatted") -> DataFrame:
    """Adds ``blocks`` (role, texts), read back from the formatted string alone."""

    def block(piece: Column) -> Column:
        return let(
            F.split(piece, r"<\|says\|>", 2),
            lambda p: F.struct(unescape(F.substring(p[0], len(OPEN) + 1, 2**30)).alias("role"), F.transform(F.split(p[1], r"<\|also\|>", -1), unescape).alias("texts")),
        )

    pieces = F.filter(F.split(F.col(column), r"<\|end\|>", -1), lambda x: x != "")
    return formatted.withColumn("blocks", F.transform(pieces, block))


def loss_spans(formatted: DataFrame, role: str = "assistant") -> DataFrame:
    """Adds ``loss_texts``: what the loss mask covers, the texts of ``role`` in order, read from ``blocks``."""
    own = F.filter(F.col("blocks"), lambda b: b["role"] == role)
    return formatted.withColumn("loss_texts", F.flatten(F.transform(own, lambda b: b["texts"])))
