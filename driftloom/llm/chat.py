"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent
turns of one role share a block, made by array aggregation:

    <s>[ROLE]user[TEXT]first text[NEXT]second text[/ROLE]</s>

Control strings start with ``<`` or ``[``.  In texts and roles these two
characters, and the ``&`` that marks an escape, are written ``&lt;``,
``&#91;`` and ``&amp;``; so a control string never comes from a text, and
reading is the exact reverse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, TEXT, NEXT, CLOSE = "<s>[ROLE]", "[TEXT]", "[NEXT]", "[/ROLE]</s>"
#: What a loss is taken on.
LEARNT = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&#91;"), F.lit("[")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def starts(lengths: str) -> Column:
    """Where each piece begins: the sum of the lengths before it.

    Sums of blocks, about as many as each has members, keep a long
    conversation from adding up all that is before for each piece.
    """
    add = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    wide = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(lengths))).cast("int"))
    sums = F.transform(F.sequence(F.lit(0), wide - 1), lambda j: add(F.slice(lengths, j * wide + 1, wide)))

    def placed(s):
        def one(_, i):
            block = F.floor(i / wide).cast("int")
            return add(F.slice(s, F.lit(1), block)) + add(F.slice(lengths, block * wide + 1, i - block * wide))

        return F.transform(lengths, one)

    return F.get(F.transform(F.array(sums), placed), 0)


def format_conversations(turns: DataFrame, learnt: str = LEARNT) -> DataFrame:
    """conv_id, formatted, loss_spans of each conversation of (conv_id, turn, role, text).

    Turns are sorted by turn (null first), then role and text; a null text or
    role is an empty one.  Repeated rows are turns of their own.  Rows with a
    null conv_id form one conversation.  ``loss_spans`` has (start, end) of
    each text of the role ``learnt`` in ``formatted``, in code points, end
    exclusive; markers are never in one.  A conversation must fit in memory,
    as its formatted text is one value.  No rows give none.  Other columns are
    ignored, whatever their names.
    """
    one = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.select("conv_id", one.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # Positions at which a block begins; a block is the turns up to the next.
    begins = F.filter(
        F.transform("turns", lambda t, i: F.when((i == 0) | (F.get("turns", i - 1)["role"] != t["role"]), i)), lambda i: i.isNotNull()
    )
    ends = F.concat(F.slice("begins", F.lit(2), F.greatest(F.size("begins") - 1, F.lit(0))), F.array(F.size("turns")))
    blocks = F.zip_with("begins", "ends", lambda b, e: F.struct(F.get("turns", b)["role"].alias("role"), F.transform(F.slice("turns", b + 1, e - b), lambda t: escape(t["text"])).alias("texts")))
    parts = grouped.withColumn("begins", begins).withColumn("ends", ends).select("conv_id", blocks.alias("blocks"))
    # Pieces in output order: an opening with its role, texts with what follows each, and which carry a loss.
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)

    def pieces(b):
        texts = F.flatten(F.transform(b["texts"], lambda t, i: F.array(piece(F.when(i == 0, F.lit(TEXT)).otherwise(F.lit(NEXT)), no), piece(t, b["role"] == learnt))))
        return F.concat(F.array(piece(F.concat(F.lit(OPEN), escape(b["role"])), no)), texts, F.array(piece(F.lit(CLOSE), no)))

    flat = parts.select("conv_id", F.flatten(F.transform("blocks", pieces)).alias("pieces"))
    flat = flat.withColumn("lengths", F.transform("pieces", lambda p: F.length(p["text"]))).withColumn("starts", starts("lengths"))
    text = F.array_join(F.transform("pieces", lambda p: p["text"]), "")
    placed = F.zip_with("pieces", "starts", lambda p, at: F.when(p["loss"], F.struct(at.alias("start"), (at + F.length(p["text"])).alias("end"))))
    return flat.select("conv_id", text.alias("formatted"), F.array_compact(placed).cast("array<struct<start:int,end:int>>").alias("loss_spans"))


def read_conversations(formatted: DataFrame) -> DataFrame:
    """The given columns and turns: an array of (role, text), read from ``formatted`` alone."""
    blocks = F.filter(F.split("formatted", r"<s>\[ROLE\]", -1), lambda b: b != "")

    def turns(b):
        role = unescape(F.substring_index(b, TEXT, 1))
        body = F.replace(F.substr(b, F.length(F.substring_index(b, TEXT, 1)) + F.lit(len(TEXT) + 1)), F.lit(CLOSE), F.lit(""))
        return F.transform(F.split(body, r"\[NEXT\]", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return formatted.withColumn("turns", F.flatten(F.transform(blocks, turns)))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
