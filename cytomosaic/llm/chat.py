"""Cumulative-snapshot collapse of logged conversations, and rendering of those that remain.

Loggers write a conversation again after each turn, so most logs are prefixes of later ones. A rolling hash names every prefix
of every conversation; a conversation whose whole hash is a proper prefix of another one (or equals one with a smaller id) is
left out by anti-joins. Everything runs in the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Turns that are rendered into one text, and turns that one window of the rolling hash holds.
SEGMENT = 256


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): distinct turns numbered from 0 within their conversation, by turn, role and text, nulls first.

    Rows without conv_id belong to no conversation and are left out. Repeated rows are one turn. Numbers start at the total of
    the conversation's earlier spans of ``SEGMENT`` turn numbers, so a long conversation never meets in one window.
    """
    rows = conversations.filter("conv_id is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
                                                              F.col("text").cast("string").alias("text")).distinct()
    spans = rows.withColumn("_span", F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(-(1 << 62))))
    before = Window.partitionBy("conv_id").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    starts = spans.groupBy("conv_id", "_span").agg(F.count(F.lit(1)).alias("_n")).select(
        "conv_id", "_span", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "_span").orderBy("turn", "role", "text")) - 1
    return spans.withColumn("_at", inside).join(starts, ["conv_id", "_span"]).select(
        "conv_id", (F.col("_start") + F.col("_at")).alias("position"), "role", "text")


def prefixes(numbered: DataFrame) -> DataFrame:
    """(conv_id, length, h1, h2): the hash of the first ``length`` turns, for every length.

    The hash rolls by XOR of 64-bit hashes of (position, role, text), two of them with different seeds, so it can be taken
    up within and then across spans of positions. Role and text are hashed with marks for null.
    """
    parts = [F.col("position"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    hashed = numbered.select("conv_id", "position", F.floor(F.col("position") / SEGMENT).alias("_span"),
                             *[F.xxhash64(F.lit(seed), *parts).alias(h) for h, seed in (("h1", 1), ("h2", 2))])
    before = Window.partitionBy("conv_id").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    starts = hashed.groupBy("conv_id", "_span").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2")).select(
        "conv_id", "_span", *[F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(x) for x in ("x1", "x2")])
    inside = Window.partitionBy("conv_id", "_span").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    rolled = hashed.withColumns({h: F.bit_xor(h).over(inside) for h in ("h1", "h2")}).join(starts, ["conv_id", "_span"])
    return rolled.select("conv_id", (F.col("position") + 1).alias("length"), *[F.col(f"h{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"h{i}") for i in (1, 2)])


def maximal(numbered: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that are no proper prefix of another one; of equal ones the smallest conv_id.

    Prefixes that many conversations share are one row each before the anti-join.
    """
    every = prefixes(numbered)
    sizes = numbered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))
    marked = every.join(sizes, "conv_id")
    whole = marked.filter("length = n_turns").groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    inner = marked.filter("length < n_turns").select(F.col("length").alias("n_turns"), "h1", "h2").distinct()
    return whole.join(inner, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns")


def render(numbered: DataFrame, kept: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, n_turns, segment, rendered): chat text of the kept conversations, ``segment`` turns to a row.

    A turn is ``<|role|>``, line feed, text, line feed; a null role is ``unknown``, a null text empty. Segments of a conversation
    follow each other by number, so their concatenation is the whole conversation.
    """
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    rows = numbered.join(kept, "conv_id").select("conv_id", "n_turns", F.floor(F.col("position") / segment).alias("segment"),
                                                 F.struct("position", line.alias("line")).alias("part"))
    parts = rows.groupBy("conv_id", "n_turns", "segment").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return parts.select("conv_id", "n_turns", "segment", F.array_join(F.col("parts.line"), "").alias("rendered"))


def format_chats(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Rendered maximal conversations of ``conversations`` (columns conv_id, turn, role, text; others are ignored)."""
    numbered = cut(turns(conversations))
    return render(numbered, maximal(numbered), segment)
