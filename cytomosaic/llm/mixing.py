"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order that only doc_id and the seed decide, repeated for a second round.
A document's virtual finish time is the number of its source's words up to and including it, divided by the source's weight.
Served by finish time until the budget is spent, busy sources share the words by weight, and a source that has served its
documents twice leaves its share to the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import WORD, running

WEIGHTS = (5, 2, 1)
#: Words of the mix per word of input, and rounds of each document at most.
SHARE, ROUNDS = 1.5, 2
SEED = "mix-0"
#: Rows that one window of the running sums holds, about.
RANGE_ROWS = 8_000


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, place) of every row; place orders a source's documents, ties by doc_id and size.

    A row without doc_id takes its place from its text. A null text has size 0.
    """
    return docs.select(*_sized_columns(seed))


def _sized_columns(seed: str) -> list:
    text = F.col("text").cast("string")
    name = F.coalesce(F.col("doc_id").cast("string"), F.crc32(F.coalesce(text, F.lit(""))).cast("string"))
    return [F.col("doc_id"), F.col("source").cast("string").alias("source"), n_words(text).alias("size"),
            F.md5(F.concat(F.lit(seed + "|"), name)).alias("place")]


def targets(rows: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """(source, source_size, weight, rows, target) per source: its weighted share of the budget, at most ``rounds`` times its size.

    Sources by code point, null last, take the weights in turn. Sources fill up in order of rounds * size / weight, so the
    first source that stays below its bound fixes the level of all that follow. One row per source meets in a window.
    """
    everything = Window.partitionBy(F.lit(0))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    turn = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int")))
    bound = rounds * F.col("source_size")
    full_at = bound / F.col("weight")
    order = everything.orderBy(full_at, F.col("source").asc_nulls_last())
    spent = F.coalesce(F.sum(bound).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    active = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    levelled = weighed.withColumn("_level", (share * F.sum("source_size").over(everything) - spent) / active)
    first_open = F.min(F.when(full_at > F.col("_level"), F.struct(full_at, F.col("source").isNull(), "source", "_level"))).over(everything)
    target = F.least(bound.cast("double"), F.coalesce(first_open["_level"] * F.col("weight"), bound.cast("double")))
    return levelled.select("source", "source_size", "weight", "rows", target.alias("target"))


def _place():
    return F.struct("place", "doc_id", "size")


#: Equal rows that one row unfolds into at a time.
UNFOLD = 4096


def _unfold(groups: DataFrame) -> DataFrame:
    """One row per row of each group: ``_n`` becomes ``_nth`` (1 to n). A large group spreads over the tasks in pieces."""
    pieces = groups.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / UNFOLD))))
    spread = pieces.repartition("place", "_piece")
    nth = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(UNFOLD), F.col("_n") - F.col("_piece") * UNFOLD)))
    return spread.withColumn("_nth", nth).withColumn("_nth", F.col("_nth") + F.col("_piece") * UNFOLD).drop("_n", "_piece")


def schedule(rows: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """(source, source_size, target, last): per source the last row served in each round (array, null: none served).

    ``rows`` is a written ``sized`` table: it is read for the totals and for the queues. Rows that share source, place, doc_id
    and size (repeated rows) are counted first and queue up one after the other; ``last`` says how many of them (``nth``) are
    served, so a group of any size is cut where the budget ends. Rows without words do not queue.
    """
    by_source = cut(targets(rows, weights, share, rounds))
    facts = by_source.select(F.col("source").alias("_s"), "source_size", "weight", F.col("rows").alias("_rows"))
    groups = rows.filter("size > 0").groupBy("source", "place", "doc_id", "size").agg(F.count(F.lit(1)).alias("_n"))
    named = groups.join(_if_few(facts), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_words", F.col("_n") * F.col("size"))
    # a queue's order is a hash, so equal ranges of its first 32 bits hold about equal numbers of groups
    bucket = F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * F.ceil(F.col("_rows") / RANGE_ROWS) / (1 << 32))
    queued = running(named, ["source"], bucket, [F.col("place"), F.col("doc_id"), F.col("size")], "_words", "_end")
    single = _unfold(queued.withColumn("_before", F.col("_end") - F.col("_words")).drop("_end", "_words"))
    served = single.withColumn("_served", F.col("_before") + F.col("_nth") * F.col("size"))
    turns = served.withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    timed = turns.withColumn("finish", (F.col("_served") + F.col("_round") * F.col("source_size")) / F.col("weight"))
    total = by_source.agg(F.sum("source_size").alias("words"), F.sum("rows").alias("n"), F.max(F.col("target") / F.col("weight")).alias("level")).first()
    budget = int(share * (total["words"] or 0))
    # busy sources serve words at a steady rate, so equal spans of virtual time hold bounded numbers of rows
    steps = 4 * max(1, -(-rounds * (total["n"] or 0) // RANGE_ROWS))
    span = F.floor(F.col("finish") * (steps / max(total["level"] or 0.0, 1.0)))
    order = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("_round"), F.col("place"), F.col("doc_id"), F.col("size"), F.col("_nth")]
    queue = running(timed, [], span, order, "size", "_spent").filter(F.col("_spent") <= budget)
    reached = F.max(F.struct(_place().alias("at"), F.col("_nth").alias("nth")))
    last = queue.groupBy(F.col("source").alias("_s")).pivot("_round", list(range(rounds))).agg(reached)
    ends = last.select("_s", F.array(*[F.col(str(r)) for r in range(rounds)]).alias("last"))
    return by_source.join(_if_few(ends), F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "source_size", "target", "last")


def _if_few(df: DataFrame, most: int = 10_000) -> DataFrame:
    """Broadcast a table of one row per source when it is counted small."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _planned(rows: DataFrame, plan: DataFrame) -> DataFrame:
    named = plan.withColumnRenamed("source", "_s")
    return rows.join(_if_few(named), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def _reached(rounds: int):
    """Whether a row belongs to the last group of its source that is served in some round: its rows must be told apart."""
    return (F.col("size") > 0) & F.exists(F.slice("last", 1, rounds), lambda x: F.coalesce(_place().eqNullSafe(x["at"]), F.lit(False)))


def _copies(rounds: int, nth=None):
    """Times a row is taken; ``nth`` is its number among its equals, needed for the groups of ``_reached`` only."""
    count = F.lit(0)
    for r in range(rounds):
        x = F.col("last")[r]
        inside = _place() < x["at"]
        if nth is not None:
            inside |= _place().eqNullSafe(x["at"]) & (nth <= x["nth"])
        count += F.coalesce((x.isNotNull() & inside).cast("int"), F.lit(0))
    return F.when(F.col("size") == 0, F.lit(1)).otherwise(count)


def decide(rows: DataFrame, plan: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Rows with source, place, doc_id and size, and with the plan's source_size, target and copies (0 to ``rounds``).

    Of a group of equal rows that the budget cuts, as many rows as were served get the larger number. A row of size 0 has one copy.
    """
    joined = _planned(rows.select("doc_id", "source", "size", "place"), plan)
    clear = joined.filter(~_reached(rounds)).withColumn("copies", _copies(rounds)).drop("last")
    split = joined.filter(_reached(rounds)).groupBy("doc_id", "source", "size", "place", "source_size", "target").agg(
        F.first("last").alias("last"), F.count(F.lit(1)).alias("_n"))
    return clear.unionByName(_unfold(split).withColumn("copies", _copies(rounds, F.col("_nth"))).drop("last", "_nth"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken (repeats are rows), with the columns of ``docs``.

    Uses doc_id, text and source; null sources form one source, a null doc_id queues by its text. Rows without words take no
    part of the budget and stay once. Repeated rows are told apart by their place in the input where the budget cuts their group.
    """
    plan = cut(schedule(cut(sized(docs, seed)), weights, share, rounds))
    whole = docs.select(F.struct("*").alias("_row"), "doc_id", "source", "text")
    joined = _planned(whole.select("_row", *_sized_columns(seed)), plan)
    clear = joined.filter(~_reached(rounds)).select("_row", _copies(rounds).alias("copies"))
    # written once, so that the numbers of the rows hold whatever is computed again
    split = cut(joined.filter(_reached(rounds)).withColumn("_id", F.monotonically_increasing_id()).withColumn("_one", F.lit(1)))
    group = ["source", "place", "doc_id", "size"]
    numbered = running(split, group, F.floor(F.col("_id") / RANGE_ROWS), [F.col("_id")], "_one", "_nth")
    taken = clear.union(numbered.select("_row", _copies(rounds, F.col("_nth")).alias("copies"))).filter("copies > 0")
    return taken.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
