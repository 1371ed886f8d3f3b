"""Tie-aware rank sums over distinct values.

Cells never enter a window: non-zeros collapse to (group, gene, value, label) counts first (map-side),
values are spread over buckets that follow them so that no gene is one task's work, and the zeros of the sparse
matrix form one tie block added by formula. Bucket totals give the offsets of later buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.quantiles import bucketed
from ..functions.tails import normal_two_sided

BUCKETS = 256


def _bucketed(values: DataFrame, keys: list[str], value_range: tuple[float, float] | None) -> DataFrame:
    """Attach an exact monotone bucket: equal widths of a known range, else equal widths within each power of two."""
    v = F.col("v")
    if value_range is not None:
        lo, hi = value_range
        width = (hi - lo) / BUCKETS or 1.0
        return values.withColumn("bucket", F.floor((v - lo) / width).cast("int"))
    return bucketed(values, keys, "v", "bucket")


def rank_sums(expr: DataFrame, keys: list[str], label: str, value: str, frame: DataFrame,
              value_range: tuple[float, float] | None = None, weight: str | None = None) -> DataFrame:
    """Average-rank sums per (keys, label).

    ``frame`` holds one row per (keys, label) with ``n_cells``; observations missing from ``expr`` are zeros, so
    values must be non-negative when ``expr`` is sparse. Returns n_label, n_total, rank_sum and the tie term
    sum(t^3 - t). ``weight`` marks already collapsed input rows.
    """
    v = F.round(F.col(value).cast("double"), 12)
    times = F.col(weight) if weight else F.lit(1)
    base = expr.select(*keys, label, v.alias("v"), times.cast("bigint").alias("n")).filter(F.col("v").isNotNull())
    tallied = base.groupBy(*keys, "v", label).agg(F.sum("n").alias("n"))
    spread = _bucketed(tallied, keys, value_range)
    cell = [*keys, "bucket"]
    tie = F.sum("n").over(W.partitionBy(*cell, "v"))
    upto = F.sum("n").over(W.partitionBy(*cell).orderBy("v").rangeBetween(W.unboundedPreceding, W.currentRow))
    ranked = spread.withColumn("_t", tie).withColumn("_upto", upto)
    local = F.col("_upto") - (F.col("_t") - 1) / 2.0
    t = F.col("_t").cast("double")
    # each label's rows share the tie term in proportion to their count, so sums stay exact per value
    per_bucket = ranked.groupBy(*cell, label).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * local).alias("r"),
        F.sum(F.col("n") * (t * t - 1.0)).alias("tie"))
    offset = F.coalesce(F.sum("n").over(
        W.partitionBy(*keys).orderBy("bucket").rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
    merged = per_bucket.withColumn("_off", offset).groupBy(*keys, label).agg(
        F.sum("n").alias("nnz"), F.sum(F.col("r") + F.col("n") * F.col("_off")).alias("r"), F.sum("tie").alias("tie"))
    full = frame.select(*keys, label, "n_cells").join(merged, [*keys, label], "left").fillna(
        {"nnz": 0, "r": 0.0, "tie": 0.0})
    every = W.partitionBy(*keys)
    full = (full.withColumn("n_total", F.sum("n_cells").over(every))
            .withColumn("_z", (F.sum("n_cells").over(every) - F.sum("nnz").over(every)).cast("double"))
            .withColumn("tie_term", F.sum("tie").over(every) + F.col("_z") * F.col("_z") * F.col("_z") - F.col("_z")))
    own_zero = F.col("n_cells") - F.col("nnz")
    total = F.col("r") + F.col("nnz") * F.col("_z") + own_zero * (F.col("_z") + 1.0) / 2.0
    return full.withColumn("rank_sum", total).select(
        *keys, label, F.col("n_cells").alias("n_label"), "n_total", "nnz", "rank_sum", "tie_term")


def rank_z(n1: Column, n: Column, rank_sum: Column, tie_term: Column, tie_correct=False, continuity=False) -> Column:
    """Normal score of a rank sum of n1 out of n observations."""
    n1, n = n1.cast("double"), n.cast("double")
    n2 = n - n1
    centred = rank_sum - n1 * (n + 1.0) / 2.0
    if continuity:
        centred = F.signum(centred) * F.greatest(F.abs(centred) - 0.5, F.lit(0.0))
    spread = n + 1.0 - (tie_term / (n * (n - 1.0)) if tie_correct else F.lit(0.0))
    var = n1 * n2 / 12.0 * spread
    return F.when(var > 0, centred / F.sqrt(var)).otherwise(F.lit(0.0))


def score_test(scores: DataFrame, keys: list[str], label: str, value: str, test: str, reference: str,
               tie_correct=False, continuity=False, min_n: int = 3) -> DataFrame:
    """Two-sample rank-sum test of dense per-cell scores; fewer than ``min_n`` per side gives p = 1."""
    pair = scores.filter(F.col(label).isin(test, reference) & F.col(value).isNotNull() & ~F.isnan(value))
    sizes = pair.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n_cells"))
    table = rank_sums(pair, keys, label, value, sizes)
    side = lambda what, who: F.max(F.when(F.col(label) == who, F.col(what)))
    wide = table.groupBy(*keys).agg(
        F.coalesce(side("n_label", test), F.lit(0)).alias("n_test"),
        F.coalesce(side("n_label", reference), F.lit(0)).alias("n_reference"),
        F.max("n_total").alias("n_total"), side("rank_sum", test).alias("rank_sum"), F.max("tie_term").alias("tie_term"))
    enough = (F.col("n_test") >= min_n) & (F.col("n_reference") >= min_n)
    z = rank_z(F.col("n_test"), F.col("n_total"), F.col("rank_sum"), F.col("tie_term"), tie_correct, continuity)
    u = F.col("rank_sum") - F.col("n_test") * (F.col("n_test") + 1) / 2.0
    return (wide.withColumn("u_stat", u).withColumn("z", F.when(enough, z))
            .withColumn("pval", F.when(enough, normal_two_sided(F.col("z"))).otherwise(F.lit(1.0)))
            .drop("rank_sum", "tie_term", "n_total"))


def lognorm_range(target_sum: float = 100.0) -> tuple[float, float]:
    """No normalised value exceeds log1p(target): counts never exceed their cell total."""
    return 0.0, math.log1p(target_sum)
