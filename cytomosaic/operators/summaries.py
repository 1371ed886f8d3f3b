"""Distribution summaries behind the figures: limits, densities, boxes and seeded samples."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.stats import seeded_hash
from ..schemas import CELL_KEY


def positive_limit(expr: DataFrame, by: list[str], value: str = "lognorm", percentile: float = 0.99, min_positive: int = 1) -> DataFrame:
    """Upper colour limit: a percentile of the positive values, 1.0 when too few are positive."""
    positive = expr.filter(F.col(value) > 0)
    limits = exact_quantiles(positive, by, value, [percentile])
    joined = expr.select(*by).distinct().join(limits, by, "left")
    enough = F.coalesce("n", F.lit(0)) >= min_positive
    return joined.select(*by, F.coalesce("n", F.lit(0)).alias("n_positive"), F.when(enough, F.col("q")[0]).otherwise(F.lit(1.0)).alias("limit"))


def density_curve(values: DataFrame, by: list[str], value: str, factor: float = 0.3, points: int = 200, min_n: int = 5,
                  upper: float = 0.99) -> DataFrame:
    """Gaussian kernel density on an even grid from 0 to the upper percentile; bandwidth = factor x sample sd.

    Equal values collapse first, so the grid is spread over distinct values only.
    """
    present = values.filter(F.col(value).isNotNull())
    top = exact_quantiles(present, by, value, [upper]).select(*by, F.col("q")[0].alias("top"))
    st = present.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(value).alias("sd")).join(top, by)
    usable = st.filter((F.col("n") >= min_n) & (F.col("sd") > 0)).withColumn("h", F.col("sd") * factor)
    tally = present.groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    grid = tally.join(usable, by).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("top") * F.col("point") / (points - 1)
    u = (x - F.col("v")) / F.col("h")
    body = F.sum(F.col("c") * F.exp(-0.5 * u * u)) / (F.first("n") * F.first("h") * math.sqrt(2.0 * math.pi))
    return grid.groupBy(*by, "point").agg(F.first(x).alias("x"), body.alias("density"))


def box_summary(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quartiles and the extreme values inside 1.5 interquartile ranges."""
    fences = exact_quantiles(values, by, value, [0.25, 0.5, 0.75]).select(
        *by, "n", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"))
    iqr = F.col("q75") - F.col("q25")
    inside = (F.col(value) >= F.col("q25") - 1.5 * iqr) & (F.col(value) <= F.col("q75") + 1.5 * iqr)
    ends = values.join(fences, by).groupBy(*by).agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_lo"), F.max(F.when(inside, F.col(value))).alias("whisker_hi"))
    return fences.join(ends, by)


def seeded_sample(cells: DataFrame, n: int, by: list[str] | None = None, seed: int = 42, buckets: int = 65_536) -> DataFrame:
    """n rows (per group) in the order of a seeded hash: the same sample at any partitioning.

    Bucket tallies of the hash locate the cut first, so only about n rows per group are ever ranked.
    """
    keys = by or []
    u = F.pmod(seeded_hash(seed, *CELL_KEY), F.lit(1 << 40))
    rows = cells.withColumn("_all", F.lit(0)).withColumn("_u", u).withColumn("_b", F.floor(F.col("_u") / float(1 << 40) * buckets))
    group = [*keys, "_all"]
    running = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    tally = rows.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(running), F.lit(0)))
    cutoff = tally.filter(F.col("_before") < n).groupBy(*group).agg(F.max("_b").alias("_last"))
    near = rows.join(cutoff, group).filter(F.col("_b") <= F.col("_last"))
    order = W.partitionBy(*group).orderBy("_u", *CELL_KEY)
    return near.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).select(*cells.columns)


def cumulative_variance(variance: DataFrame) -> DataFrame:
    """Running sum of the explained-variance ratio over components."""
    running = W.orderBy("pc").rowsBetween(W.unboundedPreceding, W.currentRow)
    return variance.withColumn("cumulative", F.sum("ratio").over(running))
