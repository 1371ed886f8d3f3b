"""Exact interpolated quantiles of groups of any size.

The built-in exact percentile keeps a group's distinct values in one task. Here values collapse to counts, buckets that
follow the values and their running totals locate the wanted ranks, and only the buckets that hold one are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets per power of two.
BUCKETS = 1024


def magnitude(v: Column) -> Column:
    """Signed power of two of a value, rising with it: one far outlier leaves the buckets of all other values as they are."""
    size = F.floor(F.least(F.log2(F.abs(v)), F.lit(1024.0))) + 1100
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0)).cast("int")


def bucketed(values: DataFrame, keys: list[str], v: str, out: str) -> DataFrame:
    """``values`` with a bucket number that rises with ``v``: equal widths between the extremes of each (key, power of two)."""
    sized = values.withColumn("_e", magnitude(F.col(v)))
    ends = sized.groupBy(*keys, "_e").agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    inside = F.when(span > 0, F.floor((F.col(v) - F.col("_lo")) / span * BUCKETS)).otherwise(F.lit(0))
    # without keys there is one row per power of two, some 4,000 at most
    return sized.join(ends if keys else F.broadcast(ends), [*keys, "_e"]).withColumn(
        out, F.col("_e").cast("long") * (BUCKETS + 1) + inside).drop("_e", "_lo", "_hi")


def exact_quantiles(df: DataFrame, by: list[str], column: str | Column, points: list[float]) -> DataFrame:
    """(by..., n, q): q holds one linearly interpolated value per point; NULL and NaN values are ignored."""
    value = (F.col(column) if isinstance(column, str) else column).cast("double")
    rows = df.select(*by, value.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    tally = rows.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))
    spread = bucketed(tally, by, "_v", "_b")
    whole = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    upto = whole.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    totals = spread.groupBy(*by, "_b").agg(F.sum("_c").alias("_t")).withColumn("_before", F.coalesce(F.sum("_t").over(upto), F.lit(0))).withColumn(
        "n", F.sum("_t").over(whole))
    # every point needs the values at the ranks below and above its position
    position = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    ranks = F.array_distinct(F.concat(*[F.array(F.floor(position(p)), F.ceil(position(p))) for p in points]))
    inside = F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_t")))
    wanted = totals.withColumn("_r", inside).filter(F.size("_r") > 0).select(*by, "_b", "n", "_before", "_r")
    order = W.partitionBy(*by, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    near = spread.join(wanted, [*by, "_b"]).withColumn("_end", F.col("_before") + F.sum("_c").over(order))
    hits = near.withColumn("_r", F.explode("_r")).filter((F.col("_r") < F.col("_end")) & (F.col("_r") >= F.col("_end") - F.col("_c")))
    found = hits.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_m"), F.max("n").alias("n"))
    at = lambda r: F.col("_m")[r]
    one = lambda p: at(F.floor(position(p))) + (position(p) - F.floor(position(p))) * (at(F.ceil(position(p))) - at(F.floor(position(p))))
    return found.select(*by, "n", F.array(*[one(p) for p in points]).alias("q"))


def scalar_quantile(df: DataFrame, column: str | Column, point: float) -> Column:
    """One quantile of a whole table as a scalar column."""
    return exact_quantiles(df, [], column, [point]).select(F.col("q")[0]).scalar()
