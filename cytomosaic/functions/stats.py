"""Column-level statistics shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bh_adjust(df: DataFrame, p: str, by: list[str], out: str) -> DataFrame:
    """Benjamini-Hochberg step-up inside each test family ``by``; NULL p stays NULL.

    A family is one row per gene (or label), so its window is bounded by the panel size.
    """
    live = [F.col(c) for c in by] + [F.col(p).isNull()]
    ordered = W.partitionBy(*live).orderBy(F.col(p).asc())
    family = W.partitionBy(*live)
    running = W.partitionBy(*live).orderBy(F.col("_rank").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = df.withColumn("_rank", F.row_number().over(ordered)).withColumn("_m", F.count(F.lit(1)).over(family))
    scaled = F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(running)
    return ranked.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), scaled))).drop("_rank", "_m")


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson r from sufficient statistics; NULL when either side is constant."""
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    ok = (vx > 1e-9 * F.greatest(sxx, F.lit(1e-30))) & (vy > 1e-9 * F.greatest(syy, F.lit(1e-30)))
    return F.when(ok, (sxy - sx * sy / n) / F.sqrt(vx * vy))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def neg_log10(p: Column, floor: float = 1e-300) -> Column:
    return -F.log10(F.greatest(p, F.lit(floor)))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def label_order(label: Column) -> list[Column]:
    """Sort keys that put integer labels first, by number, then the rest by text."""
    number = label.try_cast("bigint")
    return [number.isNull().asc(), number.asc_nulls_last(), label.asc()]


def min_max_unit(df: DataFrame, column: str, out: str, by: list[str] | None = None, invert: bool = False) -> DataFrame:
    """Scale a small result column to [0, 1]; missing or constant input becomes 0.5 / 0 as the sweep expects."""
    span = W.partitionBy(*(by or [F.lit(0)]))
    lo, hi = F.min(column).over(span), F.max(column).over(span)
    unit = F.coalesce((F.col(column) - lo) / F.when(hi > lo, hi - lo).otherwise(F.lit(1.0)), F.lit(0.5))
    return df.withColumn(out, 1.0 - unit if invert else unit)


def seeded_hash(seed: int, *cols: str) -> Column:
    """Layout-independent pseudo-random key for sampling and shuffling."""
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in cols])
