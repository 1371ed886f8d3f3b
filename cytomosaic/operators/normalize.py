"""Library-size normalisation, area scaling, variable-gene selection and standardised expression."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.quantiles import scalar_quantile
from ..schemas import CELL_KEY
from .matrix import group_gene_stats


def scale_by_area(values: DataFrame, cells: DataFrame, value: str = "count", out: str = "scaled") -> DataFrame:
    """value x median valid area / area; cells without a valid area keep their values."""
    area = F.col("cell_area")
    valid = area.isNotNull() & ~F.isnan(area) & (area > 0)
    median = scalar_quantile(cells.filter(valid), "cell_area", 0.5)
    factor = cells.select(*CELL_KEY, F.when(valid, median / area).otherwise(F.lit(1.0)).alias("_f"))
    joined = values.join(factor, CELL_KEY, "left")
    return joined.withColumn(out, F.col(value) * F.coalesce("_f", F.lit(1.0))).drop("_f")


def lognorm(counts: DataFrame, target_sum: float = 100.0, value: str = "count") -> DataFrame:
    """log1p(value x target / cell total); the per-cell window is bounded by the panel size."""
    v = F.col(value).cast("double")
    total = F.sum(v).over(W.partitionBy(*CELL_KEY))
    return counts.withColumn("_total", total).withColumn(
        "lognorm", F.log1p(v * target_sum / F.col("_total"))).drop("_total")


def normalise(counts: DataFrame, cells: DataFrame, target_sum: float = 100.0, by_area: bool = False,
              area_stage: str = "before_total") -> DataFrame:
    """The documented order: optional area scaling, then total-count scaling, then log1p.

    Scaling a whole cell before the total is divided out cancels; ``area_stage='after_total'`` makes it count.
    """
    if not by_area:
        return lognorm(counts, target_sum)
    if area_stage == "before_total":
        return lognorm(scale_by_area(counts, cells), target_sum, "scaled").drop("scaled")
    per_total = counts.withColumn(
        "_v", F.col("count") * F.lit(float(target_sum)) / F.sum("count").over(W.partitionBy(*CELL_KEY)))
    scaled = scale_by_area(per_total, cells, "_v", "_s")
    return scaled.withColumn("lognorm", F.log1p("_s")).drop("_v", "_s")


def integer_counts(expr: DataFrame, value: str = "count") -> DataFrame:
    """Counts rounded to whole numbers for the count-based tests."""
    return expr.withColumn("count", F.round(value).cast("int")).filter(F.col("count") != 0)


def dispersion_table(expr: DataFrame, cells: DataFrame, batch: str = "condition", n_bins: int = 20) -> DataFrame:
    """Normalised dispersion per (batch, gene): equal-width bins of log1p mean, z-score of log dispersion."""
    raw = expr.select(*CELL_KEY, "gene", F.expm1("lognorm").alias("v"))
    st = group_gene_stats(raw, cells, [batch], "v")
    n = F.col("n_cells")
    var = F.col("var_pop") * n / F.greatest(n - 1, F.lit(1))
    mean = F.when(F.col("mean") == 0, 1e-12).otherwise(F.col("mean"))
    base = st.filter(F.col("nnz") > 0).select(
        batch, "gene", F.log1p("mean").alias("log_mean"),
        F.when(var / mean > 0, F.log(var / mean)).alias("log_disp"))
    per_batch = W.partitionBy(batch)
    lo, hi = F.min("log_mean").over(per_batch), F.max("log_mean").over(per_batch)
    # right-closed equal-width bins; the minimum falls into the first bin
    position = F.when(hi > lo, (F.col("log_mean") - lo) / (hi - lo) * n_bins).otherwise(F.lit(1.0))
    binned = base.withColumn("bin", F.least(F.greatest(F.ceil(position), F.lit(1)), F.lit(n_bins)))
    in_bin = W.partitionBy(batch, "bin")
    sd, mu = F.stddev_samp("log_disp").over(in_bin), F.avg("log_disp").over(in_bin)
    # a bin with a single gene uses its mean as deviation, which scores that gene 1
    score = F.when(sd.isNull(), F.lit(1.0)).when(sd > 0, (F.col("log_disp") - mu) / sd)
    return binned.withColumn("norm_disp", score)


def variable_genes(expr: DataFrame, cells: DataFrame, n_top: int, batch: str = "condition") -> DataFrame:
    """gene, n_batches, median rank and the highly_variable flag (all genes when n_top does not restrict)."""
    disp = dispersion_table(expr, cells, batch)
    rank = F.row_number().over(W.partitionBy(batch).orderBy(F.round("norm_disp", 9).desc_nulls_last(), "gene"))
    ranked = disp.withColumn("rank", rank)
    return _flag_top(ranked, n_top)


def _flag_top(ranked: DataFrame, n_top: int) -> DataFrame:
    merged = ranked.groupBy("gene").agg(
        F.sum((F.col("rank") <= n_top).cast("bigint")).alias("n_batches"),
        F.percentile("rank", F.lit(0.5)).alias("median_rank"))
    overall = F.row_number().over(W.orderBy(F.col("n_batches").desc(), F.col("median_rank"), "gene"))
    n_genes = merged.select(F.count(F.lit(1))).scalar()
    if n_top <= 0:
        return merged.withColumn("highly_variable", F.lit(True))
    return merged.withColumn("highly_variable", (overall <= n_top) | (n_genes <= n_top))


def _local_quadratic(x: np.ndarray, y: np.ndarray, span: float) -> np.ndarray:
    """Tricube-weighted local quadratic fit of the gene-level variance trend."""
    k = min(len(x), max(4, int(np.ceil(span * len(x)))))
    out = np.empty(len(x))
    for i, centre in enumerate(x):
        gap = np.abs(x - centre)
        near = np.argpartition(gap, k - 1)[:k]
        width = max(gap[near].max(), 1e-12)
        weight = np.sqrt(np.clip((1 - (gap[near] / width) ** 3) ** 3, 0, None))
        design = np.vander(x[near] - centre, 3, increasing=True)
        coef, *_ = np.linalg.lstsq(design * weight[:, None], y[near] * weight, rcond=None)
        out[i] = coef[0]
    return out


def variable_genes_from_counts(counts: DataFrame, cells: DataFrame, n_top: int, batch: str = "condition",
                               span: float = 0.3, value: str = "count") -> DataFrame:
    """Variance-stabilised ranking: the trend is fitted on the gene-level table, one row per gene per batch."""
    st = group_gene_stats(counts, cells, [batch], value)
    n = F.col("n_cells")
    table = st.select(batch, "gene", "mean", (F.col("var_pop") * n / F.greatest(n - 1, F.lit(1))).alias("var"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("gene")
        live = (pdf["var"] > 0) & (pdf["mean"] > 0)
        sd = np.zeros(len(pdf))
        if live.any():
            x, y = np.log10(pdf.loc[live, "mean"].to_numpy()), np.log10(pdf.loc[live, "var"].to_numpy())
            sd[live.to_numpy()] = np.sqrt(10 ** _local_quadratic(x, y, span))
        return pd.DataFrame({batch: pdf[batch], "gene": pdf["gene"], "sd_fit": sd})

    trend = table.groupBy(batch).applyInPandas(fit, f"{batch} string, gene string, sd_fit double")
    size = F.col("n_cells")
    clip = F.col("mean") + F.col("sd_fit") * F.sqrt(size)
    clipped = counts.join(cells.select(*CELL_KEY, batch), CELL_KEY).join(
        st.join(trend, [batch, "gene"]).select(batch, "gene", "mean", "sd_fit", "n_cells"), [batch, "gene"])
    v = F.least(F.col(value).cast("double"), clip)
    sums = clipped.groupBy(batch, "gene").agg(F.sum(v).alias("c1"), F.sum(v * v).alias("c2"))
    scored = st.select(batch, "gene", "mean", "n_cells").join(trend, [batch, "gene"]).join(
        sums, [batch, "gene"], "left").fillna(0.0, subset=["c1", "c2"])
    spread = size * F.col("mean") * F.col("mean") + F.col("c2") - 2.0 * F.col("c1") * F.col("mean")
    normed = F.when(F.col("sd_fit") > 0, spread / ((size - 1) * F.col("sd_fit") * F.col("sd_fit"))).otherwise(0.0)
    ranked = scored.withColumn("norm_var", normed).withColumn(
        "rank", F.row_number().over(W.partitionBy(batch).orderBy(F.round("norm_var", 9).desc(), "gene")))
    return _flag_top(ranked, n_top)


def zscore_clipped(expr: DataFrame, cells: DataFrame, genes: list[str], limit: float = 3.0) -> DataFrame:
    """Dense z of a short gene list for every given cell (population sd + 1e-9, clipped): heat-map input."""
    wanted = F.array(*[F.lit(g) for g in genes])
    short = expr.filter(F.col("gene").isin(genes))
    st = group_gene_stats(short.withColumn("_one", F.lit(1)), cells.withColumn("_one", F.lit(1)), ["_one"], "lognorm", wanted)
    grid = cells.select(*CELL_KEY, F.explode(wanted).alias("gene"))
    dense = grid.join(short.select(*CELL_KEY, "gene", "lognorm"), [*CELL_KEY, "gene"], "left").fillna(0.0, subset=["lognorm"])
    z = (F.col("lognorm") - F.col("mean")) / (F.sqrt("var_pop") + 1e-9)
    return dense.join(st.select("gene", "mean", "var_pop"), "gene").select(
        *CELL_KEY, "gene", F.least(F.greatest(z, F.lit(-limit)), F.lit(limit)).alias("z"))
