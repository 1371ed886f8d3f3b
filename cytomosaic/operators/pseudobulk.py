"""Pseudobulk differential expression: sums per replicate, then a negative-binomial Wald test per gene.

Cells only meet in a partial-aggregating groupBy; what reaches the solver is genes x replicates per group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import bh_adjust, seeded_hash
from ..functions.tails import normal_two_sided
from ..schemas import CELL_KEY
from ..session import cut
from .matrix import distinct_values


def pseudobulk_sums(counts: DataFrame, cells: DataFrame, keys: list[str], replicate: str = "replicate_id",
                    condition: str = "condition") -> DataFrame:
    """Summed counts and cell totals per (keys, condition, replicate, gene), zero-filled over the panel."""
    sample = [*keys, condition, replicate]
    sizes = cells.groupBy(*sample).agg(F.count(F.lit(1)).alias("n_cells"))
    sums = counts.join(cells.select(*CELL_KEY, *sample), CELL_KEY).groupBy(*sample, "gene").agg(F.sum("count").cast("bigint").alias("count"))
    frame = sizes.withColumn("gene", F.explode(distinct_values(counts, "gene")))
    return frame.join(sums, [*sample, "gene"], "left").fillna(0, subset=["count"])


def pseudo_replicates(cells: DataFrame, n: int = 3, condition: str = "condition", seed: int = 42) -> DataFrame:
    """Random equal split of each condition's cells into n parts, by rank under a seeded hash.

    Ranks come from hash-range buckets plus running totals, so no condition is sorted by one task.
    """
    buckets = 4096
    u = F.pmod(seeded_hash(seed, *CELL_KEY), F.lit(1 << 40))
    rows = cells.withColumn("_u", u).withColumn("_b", F.floor(F.col("_u") / float(1 << 40) * buckets))
    tally = rows.groupBy(condition, "_b").agg(F.count(F.lit(1)).alias("_c"))
    by = W.partitionBy(condition)
    tally = tally.withColumn("_before", F.coalesce(F.sum("_c").over(by.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn(
        "_n", F.sum("_c").over(by)).drop("_c")
    local = F.row_number().over(W.partitionBy(condition, "_b").orderBy("_u", *CELL_KEY))
    ranked = rows.withColumn("_l", local).join(tally, [condition, "_b"])
    part = F.floor((F.col("_before") + F.col("_l") - 1) * n / F.col("_n"))
    return ranked.withColumn("pseudo_replicate", F.concat_ws("_", F.col(condition), part.cast("string"))).drop("_u", "_b", "_before", "_n", "_l")


def filter_samples(sums: DataFrame, keys: list[str], min_cells: int = 5, min_counts: int = 10) -> DataFrame:
    """Samples with enough cells, then genes with enough counts over the kept samples."""
    kept = sums.filter(F.col("n_cells") >= min_cells)
    genes = kept.groupBy(*keys, "gene").agg(F.sum("count").alias("_t")).filter(F.col("_t") >= min_counts).drop("_t")
    return kept.join(genes, [*keys, "gene"], "left_semi")


def size_factors(sums: DataFrame, keys: list[str], sample: list[str]) -> DataFrame:
    """Median of ratios to the geometric mean over genes seen in every sample; library size when there is none."""
    by_gene = W.partitionBy(*keys, "gene")
    logs = sums.withColumn("_lg", F.when(F.col("count") > 0, F.log("count"))).withColumn(
        "_ok", F.min(F.col("count")).over(by_gene) > 0).withColumn("_ref", F.avg("_lg").over(by_gene))
    per = logs.groupBy(*keys, *sample).agg(
        F.exp(F.percentile(F.when(F.col("_ok"), F.col("_lg") - F.col("_ref")), F.lit(0.5))).alias("_mor"), F.sum("count").alias("_lib"))
    whole = W.partitionBy(*(keys or [F.lit(0)]))
    by_library = F.col("_lib") / F.exp(F.avg(F.log("_lib")).over(whole))
    return per.select(*keys, *sample, F.coalesce("_mor", by_library).alias("size_factor"))


def _lgamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8.0
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _nb_loglik(y, mu, log_alpha, is_b):
    """Cox-Reid adjusted profile likelihood, genes x grid; y and mu are genes x samples."""
    a = np.exp(log_alpha)[:, None, :]
    y3, m3 = y[:, :, None], mu[:, :, None]
    r = 1.0 / a
    ll = (_lgamma(y3 + r) - _lgamma(np.broadcast_to(r, (len(y), 1, r.shape[2]))) + y3 * np.log(m3 * a / (1 + m3 * a)) - r * np.log1p(m3 * a)).sum(1)
    w = m3 / (1 + m3 * a)
    return ll - 0.5 * (np.log(w[:, is_b].sum(1)) + np.log(w[:, ~is_b].sum(1)))


def _maximise(y, mu, is_b, centre=None, spread=None):
    """Log-dispersion maximiser by successive grid refinement; an optional normal prior on the log scale."""
    lo, hi = np.full(len(y), np.log(1e-8)), np.full(len(y), np.log(max(10.0, y.shape[1])))
    for _ in range(5):
        grid = lo[:, None] + (hi - lo)[:, None] * np.linspace(0, 1, 25)[None, :]
        value = _nb_loglik(y, mu, grid, is_b)
        if centre is not None:
            value = value - (grid - centre[:, None]) ** 2 / (2 * spread)
        best = value.argmax(1)
        step = (hi - lo) / 24
        top = grid[np.arange(len(y)), best]
        lo, hi = np.maximum(top - step, lo), np.minimum(top + step, hi)
    return 0.5 * (lo + hi)


def _group_rate(y, s, alpha, steps=60):
    """Maximum-likelihood rate of one condition: fixed-point on sum((y - s q) / (1 + alpha s q)) = 0."""
    q = np.maximum(y.sum(1) / s.sum(), 1e-8)
    for _ in range(steps):
        w = 1.0 / (1.0 + alpha[:, None] * s[None, :] * q[:, None])
        q = np.maximum((y * w).sum(1) / (s[None, :] * w).sum(1), 1e-8)
    return q


#: Means below this count are held there.
FLOOR = 0.5


def gene_wise(y: np.ndarray, s: np.ndarray, is_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean of normalised counts, log dispersion) of each gene (rows of y; s are size factors) by itself."""
    norm = y / s
    return norm.mean(1), _maximise(y, _fitted(norm, s, is_b), is_b)


def _fitted(norm: np.ndarray, s: np.ndarray, is_b: np.ndarray) -> np.ndarray:
    mean_a, mean_b = norm[:, ~is_b].mean(1), norm[:, is_b].mean(1)
    return np.maximum(np.where(is_b[None, :], mean_b[:, None], mean_a[:, None]) * s[None, :], FLOOR)


def dispersion_trend(base: np.ndarray, log_alpha: np.ndarray, n_samples: int) -> dict[str, float]:
    """Trend alpha = c0 + c1 / mean over one group's genes, the spread around it and the prior's variance; two numbers per gene are read."""
    usable = np.exp(log_alpha) > 1e-7
    c0, c1 = (float(np.exp(log_alpha[usable]).mean()) if usable.any() else 0.01), 0.0
    if usable.sum() >= 5:
        x = np.column_stack([np.ones(usable.sum()), 1.0 / np.maximum(base[usable], 1e-8)])
        target = np.exp(log_alpha[usable])
        fitted = np.full(len(target), c0)
        for _ in range(20):  # gamma-like weights 1 / fitted^2
            coef, *_ = np.linalg.lstsq(x / fitted[:, None], target / fitted, rcond=None)
            coef = np.maximum(coef, 1e-8)
            fitted = np.maximum(x @ coef, 1e-8)
        c0, c1 = coef.tolist()
    resid = log_alpha[usable] - np.log(_trend(base[usable], c0, c1))
    mad = float(1.4826 * np.median(np.abs(resid - np.median(resid)))) if usable.any() else 1.0
    half = max(n_samples - 2, 1) / 2.0
    sampling = sum(1.0 / (half + i) ** 2 for i in range(2000)) + 1.0 / (half + 2000)  # trigamma
    return {"c0": float(c0), "c1": float(c1), "mad": mad, "prior": max(mad**2 - sampling, 0.25)}


def _trend(base: np.ndarray, c0, c1) -> np.ndarray:
    return np.maximum(c0 + c1 / np.maximum(base, 1e-8), 1e-8)


def shrunken_wald(y: np.ndarray, s: np.ndarray, is_b: np.ndarray, base: np.ndarray, log_alpha: np.ndarray, c0: float, c1: float, mad: float,
                  prior: float) -> dict[str, np.ndarray]:
    """Wald statistics of each gene with its dispersion shrunk towards the group's trend."""
    trend = _trend(base, c0, c1)
    log_map = _maximise(y, _fitted(y / s, s, is_b), is_b, np.log(trend), prior)
    outlier = (np.exp(log_alpha) > 1e-7) & (log_alpha > np.log(trend) + 2 * mad)
    alpha = np.exp(np.where(outlier, log_alpha, log_map))
    qa, qb = _group_rate(y[:, ~is_b], s[~is_b], alpha), _group_rate(y[:, is_b], s[is_b], alpha)
    info = lambda q, part: (np.maximum(part[None, :] * q[:, None], FLOOR) / (1 + alpha[:, None] * np.maximum(part[None, :] * q[:, None], FLOOR))).sum(1)
    # an empty condition is held at the mean floor so that its log stays finite
    qa, qb = np.maximum(qa, FLOOR / s[~is_b].sum()), np.maximum(qb, FLOOR / s[is_b].sum())
    beta = np.log(qb / qa)
    se = np.sqrt(1.0 / info(qa, s[~is_b]) + 1.0 / info(qb, s[is_b]))
    return {"baseMean": base, "log2fc": beta / np.log(2), "lfcSE": se / np.log(2), "stat": beta / se, "dispersion": alpha}


def fit_wald(y: np.ndarray, s: np.ndarray, is_b: np.ndarray) -> dict[str, np.ndarray]:
    """The whole fit of one group's genes at once."""
    base, log_alpha = gene_wise(y, s, is_b)
    return shrunken_wald(y, s, is_b, base, log_alpha, **dispersion_trend(base, log_alpha, y.shape[1]))


def _group_matrices(pdf: pd.DataFrame, test: str):
    """(rows, y, size factors, is_b) of each group in a batch of gene rows; absent samples count 0."""
    for _, part in pdf.groupby("_group"):
        samples = [(x["condition"], x["replicate"]) for x in part["samples"].iloc[0]]
        place = {x: i for i, x in enumerate(samples)}
        y = np.zeros((len(part), len(samples)))
        for i, seen in enumerate(part["seen"]):
            for x in seen:
                y[i, place[x["condition"], x["replicate"]]] = x["count"]
        yield part, y, np.array([x["size_factor"] for x in part["samples"].iloc[0]]), np.array([c == test for c, _ in samples])


def pseudobulk_dge(counts: DataFrame, cells: DataFrame, reference: str, test: str, group: str | None = None,
                   replicate: str | None = "replicate_id", condition: str = "condition", min_cells: int = 5, min_counts: int = 10,
                   min_samples: int = 2, min_cells_per_side: int = 0, n_pseudo: int = 3) -> DataFrame:
    """Wald test of test against reference per gene (and group). Without replicates, random equal splits stand in.

    Groups with fewer than ``min_samples`` samples, or without both conditions, are left out.
    """
    pair = cells.filter(F.col(condition).isin(reference, test))
    if replicate is None:
        pair, replicate = pseudo_replicates(pair, n_pseudo, condition), "pseudo_replicate"
    keys = [group] if group else []
    if group and min_cells_per_side:
        sides = pair.groupBy(group).agg(*[F.count_if(F.col(condition) == c).alias(f"_{i}") for i, c in enumerate((reference, test))])
        pair = pair.join(sides.filter(f"_0 >= {min_cells_per_side} AND _1 >= {min_cells_per_side}").select(group), group, "left_semi")
    sums = filter_samples(pseudobulk_sums(counts, pair, keys, replicate, condition), keys, min_cells, min_counts)
    factors = size_factors(sums, keys, [condition, replicate])
    table = sums.join(factors, [*keys, condition, replicate]).select(
        (F.col(group) if group else F.lit("all")).alias("_group"), "gene", F.col(condition).alias("condition"), F.col(replicate).alias("replicate"), "count", "size_factor")
    # a group's samples are a short list; every gene is a row of its own, so no task holds a panel
    samples = table.groupBy("_group").agg(F.array_sort(F.collect_set(F.struct("condition", "replicate", "size_factor"))).alias("samples")).filter(
        F.exists("samples", lambda x: x["condition"] == test) & F.exists("samples", lambda x: x["condition"] == reference) & (F.size("samples") >= min_samples))
    seen = table.groupBy("_group", "gene").agg(F.collect_list(F.struct("condition", "replicate", F.col("count").cast("double").alias("count"))).alias("seen"))
    rows = cut(seen.join(samples, "_group"))

    def alone(batches):
        for pdf in batches:
            for part, y, s, is_b in _group_matrices(pdf, test):
                base, log_alpha = gene_wise(y, s, is_b)
                yield pd.DataFrame({"_group": part["_group"], "gene": part["gene"], "base": base, "log_alpha": log_alpha, "n": y.shape[1]})

    def trend(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_group": pdf["_group"].iloc[:1], **dispersion_trend(pdf["base"].to_numpy(), pdf["log_alpha"].to_numpy(), int(pdf["n"].iloc[0]))})

    def shrunk(batches):
        for pdf in batches:
            for part, y, s, is_b in _group_matrices(pdf, test):
                one = part.iloc[0]
                fit = shrunken_wald(y, s, is_b, part["base"].to_numpy(), part["log_alpha"].to_numpy(), one.c0, one.c1, one.mad, one.prior)
                yield pd.DataFrame({"_group": part["_group"], "gene": part["gene"], **fit})

    single = cut(rows.mapInPandas(alone, "_group string, gene string, base double, log_alpha double, n int"))
    around = single.groupBy("_group").applyInPandas(trend, "_group string, c0 double, c1 double, mad double, prior double")
    schema = "_group string, gene string, baseMean double, log2fc double, lfcSE double, stat double, dispersion double"
    fitted = rows.join(single.drop("n"), ["_group", "gene"]).join(around, "_group").mapInPandas(shrunk, schema).withColumn("pvalue", normal_two_sided(F.col("stat")))
    out = bh_adjust(fitted, "pvalue", ["_group"], "pval_adj").withColumn("method", F.lit("pseudobulk_nb"))
    return out.withColumnRenamed("_group", group) if group else out.drop("_group")
