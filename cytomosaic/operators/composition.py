"""Cell-type composition: proportions, replicate tables, cross-tabs and the log-ratio test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import bh_adjust, label_order
from ..functions.tails import t_quantile_975, t_two_sided
from .matrix import distinct_values


def proportions(cells: DataFrame, by: str = "condition", label: str = "cell_type") -> DataFrame:
    """Percent of each label within a condition."""
    counts = cells.groupBy(by, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(W.partitionBy(by)))


def composition_table(cells: DataFrame, replicate: str = "replicate_id", condition: str = "condition", label: str = "cell_type") -> DataFrame:
    """replicate x label counts, zero-filled, with the replicate's condition and cell total."""
    names = distinct_values(cells, label)
    size = cells.groupBy(replicate).agg(
        F.min(condition).alias(condition), F.count(F.lit(1)).alias("n_cells"),
        F.countDistinct(condition).alias("_conditions"))
    checked = size.withColumn(condition, F.when(F.col("_conditions") == 1, F.col(condition)).otherwise(
        F.raise_error(F.concat(F.lit("replicate spans conditions: "), F.col(replicate))))).drop("_conditions")
    counts = cells.groupBy(replicate, label).agg(F.count(F.lit(1)).alias("n"))
    grid = checked.withColumn(label, F.explode(names))
    return grid.join(counts, [replicate, label], "left").fillna(0, subset=["n"])


def clr_test(table: DataFrame, reference: str, test: str, replicate: str = "replicate_id", condition: str = "condition",
             label: str = "cell_type", fdr: float = 0.05) -> DataFrame:
    """Centred log-ratio per replicate, Welch t per label, 95 % interval, BH; labels need two replicates per side."""
    pair = table.filter(F.col(condition).isin(reference, test))
    rep = W.partitionBy(replicate)
    share = (F.col("n") + 0.5) / F.sum(F.col("n") + 0.5).over(rep)
    clr = pair.withColumn("_lp", F.log(share)).withColumn("clr", F.col("_lp") - F.avg("_lp").over(rep))
    at = lambda fn, who: fn(F.when(F.col(condition) == who, F.col("clr")))
    st = clr.groupBy(label).agg(
        at(F.avg, reference).alias("ma"), at(F.avg, test).alias("mb"), at(F.var_samp, reference).alias("va"),
        at(F.var_samp, test).alias("vb"), at(F.count, reference).alias("na"), at(F.count, test).alias("nb")
    ).filter("na >= 2 AND nb >= 2").withColumn("ea", F.col("va") / F.col("na")).withColumn("eb", F.col("vb") / F.col("nb"))
    e = F.col("ea") + F.col("eb")
    ln2 = F.log(F.lit(2.0))
    fitted = (st.withColumn("se", F.sqrt(e)).withColumn("diff", F.col("mb") - F.col("ma"))
              .withColumn("t_stat", F.when(F.col("se") > 0, F.col("diff") / F.col("se")))
              .withColumn("dof", F.when(F.col("se") > 0, e * e / (F.col("ea") * F.col("ea") / (F.col("na") - 1) + F.col("eb") * F.col("eb") / (F.col("nb") - 1))))
              .withColumn("pval", t_two_sided(F.col("t_stat"), F.col("dof"))).withColumn("_q", t_quantile_975(F.col("dof"))))
    adjusted = bh_adjust(fitted, "pval", [], "pval_adj")
    return adjusted.select(
        label, (F.col("diff") / ln2).alias("log2fc"),
        ((F.col("diff") - F.col("_q") * F.col("se")) / ln2).alias("credible_interval_lo"),
        ((F.col("diff") + F.col("_q") * F.col("se")) / ln2).alias("credible_interval_hi"),
        (F.col("pval_adj") < fdr).alias("significant"), "t_stat", "dof", "pval", "pval_adj")


def composition_analysis(cells: DataFrame, replicate: str = "replicate_id", condition: str = "condition", label: str = "cell_type",
                         reference: str | None = None, test: str | None = None) -> DataFrame:
    """Two-condition composition test; the largest label overall is reported as the reference label."""
    from .dge import pick_conditions

    if reference is None or test is None:
        reference, test = pick_conditions(cells, condition)
    table = composition_table(cells, replicate, condition, label)
    largest = table.groupBy(label).agg(F.sum("n").alias("total")).select(
        F.min_by(label, F.struct(-F.col("total"), F.col(label)))).scalar()
    out = clr_test(table, reference, test, replicate, condition, label)
    return out.withColumn("method", F.lit("clr_ttest")).withColumn("reference_cell_type", largest).orderBy(F.abs("log2fc").desc(), label)


def cross_tab(cells: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of (a, b), the share within a and the share within b."""
    n = cells.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share_of_a", F.col("n") / F.sum("n").over(W.partitionBy(a))).withColumn(
        "share_of_b", F.col("n") / F.sum("n").over(W.partitionBy(b)))


def supplementary_clusters(cells: DataFrame, cluster: str, reference: str, test: str, label: str = "cell_type") -> DataFrame:
    """Per cluster: label, totals, cells per condition and percent of all cells, numeric-aware order."""
    total = cells.select(F.count(F.lit(1))).scalar()
    return cells.groupBy(cluster, label).agg(
        F.count(F.lit(1)).alias("n_cells_total"), F.count_if(F.col("condition") == reference).alias("n_reference"),
        F.count_if(F.col("condition") == test).alias("n_test"),
    ).withColumn("pct_total", F.round(100.0 * F.col("n_cells_total") / total, 2)).orderBy(*label_order(F.col(cluster)))


def distinct_counts(cells: DataFrame, by: str, columns: list[str]) -> DataFrame:
    return cells.groupBy(by).agg(*[F.countDistinct(c).alias(f"n_{c}") for c in columns])


def representative_slides(cells: DataFrame, chosen: dict[str, str] | None = None) -> DataFrame:
    """One slide per condition: the caller's choice, else the first id."""
    first = cells.groupBy("condition").agg(F.min("slide_id").alias("slide_id"))
    if not chosen:
        return first
    table = F.create_map(*[F.lit(v) for pair in chosen.items() for v in pair])
    return first.withColumn("slide_id", F.coalesce(table[F.col("condition")], F.col("slide_id")))
