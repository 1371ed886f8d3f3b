"""Moments of the sparse cell x gene table under the implicit-zero rule: N always comes from ``cells``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import pearson
from ..schemas import CELL_KEY


def distinct_values(df: DataFrame, column: str) -> Column:
    """Sorted distinct values as a scalar array; only for columns bounded by the panel or the label set."""
    return df.select(F.array_sort(F.collect_set(column))).scalar()


def with_labels(expr: DataFrame, cells: DataFrame, labels: list[str]) -> DataFrame:
    """Attach per-cell labels to expression rows (inner: cells without a label leave the analysis)."""
    missing = [c for c in labels if c not in expr.columns]
    if not missing:
        return expr
    return expr.join(cells.select(*CELL_KEY, *missing), CELL_KEY, "inner")


def group_sizes(cells: DataFrame, groups: list[str]) -> DataFrame:
    return cells.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_cells"))


def group_gene_frame(cells: DataFrame, genes: Column, groups: list[str]) -> DataFrame:
    """Every (group, gene) combination with its cell count; ``genes`` is a scalar array column."""
    return group_sizes(cells, groups).withColumn("gene", F.explode(genes))


def group_gene_stats(
    expr: DataFrame, cells: DataFrame, groups: list[str], value: str = "lognorm", genes: Column | None = None
) -> DataFrame:
    """n, sum, sum of squares, mean and fraction expressing per (group, gene), zeros included."""
    genes = distinct_values(expr, "gene") if genes is None else genes
    v = F.col(value).cast("double")
    sums = with_labels(expr, cells, groups).groupBy(*groups, "gene").agg(
        F.sum(v).alias("s1"), F.sum(v * v).alias("s2"), F.sum((v > 0).cast("bigint")).alias("nnz")
    )
    frame = group_gene_frame(cells, genes, groups)
    filled = frame.join(sums, [*groups, "gene"], "left").fillna({"s1": 0.0, "s2": 0.0, "nnz": 0})
    n = F.col("n_cells")
    return filled.select(
        *groups, "gene", "n_cells", "s1", "s2", "nnz",
        (F.col("s1") / n).alias("mean"),
        (F.col("nnz") / n).alias("pct"),
        F.greatest(F.lit(0.0), F.col("s2") / n - (F.col("s1") / n) * (F.col("s1") / n)).alias("var_pop"),
    )


def gene_correlations(
    expr: DataFrame, cells: DataFrame, target: str, groups: list[str] | None = None, value: str = "lognorm"
) -> DataFrame:
    """Pearson r of one gene against every other gene, per group, from sufficient statistics.

    Only the target gene's non-zeros meet the matrix, so no gene x gene pairs are produced.
    """
    groups = groups or []
    work = with_labels(expr.select(*CELL_KEY, "gene", F.col(value).cast("double").alias("v")), cells, groups)
    anchor = work.filter(F.col("gene") == target).select(*CELL_KEY, F.col("v").alias("t"))
    cross = work.join(anchor, CELL_KEY, "left").groupBy(*groups, "gene").agg(
        F.sum("v").alias("s1"), F.sum(F.col("v") * F.col("v")).alias("s2"),
        F.coalesce(F.sum(F.col("v") * F.col("t")), F.lit(0.0)).alias("s12"),
    )
    own = cross.filter(F.col("gene") == target).select(*groups, F.col("s1").alias("t1"), F.col("s2").alias("t2"))
    size = group_sizes(cells, groups) if groups else cells.agg(F.count(F.lit(1)).alias("n_cells"))
    if groups:
        frame = group_gene_frame(cells, distinct_values(expr, "gene"), groups)
        joined = frame.join(cross, [*groups, "gene"], "left").join(own, groups, "left")
    else:
        joined = cross.withColumn("n_cells", size.scalar()).withColumn("_k", F.lit(1)).join(
            own.withColumn("_k", F.lit(1)), "_k", "left").drop("_k")
    joined = joined.fillna(0.0, subset=["s1", "s2", "s12", "t1", "t2"])
    r = pearson(F.col("n_cells"), F.col("s1"), F.col("t1"), F.col("s2"), F.col("t2"), F.col("s12"))
    return joined.filter(F.col("gene") != target).select(*groups, "gene", "n_cells", r.alias("r"))
