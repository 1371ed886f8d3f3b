"""Quality control: per-cell and per-gene metrics, filters with per-reason counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..schemas import CELL_KEY
from ..session import cut


def cell_metrics(cells: DataFrame, counts: DataFrame) -> DataFrame:
    """total_counts and n_genes for every cell, zero-count cells included."""
    sums = counts.groupBy(*CELL_KEY).agg(
        F.sum("count").cast("bigint").alias("total_counts"), F.count(F.lit(1)).alias("n_genes"))
    return cells.join(sums, CELL_KEY, "left").fillna(0, subset=["total_counts", "n_genes"])


def gene_metrics(cells: DataFrame, counts: DataFrame) -> DataFrame:
    """n_cells, mean_counts and pct_dropout per gene over all cells."""
    n = cells.select(F.count(F.lit(1))).scalar()
    sums = counts.groupBy("gene").agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("count").cast("bigint").alias("total_counts"))
    return sums.withColumn("_n", n).select(
        "gene", "n_cells", "total_counts",
        (F.col("total_counts") / F.col("_n")).alias("mean_counts"),
        (100.0 * (1.0 - F.col("n_cells") / F.col("_n"))).alias("pct_dropout"))


def _present(cells: DataFrame, column: str) -> bool:
    return column in cells.columns


def qc_flags(cells_with_metrics: DataFrame, min_counts=10, max_counts=2000, min_genes=10, max_genes=300,
             min_cell_area=20.0, filter_control_probes=True, filter_control_codewords=True) -> DataFrame:
    """One boolean per removal reason plus ``passes``; absent optional columns never remove a cell."""
    yes = F.lit(True)

    def control(column: str, active: bool) -> Column:
        # an all-NULL column is an absent one
        return F.coalesce(F.col(column) == 0, yes) if active and _present(cells_with_metrics, column) else yes

    area = yes
    if min_cell_area > 0 and _present(cells_with_metrics, "cell_area"):
        a = F.col("cell_area")
        finite = a.isNotNull() & ~F.isnan(a) & (F.abs(a) < F.lit(float("inf")))
        none_given = cells_with_metrics.select(F.count("cell_area") == 0).scalar()
        area = none_given | (finite & (a >= min_cell_area))
    flagged = (
        cells_with_metrics
        .withColumn("ok_counts", F.col("total_counts").between(min_counts, max_counts))
        .withColumn("ok_genes", F.col("n_genes").between(min_genes, max_genes))
        .withColumn("ok_area", area)
        .withColumn("ok_probe", control("control_probe_counts", filter_control_probes))
        .withColumn("ok_codeword", control("control_codeword_counts", filter_control_codewords))
    )
    return flagged.withColumn("passes", F.expr("ok_counts AND ok_genes AND ok_area AND ok_probe AND ok_codeword"))


def removal_report(flags: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How many cells each reason removes, and how many survive."""
    lost = lambda c, name: F.sum((~F.col(c)).cast("bigint")).alias(name)
    return flags.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_before"), lost("ok_counts", "removed_counts"), lost("ok_genes", "removed_genes"),
        lost("ok_area", "removed_area"), lost("ok_probe", "removed_probe"), lost("ok_codeword", "removed_codeword"),
        F.sum(F.col("passes").cast("bigint")).alias("n_after"))


def detected_genes(counts: DataFrame, min_cells: int) -> DataFrame:
    return counts.groupBy("gene").agg(F.count(F.lit(1)).alias("n_cells")).filter(F.col("n_cells") >= min_cells)


def run_qc(cells: DataFrame, counts: DataFrame, min_cells_per_gene: int = 5, stage: bool = False, **thresholds):
    """Filtered (cells, counts) and the flag table the report is made from.

    ``stage`` writes the kept cells and their counts, for callers that read all of the filtered tables: counts that are derived from other
    tables are then derived twice, for the metrics of the cells and for those kept.
    """
    flags = qc_flags(cell_metrics(cells, counts), **thresholds)
    kept = flags.filter("passes").drop("ok_counts", "ok_genes", "ok_area", "ok_probe", "ok_codeword", "passes")
    kept = cut(kept) if stage else kept
    inside = counts.join(kept.select(*CELL_KEY), CELL_KEY, "left_semi")
    inside = cut(inside) if stage else inside
    genes = detected_genes(inside, min_cells_per_gene)
    return kept, inside.join(genes.select("gene"), "gene", "left_semi"), flags


def percentiles(df: DataFrame, by: list[str], column: str, points: list[float], prefix: str) -> DataFrame:
    """Exact interpolated percentiles in named columns."""
    named = [F.col("q")[i].alias(f"{prefix}{round(p * 100):02d}") for i, p in enumerate(points)]
    return exact_quantiles(df, by, column, points).select(*by, "n", *named)


def cells_overview(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Cells and median total counts per slide / condition."""
    return exact_quantiles(metrics, by, "total_counts", [0.5]).select(
        *by, F.col("n").alias("n_cells"), F.col("q")[0].alias("median_counts"))


def condition_balance(cells: DataFrame) -> DataFrame:
    """Distinct slides and cells per condition, share of all cells."""
    total = cells.select(F.count(F.lit(1))).scalar()
    return cells.groupBy("condition").agg(
        F.countDistinct("slide_id").alias("n_slides"), F.count(F.lit(1)).alias("n_cells"),
    ).withColumn("share", F.col("n_cells") / total)
