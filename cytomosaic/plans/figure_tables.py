"""The tables behind the figures: one function per published table, composed from the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import label_order, stars
from ..operators import annotate, composition, dge, ligand_receptor, matrix, normalize, qc, ranks, spatial, summaries
from ..schemas import CELL_KEY

QUARTILES = [0.0, 0.25, 0.5, 0.75, 1.0]


def qc_distributions(metrics: DataFrame, columns: list[str], by: str = "condition") -> DataFrame:
    """Five-number summary of each metric per condition, long form."""
    long = metrics.select(by, *CELL_KEY, F.expr("stack({}, {}) AS (metric, value)".format(
        len(columns), ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in columns))))
    return qc.percentiles(long, [by, "metric"], "value", QUARTILES, "p")


def embedding_points(embedding: DataFrame, cells: DataFrame, labels: list[str]) -> DataFrame:
    """First two dimensions with the labels to colour by."""
    return embedding.select(*CELL_KEY, F.col("vec")[0].alias("dim1"), F.col("vec")[1].alias("dim2")).join(cells.select(*CELL_KEY, *labels), CELL_KEY)


def spatial_points(cells: DataFrame, labels: list[str], representative: bool = False, chosen: dict[str, str] | None = None) -> DataFrame:
    """Coordinates with labels, on all slides or on one slide per condition."""
    points = cells.select(*CELL_KEY, "condition", "x", "y", *labels)
    if not representative:
        return points
    return points.join(composition.representative_slides(cells, chosen).select("slide_id"), "slide_id", "left_semi")


def marker_dots(expr: DataFrame, cells: DataFrame, cluster: str, n: int = 5) -> DataFrame:
    """Mean and fraction expressing of each cluster's unique top markers in every cluster, with the 95th percentile limit."""
    markers = dge.unique_markers(dge.cluster_markers(expr, cells, cluster, n_genes=n), cluster, n).select("gene", F.col(cluster).alias("marker_of"))
    st = matrix.group_gene_stats(expr.join(markers.select("gene"), "gene", "left_semi"), cells, [cluster])
    dots = st.join(markers, "gene").select(cluster, "gene", "marker_of", "mean", "pct")
    limit = dots.select(F.percentile("mean", F.lit(0.95))).scalar()
    return dots.withColumn("colour_limit", limit)


def deg_heatmap(expr: DataFrame, cells: DataFrame, results: DataFrame, reference: str, test: str, n_genes: int = 40, n_cells: int = 300,
                lfc_min: float = 1.0, p_max: float = 0.01) -> DataFrame:
    """Clipped z of the strongest genes in a seeded sample of cells per condition."""
    genes = [r.gene for r in dge.top_half_and_half(results, n_genes, lfc_min, p_max).select("gene").collect()]  # n_genes rows
    sample = summaries.seeded_sample(cells.filter(F.col("condition").isin(reference, test)), n_cells, ["condition"])
    inside = expr.join(sample.select(*CELL_KEY), CELL_KEY, "left_semi")
    return normalize.zscore_clipped(inside, sample, genes).join(sample.select(*CELL_KEY, "condition"), CELL_KEY)


def gene_map(expr: DataFrame, cells: DataFrame, genes: list[str], percentile: float = 0.99, min_positive: int = 1) -> DataFrame:
    """Expression at every cell of a few genes with each gene's colour limit."""
    wanted = F.array(*[F.lit(g) for g in genes])
    short = expr.filter(F.col("gene").isin(genes)).select(*CELL_KEY, "gene", "lognorm")
    limit = summaries.positive_limit(short, ["gene"], percentile=percentile, min_positive=min_positive).select("gene", "limit")
    grid = cells.select(*CELL_KEY, "condition", "x", "y", F.explode(wanted).alias("gene"))
    return grid.join(short, [*CELL_KEY, "gene"], "left").join(limit, "gene", "left").fillna({"lognorm": 0.0, "limit": 1.0})


def cell_type_overview(cells: DataFrame, chosen: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Type shares per condition, and the coordinates on the representative slides."""
    return composition.proportions(cells), spatial_points(cells, ["cell_type"], True, chosen)


def moran_top(moran: DataFrame, n: int = 30, p_max: float = 0.05) -> DataFrame:
    return moran.filter(F.col("p_value") < p_max).orderBy(F.col("morans_i").desc(), "gene").limit(n)


def search_moran(moran: DataFrame, p_max: float = 0.05, limit: int = 200) -> DataFrame:
    """Result browser of the Moran table: strongest statistic first."""
    return dge.search_results(moran.withColumnRenamed("p_adj", "pval_adj"), p_max, limit, [F.abs("morans_i").desc(), F.col("gene")]).withColumnRenamed("pval_adj", "p_adj")


def search_groups(table: DataFrame, group: str, wanted: str, p_max: float = 0.05, limit: int = 200) -> DataFrame:
    """Result browser of one cluster, cell type or domain: best adjusted p first."""
    return dge.search_results(table.filter(F.col(group) == wanted), p_max, limit, [F.round("pval_adj", 9), F.col("gene")])


def enrichment_cells(enrichment: DataFrame) -> DataFrame:
    """z matrix in long form with significance stars."""
    return enrichment.withColumn("stars", stars(F.col("p_adj")))


def deg_bubbles(flagged: DataFrame, group: str, n: int = 10, p_cap: float = 8.0) -> DataFrame:
    """Top genes per group and direction with capped -log10 p, genes ordered by |mean log2fc|."""
    from pyspark.sql import Window as W

    picked = dge.top_per_direction(flagged, group, n).select("gene").distinct()
    rows = flagged.join(picked, "gene", "left_semi").withColumn(
        "neg_log10_p", F.least(-F.log10(F.greatest("pval_adj", F.lit(1e-300))), F.lit(p_cap)))
    order = rows.groupBy("gene").agg(F.abs(F.avg("log2fc")).alias("effect"))
    place = F.row_number().over(W.orderBy(F.round("effect", 9).desc(), "gene"))
    return rows.join(order.withColumn("gene_order", place), "gene").select(group, "gene", "gene_order", "log2fc", "neg_log10_p", "direction")


def slide_overview(metrics: DataFrame) -> DataFrame:
    return qc.cells_overview(metrics, ["slide_id", "condition"])


def functional_panel(expr: DataFrame, cells: DataFrame, per_type: DataFrame, groups: dict[str, list[str]], group: str = "cell_type",
                     p_max: float = 0.05) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For a functional gene set: ordered effects, mean / fraction dots per condition, and the pivot of significant effects."""
    spark = expr.sparkSession
    rows = [(g, name, i) for i, (name, genes) in enumerate(groups.items()) for g in genes]
    names = spark.createDataFrame(rows, "gene string, functional_group string, group_position int")
    mean_effect = per_type.groupBy("gene").agg(F.avg("log2fc").alias("log2fc"))
    inside = expr.join(names.select("gene").distinct(), "gene", "left_semi")
    dots = matrix.group_gene_stats(inside, cells, ["condition", group]).select("condition", group, "gene", "mean", "pct")
    pivot = dge.effect_pivot(per_type.join(names.select("gene").distinct(), "gene", "left_semi"), group, p_max)
    return dge.effect_order(mean_effect, names), dots, pivot


def gene_focus(expr: DataFrame, cells: DataFrame, gene: str, reference: str, test: str) -> tuple[DataFrame, DataFrame]:
    """One gene: per-type tests with stars, and density curves per condition."""
    tests = annotate.gene_by_type_tests(expr, cells, gene, reference, test).withColumn("stars", stars(F.col("pval_adj")))
    values = cells.filter(F.col("condition").isin(reference, test)).join(
        expr.filter(F.col("gene") == gene).select(*CELL_KEY, "lognorm"), CELL_KEY, "left").fillna(0.0, subset=["lognorm"])
    return tests, summaries.density_curve(values, ["condition"], "lognorm", 0.3)


def composition_forest(cells: DataFrame, reference: str, test: str) -> tuple[DataFrame, DataFrame]:
    """Stacked-bar shares per replicate and the test table with intervals."""
    from pyspark.sql import Window as W

    table = composition.composition_table(cells)
    bars = table.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("replicate_id")))
    return bars, composition.composition_analysis(cells, reference=reference, test=test)


def module_tables(expr: DataFrame, cells: DataFrame, signatures: DataFrame, reference: str, test: str) -> dict[str, DataFrame]:
    """Module scores with the dominant module, the label profile, mean +- SEM per condition and tests with stars."""
    scores = annotate.gene_set_scores(expr, cells, signatures, min_genes=2)
    tagged = scores.withColumnRenamed("label", "module").join(cells.select(*CELL_KEY, "condition"), CELL_KEY)
    return {
        "dominant": annotate.dominant_module(scores), "profile": annotate.label_profile(scores, cells),
        "bars": annotate.mean_sem(tagged, ["condition", "module"], "score"),
        "tests": annotate.module_tests(scores, cells, reference, test).withColumn("stars", stars(F.col("pval_adj"))),
    }


def partners(expr: DataFrame, cells: DataFrame, gene: str, group: str | None = None, n: int = 20, min_cells: int = 10) -> DataFrame:
    """Genes ranked by |r| with one gene, overall or per group (small groups give NULL and rank last)."""
    from pyspark.sql import Window as W

    r = matrix.gene_correlations(expr, cells, gene, [group] if group else None)
    if group is None:
        r = r.withColumn("r", F.coalesce("r", F.lit(0.0)))
    else:
        r = r.withColumn("r", F.when(F.col("n_cells") >= min_cells, F.col("r")))
    order = W.partitionBy(*([group] if group else [F.lit(0)])).orderBy(F.round(F.abs("r"), 9).desc_nulls_last(), "gene")
    return r.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def axis_violins(table: DataFrame, reference: str, test: str) -> tuple[DataFrame, DataFrame]:
    """Ligand, receptors and ratio index per condition: box summaries and rank tests with stars."""
    long = table.select(*CELL_KEY, "condition", F.expr("stack(4, 'ligand', ligand, 'r1', r1, 'r2', r2, 'index', index) AS (metric, value)"))
    tests = ranks.score_test(long, ["metric"], "condition", "value", test, reference).withColumn("stars", stars(F.col("pval")))
    return summaries.box_summary(long, ["metric", "condition"], "value"), tests


def status_map(table: DataFrame, points: DataFrame) -> DataFrame:
    return points.select(*CELL_KEY, "x", "y").join(table.select(*CELL_KEY, "condition", "status", "index"), CELL_KEY)


def status_shares(table: DataFrame) -> DataFrame:
    return composition.proportions(table, "condition", "status")


def proximity_tables(points: DataFrame, table: DataFrame, reference: str, test: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ligand-receptor distances: density (factor 0.35), boxes and rank tests per receptor."""
    dist = ligand_receptor.receptor_distances(points, table)
    long = dist.select(*CELL_KEY, "condition", F.expr("stack(2, 'r1', dist_r1, 'r2', dist_r2) AS (receptor, dist)")).filter("dist IS NOT NULL")
    return (summaries.density_curve(long, ["receptor", "condition"], "dist", 0.35, upper=1.0), summaries.box_summary(long, ["receptor", "condition"], "dist"),
            ranks.score_test(long, ["receptor"], "condition", "dist", test, reference))


def niche_tables(points: DataFrame, table: DataFrame, reference: str, test: str, k: int = 15) -> tuple[DataFrame, DataFrame]:
    """Niche receptor scores of ligand-positive cells: boxes and the rank test."""
    scores = ligand_receptor.niche_scores(points, table, k).filter("niche_score IS NOT NULL").join(table.select(*CELL_KEY, "condition"), CELL_KEY)
    tagged = scores.withColumn("metric", F.lit("niche"))
    return summaries.box_summary(tagged, ["condition"], "niche_score"), ranks.score_test(tagged, ["metric"], "condition", "niche_score", test, reference)


def domain_overview(domains: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Domain x condition counts with shares, and domain x cell type."""
    tagged = cells.join(domains.withColumnRenamed("label", "domain"), "cell_id")
    return composition.cross_tab(tagged, "domain", "condition"), composition.cross_tab(tagged, "domain", "cell_type")


def domain_points(domains: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells with coordinates and domain, numbered within their domain in id order."""
    from pyspark.sql import Window as W

    tagged = cells.join(domains.withColumnRenamed("label", "domain"), "cell_id")
    return tagged.withColumn("nth", F.row_number().over(W.partitionBy("domain").orderBy(*CELL_KEY)))


def ordered_labels(df: DataFrame, label: str) -> list[Column]:
    return label_order(F.col(label))


def spatial_summary(graph: DataFrame, expr: DataFrame, cells: DataFrame, genes: list[str]) -> tuple[DataFrame, DataFrame]:
    """Moran table and lag co-expression of a gene list on one graph."""
    return spatial.morans_scan(graph, expr, cells), spatial.lag_coexpression(graph, expr, cells, genes)


def ligand_receptor_job(expr: DataFrame, cells: DataFrame, points: DataFrame, axis: ligand_receptor.Axis, reference: str, test: str,
                        threshold: float = 0.0, region: str = "domain") -> dict[str, DataFrame]:
    """All ligand-receptor tables from stored inputs; an absent ligand is an error."""
    if expr.filter(F.col("gene") == axis.ligand).isEmpty():
        raise ValueError(f"ligand {axis.ligand} is not in the expression table")
    table = ligand_receptor.axis_table(expr, cells, axis, threshold)
    return {
        "presence": ligand_receptor.gene_presence(expr, axis), "cells": table,
        "proportions": ligand_receptor.coexpression_proportions(table),
        "regional": ligand_receptor.regional_summary(expr, cells, table, region, axis),
        "niche": ligand_receptor.niche_scores(points, table),
        "distances": ligand_receptor.receptor_distances(points, table),
        "chi2_r1": ligand_receptor.receptor_chi_squared(table, reference, test, "r1_pos"),
        "chi2_r2": ligand_receptor.receptor_chi_squared(table, reference, test, "r2_pos"),
    }
