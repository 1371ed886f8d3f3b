"""Composed analyses: preprocessing, spatial domains, sub-clustering and the two-condition study."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import StudyConfig
from ..operators import annotate, community, composition, descent, dge, embedding, ligand_receptor, neighbors, normalize, panel, qc, spatial, sweeps
from ..operators.matrix import group_gene_stats
from ..schemas import CELL_KEY
from ..session import cut
from ..sources import defaults
from . import figure_tables


@dataclass
class Preprocessed:
    cells: DataFrame
    expr: DataFrame
    scores: DataFrame
    corrected: DataFrame
    graph: DataFrame
    markers: DataFrame
    counts: DataFrame


def expression_graph(vectors: DataFrame, n_neighbors: int, method: str = "descent") -> DataFrame:
    """Fuzzy weighted neighbour graph of an embedding: neighbours by ``descent``, or ``exact``, whose work grows with the block pairs."""
    if method not in ("descent", "exact"):
        raise ValueError(f"unknown neighbour method {method}")
    near = cut((descent.descent_knn if method == "descent" else neighbors.embedding_knn)(vectors, n_neighbors))
    return embedding.fuzzy_weights(near, n_neighbors)


def preprocess(cells: DataFrame, counts: DataFrame, config: StudyConfig = StudyConfig()) -> Preprocessed:
    """QC, normalisation, variable genes, PCA, batch correction, neighbour graph, communities and cluster markers."""
    kept, clean, _ = qc.run_qc(
        cells, counts, config.min_cells_per_gene, stage=True, min_counts=config.min_counts, max_counts=config.max_counts,
        min_genes=config.min_genes, max_genes=config.max_genes, min_cell_area=config.min_cell_area,
        filter_control_probes=config.filter_control_probes, filter_control_codewords=config.filter_control_codewords)
    clean = cut(clean)
    expr = cut(normalize.normalise(clean, kept, config.target_sum, config.normalize_by_cell_area, config.area_stage))
    genes = None
    if config.n_top_genes > 0:
        genes = normalize.variable_genes(expr, kept, config.n_top_genes).filter("highly_variable")
    scores, _, _ = embedding.pca(expr, kept, config.n_pcs, genes)
    scores = cut(scores)
    corrected = embedding.harmony(scores, kept, config.batch_key, config.harmony_max_iter, seed=config.random_state)
    graph = cut(expression_graph(corrected, config.n_neighbors))
    labels = community.detect_communities(graph, config.resolution, config.random_state)
    clustered = cut(kept.join(labels.withColumnRenamed("label", "cluster"), "cell_id", "left"))
    markers = dge.cluster_markers(expr, clustered, "cluster", target_sum=config.target_sum)
    return Preprocessed(clustered, expr, scores, corrected, graph, markers, clean)


def spatial_domains(points: DataFrame, expr: DataFrame, expression: DataFrame, config: StudyConfig = StudyConfig(), with_markers: bool = True):
    """Blend graphs, find domains, absorb fragments, then coherence and domain markers: (labels, coherence, markers)."""
    space = cut(spatial.spatial_graph(points, config.n_spatial_neighbors, config.pool_slides))
    blended = neighbors.blend_graphs(expression, space, config.lambda_spatial)
    raw = community.detect_communities(blended, config.domain_resolution, config.random_state)
    labels = cut(community.refine_domains(raw, space, config.domain_min_cells))
    coherence = sweeps.mean_coherence(space, labels)
    markers = None
    if with_markers:
        tagged = points.join(labels.withColumnRenamed("label", "domain"), "cell_id")
        markers = dge.cluster_markers(expr, tagged, "domain", n_genes=50, min_cells=3, target_sum=config.target_sum)
    return labels, coherence, markers


def subcluster(cells: DataFrame, vectors: DataFrame, expr: DataFrame, cluster: str, target: str, marker_genes: list[str],
               resolution: float = 1.5, n_neighbors: int = 10, min_cells: int = 50, seed: int = 42):
    """Split one cluster: (labels with the parent's name as prefix, mean marker level per part, cells per part and condition)."""
    inside = cut(cells.filter(F.col(cluster) == target))
    n = inside.count()
    if n < min_cells:
        raise ValueError(f"cluster {target} has {n} cells, fewer than {min_cells}")
    part = vectors.join(inside.select(*CELL_KEY), CELL_KEY, "left_semi")
    graph = cut(expression_graph(part, min(n_neighbors, n - 1)))
    found = community.detect_communities(graph, resolution, seed)
    labels = cut(inside.join(found, "cell_id").withColumn("subcluster", F.concat(F.lit(f"{target}_"), F.col("label"))).drop("label"))
    genes = F.array(*[F.lit(g) for g in marker_genes])
    means = group_gene_stats(expr.filter(F.col("gene").isin(marker_genes)), labels, ["subcluster"], "lognorm", genes).select("subcluster", "gene", "mean")
    by_condition = labels.groupBy("subcluster", "condition").agg(F.count(F.lit(1)).alias("n"))
    return labels, means, by_condition


def replicate_floor(cells: DataFrame, config: StudyConfig, reference: str, test: str) -> int:
    """Required consistent replicates, lowered when a condition has fewer than the default."""
    counts = [r.n for r in cells.filter(F.col("condition").isin(reference, test)).groupBy("condition").agg(
        F.countDistinct("replicate_id").alias("n")).collect()]
    return min([config.min_consistent_replicates, *counts])


def study_signatures(spark) -> DataFrame:
    """The default marker sets of the broad cell types."""
    return annotate.signature_table(spark, defaults.BROAD_MARKERS, "broad")


def dge_options(cells: DataFrame, config: StudyConfig) -> dict:
    """Arguments of the configured test."""
    if config.dge_method == "stringent_wilcoxon":
        return {"lfc_min": config.log2fc_threshold, "p_max": config.pval_threshold, "min_pct": config.min_pct, "min_mean": config.min_mean,
                "min_consistent": replicate_floor(cells, config, config.reference_condition, config.test_condition)}
    return {}


def study_dge(expr: DataFrame, cells: DataFrame, counts: DataFrame, config: StudyConfig, meta: DataFrame | None = None) -> dict[str, DataFrame]:
    """Differential expression of the two conditions, overall and per cell type, with its labelled and top genes.

    Genes that are structural zeros on a compared slide (``meta``) are not tested.
    """
    a, b = config.reference_condition, config.test_condition
    if meta is not None:
        pair = cells.filter(F.col("condition").isin(a, b))
        expr, counts = (dge.drop_zero_filled(t, meta, pair, config.zero_fill_scope) for t in (expr, counts))
    options = dge_options(cells, config)
    per_type, summary = dge.group_dge(expr, cells, a, b, "cell_type", config.dge_method, config.dge_min_cells, config.log2fc_threshold, config.pval_threshold,
                                      counts, **{k: v for k, v in options.items() if k not in ("lfc_min", "p_max")})
    overall = dge.run_dge(expr, cells, a, b, config.dge_method, counts=counts, **options)
    return {"dge": overall, "cluster_dge": per_type, "cluster_dge_summary": summary,
            "dge_labelled": dge.volcano_labels(overall, config.n_top_dge_genes, config.log2fc_threshold, config.pval_threshold),
            "cluster_dge_top": dge.top_per_direction(per_type, "cell_type", config.n_top_dge_genes)}


def study_spatial(cells: DataFrame, expr: DataFrame, config: StudyConfig, genes: list[str]) -> dict[str, DataFrame]:
    """Moran scan, lag co-expression of ``genes``, neighbourhood enrichment and the map of the representative slides."""
    graph = cut(spatial.spatial_graph(cells, config.moran_neighbors, config.pool_slides))
    near = cut(neighbors.spatial_knn(cells, config.n_spatial_neighbors, pool_slides=config.pool_slides))
    moran, lag = figure_tables.spatial_summary(graph, expr, cells, genes)
    return {"moran": moran, "lag_coexpression": lag, "moran_top": figure_tables.moran_top(moran),
            "enrichment": spatial.enrichment_test(near, cells.select(*CELL_KEY, F.col("cell_type").alias("label")), config.n_permutations, config.random_state),
            "representative_map": figure_tables.spatial_points(cells, ["cell_type"], True, config.representative_slides or None)}


def two_condition_study(cells: DataFrame, counts: DataFrame, signatures: DataFrame | None, config: StudyConfig, *, features: DataFrame | None = None,
                        panel_genes: DataFrame | None = None, slides: DataFrame | None = None, modules: DataFrame | None = None,
                        axis: ligand_receptor.Axis | None = None, subclusters: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """Annotated cells and the result tables of a two-condition study.

    With ``features``, ``panel_genes`` and ``slides`` the panel stage runs first: genes are harmonised before any total, and
    structural zeros leave the tests. ``signatures`` and ``modules`` default to the built-in marker and module sets. Cells with
    coordinates add the spatial tables; a ligand on the panel adds the ligand-receptor tables; ``subclusters`` names clusters to
    split, with their marker genes.
    """
    spark, meta, result = cells.sparkSession, None, {}
    if panel_genes is not None:
        result["panel_validation"] = panel.validate_panel(features, panel_genes, slides)
        counts, meta = panel.harmonise(counts, features, panel_genes, slides, config.harmonise_mode, config.min_slides)
        counts, meta = cut(counts), cut(meta)
        result["gene_meta"] = meta
    done = preprocess(cells, counts, config)
    names = annotate.label_clusters(done.expr, done.cells, "cluster", signatures if signatures is not None else study_signatures(spark))
    typed = cut(annotate.attach_labels(done.cells, names, "cluster", "cell_type"))
    a, b = config.reference_condition, config.test_condition
    if modules is None:
        modules = annotate.signature_table(spark, defaults.NEUROPEPTIDE_MODULES, "modules")
    result |= {"cells": typed, "cluster_labels": names, "markers": done.markers, **study_dge(done.expr, typed, done.counts, config, meta),
               "composition": composition.composition_analysis(typed, reference=a, test=b),
               "clusters": composition.supplementary_clusters(typed, "cluster", a, b),
               **{f"module_{k}": t for k, t in figure_tables.module_tables(done.expr, typed, modules, a, b).items()}}
    placed = typed.filter("x IS NOT NULL AND y IS NOT NULL") if "x" in typed.columns else None
    axis = axis or ligand_receptor.Axis()
    if placed is not None:
        on_panel = {r.gene for r in done.expr.filter(F.col("gene").isin(axis.genes)).select("gene").distinct().collect()}
        result |= study_spatial(placed, done.expr, config, [g for g in axis.genes if g in on_panel])
        if axis.ligand in on_panel:
            job = figure_tables.ligand_receptor_job(done.expr, typed, placed, axis, a, b, region="cell_type")
            result |= {f"ligand_receptor_{k}": t for k, t in job.items()}
    for target, genes in (subclusters or {}).items():
        labels, means, per_condition = subcluster(typed, done.corrected, done.expr, "cluster", target, genes, seed=config.random_state)
        result |= {f"subcluster_{target}": labels, f"subcluster_{target}_markers": means, f"subcluster_{target}_counts": per_condition}
    if config.run_spatial_domains and placed is not None:
        labels, coherence, domain_markers = spatial_domains(placed, done.expr, done.graph, config)
        result |= {"domains": labels, "domain_coherence": coherence, "domain_markers": domain_markers}
    return result
