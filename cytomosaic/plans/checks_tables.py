"""Queries for figure tables and source-level table operators."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..config import StudyConfig
from ..operators import annotate, dge, ligand_receptor, neighbors, normalize, panel, qc, roi, spatial, summaries
from ..sources import demo, manifest, slides, tables
from . import figure_tables as ft
from . import pipelines
from .checks_core import BY_TYPE, DGE_OUT, MARKERS, PAIR, dge_out, rank_cte, t_sql
from .checks_labels import MWU_OUT, SIG, mwu
from .checks_spatial import AXIS, LR, MORAN, NEAR
from .registry import CELLS, COUNTS, DENSE, FEATURES, METRICS, PANEL, POINT_EXPR, POINTS, SIGNATURES, SLIDES, STUDY, enrichment_sql, knn_cte, register

A, B = demo.REFERENCE, demo.TEST


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def study(spark, d):
    return demo.expression(spark, d), demo.cells(spark, d)


def axis(spark, d):
    return ligand_receptor.axis_table(demo.point_expression(spark, d), demo.points(spark, d), AXIS, threshold=0.05)


# ---- source-level table operators --------------------------------------------------------------------------

@register("source_unique_names", FEATURES, sql="""
 , n AS (SELECT slide_id, CAST(substr(gene, 2) AS INTEGER) AS size, 'M'||(CAST(substr(gene, 2) AS INTEGER) % 12) AS name FROM features)
 SELECT slide_id, size, CASE WHEN r > 0 THEN name||'-'||r ELSE name END AS name FROM (
  SELECT *, row_number() OVER (PARTITION BY slide_id, name ORDER BY size) - 1 AS r FROM n)""")
def _(spark, d):
    size = F.substring("gene", 2, 10).cast("int")
    named = demo.features(spark, d).select("slide_id", size.alias("size"), F.concat(F.lit("M"), size % 12).alias("name"))
    return slides.unique_names(named, "name", ["slide_id"], "size")


@register("source_union_conditions", CELLS, COUNTS, sql=f"""
 SELECT condition||'__'||cell_id AS cell_id, gene, cnt AS count FROM counts JOIN cells USING (cell_id) WHERE condition IN ('{A}', '{B}')""")
def _(spark, d):
    counts, cells = demo.counts(spark, d), demo.cells(spark, d)
    part = lambda c: slides.prefix_cells(counts.join(cells.filter(F.col("condition") == c).select("slide_id", "cell_id"), ["slide_id", "cell_id"], "left_semi"), c)
    return slides.union_studies(part(A), part(B)).select("cell_id", "gene", F.col("count").cast("bigint").alias("count"))


@register("source_manifest_summary", SLIDES, sql="""
 SELECT condition, count(*) AS n_slides, count(DISTINCT replicate_id) AS n_replicates, string_agg(slide_id, ',' ORDER BY slide_id) AS slides FROM slides GROUP BY 1""")
def _(spark, d):
    return manifest.summary(demo.slides(spark, d))


@register("source_panel_annotation", FEATURES, PANEL, sql="SELECT slide_id, gene, annotation, ensembl_id FROM features LEFT JOIN panel USING (gene)")
def _(spark, d):
    return demo.features(spark, d).join(demo.panel(spark, d), "gene", "left").select("slide_id", "gene", "annotation", "ensembl_id")


@register("source_cell_alignment", CELLS, sql="""
 SELECT slide_id, CAST(cell_id AS BIGINT) AS cell_idx, cell_id AS barcode, cell_area, 'zero_based' AS strategy, CAST(1 AS DOUBLE) AS matched_share FROM cells""")
def _(spark, d):
    cells = demo.cells(spark, d)
    barcodes = cells.select("slide_id", F.col("cell_id").cast("bigint").alias("cell_idx"), F.col("cell_id").alias("barcode"))
    offered = cells.select("slide_id", F.lit(None).cast("string").alias("cell_key"), (F.col("cell_id").cast("bigint") - 1).alias("row_index"), "cell_area")
    aligned, used = slides.align_cells(barcodes, offered)
    return aligned.join(used, "slide_id").select("slide_id", "cell_idx", "barcode", "cell_area", "strategy", "matched_share")


@register("source_roi_import", POINTS, sql="""
 SELECT slide_id, 'rectangle' AS roi_name, 4 AS n_vertices, round(min(x) + (max(x) - min(x)) * 0.35, 6) AS first_x FROM points GROUP BY slide_id""")
def _(spark, d):
    good, _ = tables.import_rois(tables.export_rois(roi.default_rectangles(demo.points(spark, d))))
    return good.select("slide_id", "roi_name", F.size("vertices").alias("n_vertices"), F.round(F.col("vertices")[0]["x"], 6).alias("first_x"))


@register("source_micro_reference", FEATURES, SIGNATURES, sql="""
 SELECT g.gene, l.label AS cell_type, CASE WHEN s.gene IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS value FROM (SELECT DISTINCT gene FROM features) g
 CROSS JOIN (SELECT DISTINCT label FROM signatures) l LEFT JOIN signatures s ON s.gene = g.gene AND s.label = l.label""")
def _(spark, d):
    return annotate.micro_reference(demo.signatures(spark), demo.features(spark, d))


@register("source_run_summary", CELLS, COUNTS, sql="SELECT 'cells' AS result, count(*) AS n_rows FROM cells UNION ALL SELECT 'counts', count(*) FROM counts")
def _(spark, d):
    return tables.run_summary({"cells": demo.cells(spark, d), "counts": demo.counts(spark, d)})


# ---- figure tables -----------------------------------------------------------------------------------------

@register("table_qc_distributions", CELLS, COUNTS, METRICS, sql="""
 , l AS (SELECT condition, 'total_counts' AS metric, total_counts AS v FROM metrics UNION ALL SELECT condition, 'n_genes', n_genes FROM metrics)
 SELECT condition, metric, count(*) AS n, CAST(min(v) AS DOUBLE) AS p00, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75,
  CAST(max(v) AS DOUBLE) AS p100 FROM l GROUP BY 1, 2""")
def _(spark, d):
    return ft.qc_distributions(qc.cell_metrics(demo.cells(spark, d), demo.counts(spark, d)), ["total_counts", "n_genes"])


@register("table_embedding_points", POINTS, sql="""
 SELECT p.cell_id, p.condition, p.cell_type, round(CAST(embedding[1] AS DOUBLE), 6) AS dim1, round(CAST(embedding[2] AS DOUBLE), 6) AS dim2
 FROM points p JOIN embeddings ON cell_id = CAST(vec_id AS VARCHAR)""")
def _(spark, d):
    out = ft.embedding_points(demo.point_vectors(spark, d), demo.points(spark, d), ["condition", "cell_type"])
    return out.select("cell_id", "condition", "cell_type", *r6("dim1", "dim2"))


@register("table_representative_points", POINTS, sql="""
 SELECT cell_id, cell_type, round(x, 6) AS x, round(y, 6) AS y FROM points WHERE slide_id IN (SELECT min(slide_id) FROM points GROUP BY condition)""")
def _(spark, d):
    return ft.spatial_points(demo.points(spark, d), ["cell_type"], True).select("cell_id", "cell_type", *r6("x", "y"))


@register("table_marker_dots", *STUDY, MARKERS, sql="""
 , top AS (SELECT cell_type AS marker_of, gene FROM sa WHERE rank <= 5 QUALIFY row_number() OVER (PARTITION BY gene ORDER BY cell_type, rank) = 1),
 st AS (SELECT cell_type, gene, avg(v) AS mean, avg(CASE WHEN v > 0 THEN 1.0 ELSE 0 END) AS pct FROM dense GROUP BY 1, 2)
 SELECT cell_type, gene, marker_of, round(mean, 6) AS mean, round(pct, 6) AS pct, round(quantile_cont(mean, 0.95) OVER (), 6) AS colour_limit FROM st JOIN top USING (gene)""")
def _(spark, d):
    return ft.marker_dots(*study(spark, d), "cell_type").select("cell_type", "gene", "marker_of", *r6("mean", "pct", "colour_limit"))


@register("table_deg_heatmap")
def _(spark, d):
    expr, cells = study(spark, d)
    return ft.deg_heatmap(expr, cells, dge.two_condition_dge(expr, cells, A, B), A, B, n_genes=6, n_cells=50, lfc_min=0.05, p_max=0.99)


@register("table_gene_map", POINTS, POINT_EXPR, sql="""
 , l AS (SELECT gene, quantile_cont(lognorm, 0.99) AS lim FROM pexpr GROUP BY gene)
 SELECT p.cell_id, g.gene, round(coalesce(e.lognorm, 0), 6) AS lognorm, round(lim, 6) AS "limit" FROM points p CROSS JOIN (VALUES ('E1'), ('E2')) g(gene)
 LEFT JOIN pexpr e ON e.cell_id = p.cell_id AND e.gene = g.gene LEFT JOIN l ON l.gene = g.gene""")
def _(spark, d):
    return ft.gene_map(demo.point_expression(spark, d), demo.points(spark, d), ["E1", "E2"]).select("cell_id", "gene", *r6("lognorm", "limit"))


@register("table_deg_bubbles", *STUDY, BY_TYPE, sql="""
 , f AS (SELECT *, CASE WHEN abs(log2fc) >= 0.1 AND pval_adj < 0.9 AND log2fc > 0 THEN 'up' WHEN abs(log2fc) >= 0.1 AND pval_adj < 0.9 AND log2fc < 0 THEN 'down' ELSE 'ns' END AS direction FROM dge),
 t AS (SELECT DISTINCT gene FROM (SELECT gene, row_number() OVER (PARTITION BY cell_type, direction ORDER BY CASE WHEN direction = 'up' THEN -log2fc ELSE log2fc END, gene) AS r FROM f WHERE direction <> 'ns') WHERE r <= 3),
 o AS (SELECT gene, row_number() OVER (ORDER BY round(abs(avg(log2fc)), 9) DESC, gene) AS gene_order FROM f WHERE gene IN (SELECT gene FROM t) GROUP BY gene)
 SELECT cell_type, gene, gene_order, round(log2fc, 6) AS log2fc, round(least(-log10(greatest(pval_adj, 1e-300)), 8), 4) AS neg_log10_p, direction FROM f JOIN o USING (gene)""")
def _(spark, d):
    flagged, _ = dge.group_dge(*study(spark, d), A, B, "cell_type", "wilcoxon", lfc_min=0.1, p_max=0.9)
    out = ft.deg_bubbles(flagged, "cell_type", 3)
    return out.select("cell_type", "gene", F.col("gene_order").cast("bigint").alias("gene_order"), *r6("log2fc"), F.round("neg_log10_p", 4).alias("neg_log10_p"), "direction")


@register("table_functional_order", *STUDY, BY_TYPE, sql="""
 , n AS (SELECT * FROM (VALUES ('G1', 'first', 0), ('G2', 'first', 0), ('G9', 'second', 1), ('G8', 'second', 1), ('G30', 'second', 1)) v(gene, functional_group, group_position)),
 m AS (SELECT gene, avg(log2fc) AS log2fc FROM dge GROUP BY gene)
 SELECT gene, functional_group, group_position, round(log2fc, 6) AS log2fc, row_number() OVER (ORDER BY group_position, log2fc DESC, gene) AS position FROM m JOIN n USING (gene)""")
def _(spark, d):
    expr, cells = study(spark, d)
    per_type = dge.two_condition_dge(expr, cells, A, B, group="cell_type")
    order, _, _ = ft.functional_panel(expr, cells, per_type, {"first": ["G1", "G2"], "second": ["G9", "G8", "G30"]})
    return order.select("gene", "functional_group", "group_position", *r6("log2fc"), F.col("position").cast("bigint").alias("position"))


@register("table_gene_focus", *STUDY, "one AS (SELECT * FROM dense WHERE gene = 'G7')", mwu("one", "cell_type", "v"), sql=f"""
 SELECT cell_type, {MWU_OUT}, CASE WHEN pval_adj < 0.001 THEN '***' WHEN pval_adj < 0.01 THEN '**' WHEN pval_adj < 0.05 THEN '*' ELSE 'ns' END AS stars FROM mt""")
def _(spark, d):
    tests, _ = ft.gene_focus(*study(spark, d), "G7", A, B)
    return tests.select("cell_type", "n_test", "n_reference", *r6("u_stat", "z", "pval", "pval_adj"), "stars")


@register("table_composition_bars", CELLS, sql="""
 SELECT replicate_id, cell_type, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY replicate_id), 6) AS share
 FROM (SELECT DISTINCT replicate_id FROM cells) CROSS JOIN (SELECT DISTINCT cell_type FROM cells) LEFT JOIN (SELECT replicate_id, cell_type, count(*) AS n FROM cells GROUP BY 1, 2) USING (replicate_id, cell_type)""")
def _(spark, d):
    bars, _ = ft.composition_forest(demo.cells(spark, d), A, B)
    return bars.select("replicate_id", "cell_type", "n", *r6("share"))


@register("table_module_tests", *SIG, mwu("sc", "label", "score"), sql=f"SELECT label AS module, {MWU_OUT} FROM mt")
def _(spark, d):
    out = ft.module_tables(*study(spark, d), demo.signatures(spark), A, B)["tests"]
    return out.select("module", "n_test", "n_reference", *r6("u_stat", "z", "pval", "pval_adj"))


@register("table_partners_by_condition", *STUDY, sql="""
 , p AS (SELECT a.condition, a.gene, coalesce(corr(a.v, b.v), 0) AS r FROM dense a JOIN dense b ON a.cell_id = b.cell_id AND b.gene = 'G5' WHERE a.gene <> 'G5' GROUP BY 1, 2)
 SELECT condition, gene, round(r, 6) AS r, row_number() OVER (PARTITION BY condition ORDER BY round(abs(r), 9) DESC, gene) AS rank FROM p QUALIFY rank <= 15""")
def _(spark, d):
    out = ft.partners(*study(spark, d), "G5", "condition", 15)
    return out.select("condition", "gene", F.round(F.coalesce("r", F.lit(0.0)), 6).alias("r"), F.col("rank").cast("bigint").alias("rank"))


@register("table_axis_boxes", *LR, sql="""
 , l AS (SELECT condition, unnest(['ligand', 'r1', 'r2', 'index']) AS metric, unnest([ligand, r1, r2, idx]) AS v FROM axis),
 q AS (SELECT metric, condition, count(*) AS n, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q75 FROM l GROUP BY 1, 2)
 SELECT metric, condition, n, round(q25, 6) AS q25, round(median, 6) AS median, round(q75, 6) AS q75, round(min(v) FILTER (v >= q25 - 1.5 * (q75 - q25)), 6) AS whisker_lo,
  round(max(v) FILTER (v <= q75 + 1.5 * (q75 - q25)), 6) AS whisker_hi FROM l JOIN q USING (metric, condition) GROUP BY ALL""")
def _(spark, d):
    boxes, _ = ft.axis_violins(axis(spark, d), "A", "B")
    return boxes.select("metric", "condition", "n", *r6("q25", "median", "q75", "whisker_lo", "whisker_hi"))


@register("table_status_shares", *LR, sql="""
 , s AS (SELECT condition, CASE WHEN lig_pos AND r1_pos THEN 'E1+E2+' WHEN lig_pos AND r2_pos THEN 'E1+E3+' WHEN lig_pos THEN 'E1+only'
  WHEN r1_pos AND r2_pos THEN 'E2+E3+' WHEN r1_pos THEN 'E2+only' WHEN r2_pos THEN 'E3+only' ELSE 'Negative' END AS status FROM axis)
 SELECT condition, status, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY condition), 6) AS pct FROM s GROUP BY 1, 2""")
def _(spark, d):
    return ft.status_shares(axis(spark, d)).select("condition", "status", "n", *r6("pct"))


@register("table_proximity_boxes", *LR, sql=NEAR + """
 , u AS (SELECT condition, 'r1' AS receptor, dist_r1 AS v FROM dd UNION ALL SELECT condition, 'r2', dist_r2 FROM dd),
 q AS (SELECT receptor, condition, count(v) AS n, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q75 FROM u WHERE v IS NOT NULL GROUP BY 1, 2)
 SELECT receptor, condition, n, round(q25, 6) AS q25, round(median, 6) AS median, round(q75, 6) AS q75 FROM q""")
def _(spark, d):
    _, boxes, _ = ft.proximity_tables(demo.points(spark, d), axis(spark, d), "A", "B")
    return boxes.select("receptor", "condition", "n", *r6("q25", "median", "q75"))


@register("table_niche_boxes", *LR, knn_cte(15), sql="""
 , s AS (SELECT a.condition, src, avg(CASE WHEN b.r1_pos OR b.r2_pos THEN 1.0::DOUBLE ELSE 0 END) AS v FROM knn JOIN axis a ON a.cell_id = src AND a.lig_pos JOIN axis b ON b.cell_id = dst GROUP BY 1, 2)
 SELECT condition, count(*) AS n, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q75 FROM s GROUP BY 1""")
def _(spark, d):
    boxes, _ = ft.niche_tables(demo.points(spark, d), axis(spark, d), "A", "B")
    return boxes.select("condition", "n", *r6("q25", "median", "q75"))


@register("table_domain_overview", POINTS, sql="""
 SELECT cell_type AS domain, condition, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY cell_type), 6) AS share_of_a,
  round(count(*) / sum(count(*)) OVER (PARTITION BY condition), 6) AS share_of_b FROM points GROUP BY 1, 2""")
def _(spark, d):
    points = demo.points(spark, d)
    out, _ = ft.domain_overview(points.select("cell_id", F.col("cell_type").alias("label")), points)
    return out.select("domain", "condition", "n", *r6("share_of_a", "share_of_b"))


def moran(spark, d):
    points = demo.points(spark, d)
    return spatial.morans_scan(spatial.spatial_graph(points, 6), demo.point_expression(spark, d), points)


MORAN_OUT = ["morans_i", "expected_i", "z_score", "p_value", "p_adj"]
MORAN_SQL = f"SELECT gene, {', '.join(f'round({c}, 6) AS {c}' for c in MORAN_OUT)} FROM moran"


@register("table_moran_top", *MORAN, sql=f"{MORAN_SQL} WHERE p_value < 0.5 ORDER BY morans_i DESC, gene LIMIT 30")
def _(spark, d):
    return ft.moran_top(moran(spark, d), p_max=0.5).select("gene", *r6(*MORAN_OUT))


@register("moran_search", *MORAN, sql=f"{MORAN_SQL} WHERE p_adj < 0.99 ORDER BY abs(morans_i) DESC, gene LIMIT 25")
def _(spark, d):
    return ft.search_moran(moran(spark, d), 0.99, 25).select("gene", *r6(*MORAN_OUT))


@register("cluster_dge_search", *STUDY, BY_TYPE, sql="""
 SELECT cell_type, gene, round(log2fc, 6) AS log2fc, round(pval_adj, 6) AS pval_adj FROM dge WHERE cell_type = 'BUILDING' AND pval_adj < 0.999
 ORDER BY round(pval_adj, 9), gene LIMIT 15""")
def _(spark, d):
    table = dge.two_condition_dge(*study(spark, d), A, B, group="cell_type")
    found = ft.search_groups(table, "cell_type", "BUILDING", 0.999, 15)
    return found.select("cell_type", "gene", *r6("log2fc", "pval_adj"))


@register("table_domain_points", POINTS, sql="""
 SELECT slide_id, cell_id, condition, round(x, 6) AS x, round(y, 6) AS y, cell_type AS domain, row_number() OVER (PARTITION BY cell_type ORDER BY slide_id, cell_id) AS nth FROM points""")
def _(spark, d):
    points = demo.points(spark, d)
    out = ft.domain_points(points.select("cell_id", F.col("cell_type").alias("label")), points)
    return out.select("slide_id", "cell_id", "condition", *r6("x", "y"), "domain", F.col("nth").cast("bigint").alias("nth"))


@register("table_functional_pivot", *STUDY, BY_TYPE, sql="""
 , g AS (SELECT * FROM dge WHERE gene IN ('G1', 'G2', 'G3')), k AS (SELECT DISTINCT gene FROM g WHERE pval_adj < 0.99), t AS (SELECT DISTINCT cell_type FROM g WHERE pval_adj < 0.99)
 SELECT k.gene, t.cell_type, round(coalesce(avg(g.log2fc), 0), 6) AS mean_log2fc FROM k CROSS JOIN t LEFT JOIN g ON g.gene = k.gene AND g.cell_type = t.cell_type AND g.pval_adj < 0.99 GROUP BY 1, 2""")
def _(spark, d):
    expr, cells = study(spark, d)
    table = dge.two_condition_dge(expr, cells, A, B, group="cell_type")
    _, _, pivot = ft.functional_panel(expr, cells, table, {"one": ["G1", "G2"], "two": ["G3"]}, p_max=0.99)
    return pivot.select("gene", "cell_type", *r6("mean_log2fc"))


@register("table_functional_dots", *STUDY, sql="""
 SELECT condition, cell_type, gene, round(avg(v), 6) AS mean, round(avg(CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS pct FROM dense WHERE gene IN ('G1', 'G2', 'G3') GROUP BY 1, 2, 3""")
def _(spark, d):
    expr, cells = study(spark, d)
    _, dots, _ = ft.functional_panel(expr, cells, dge.two_condition_dge(expr, cells, A, B, group="cell_type"), {"one": ["G1", "G2"], "two": ["G3"]})
    return dots.select("condition", "cell_type", "gene", *r6("mean", "pct"))


@register("ligand_receptor_job", *LR, sql="""
 SELECT condition, count(*) AS n, count(*) FILTER (lig_pos) AS n_ligand, count(*) FILTER (r1_pos) AS n_r1, count(*) FILTER (r2_pos) AS n_r2, round(avg(idx), 6) AS mean_index
 FROM axis GROUP BY 1""")
def _(spark, d):
    points = demo.points(spark, d)
    job = ft.ligand_receptor_job(demo.point_expression(spark, d), points, points, AXIS, "A", "B", threshold=0.05, region="cell_type")
    return job["cells"].groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.count_if("lig_pos").alias("n_ligand"), F.count_if("r1_pos").alias("n_r1"),
                                                 F.count_if("r2_pos").alias("n_r2"), F.round(F.avg("index"), 6).alias("mean_index"))


# ---- the study pipeline's panel stage and dispatch -----------------------------------------------------------------

HARMONISED = """harmonised AS (SELECT gene FROM features LEFT JOIN panel p USING (gene) GROUP BY gene HAVING count(p.ensembl_id) > 0 OR count(DISTINCT slide_id) >= 17),
 hcounts AS (SELECT * FROM counts WHERE gene IN (SELECT gene FROM harmonised)),
 hexpr AS (SELECT slide_id, cell_id, gene, cnt, ln(1 + cnt * 100.0 / sum(cnt) OVER (PARTITION BY cell_id)) AS lognorm FROM hcounts)"""
STUDY_CONFIG = StudyConfig(reference_condition=A, test_condition=B, min_slides=17)


def harmonised(spark, d):
    counts, meta = panel.harmonise(demo.counts(spark, d), demo.features(spark, d), demo.panel(spark, d), demo.slides(spark, d),
                                   STUDY_CONFIG.harmonise_mode, STUDY_CONFIG.min_slides)
    return normalize.lognorm(counts, STUDY_CONFIG.target_sum), counts, meta


@register("study_harmonised_lognorm", COUNTS, FEATURES, PANEL, HARMONISED, sql="SELECT slide_id, cell_id, gene, round(lognorm, 6) AS lognorm FROM hexpr")
def _(spark, d):
    expr, _, _ = harmonised(spark, d)
    return expr.select("slide_id", "cell_id", "gene", *r6("lognorm"))


@register("study_dge_without_structural_zeros", CELLS, COUNTS, FEATURES, PANEL, SLIDES, HARMONISED, """expr AS (
 SELECT * FROM hexpr WHERE gene NOT IN (SELECT gene FROM harmonised h CROSS JOIN slides s WHERE s.condition IN ('AFRICA', 'ASIA')
  AND NOT EXISTS (SELECT 1 FROM features f WHERE f.gene = h.gene AND f.slide_id = s.slide_id)))""",
          "genes AS (SELECT DISTINCT gene FROM expr)", DENSE, rank_cte("", PAIR), sql=f"SELECT {DGE_OUT} FROM dge")
def _(spark, d):
    expr, counts, meta = harmonised(spark, d)
    cells = demo.cells(spark, d)
    config = replace(STUDY_CONFIG, dge_method="wilcoxon")
    return dge_out(pipelines.study_dge(expr, cells, counts, config, meta)["dge"])


@register("study_replicate_check", SLIDES, sql="""
 SELECT condition, count(*) AS n_slides, count(DISTINCT replicate_id) AS n_replicates, least(3, min(count(DISTINCT replicate_id)) OVER ()) AS floor
 FROM slides WHERE condition IN ('AFRICA', 'ASIA') GROUP BY condition""")
def _(spark, d):
    used = demo.slides(spark, d).filter(F.col("condition").isin(A, B))
    manifest.check_replicates(used, {A: 5, B: 5})
    least = pipelines.replicate_floor(demo.cells(spark, d), STUDY_CONFIG, A, B)
    return manifest.summary(used).select("condition", "n_slides", "n_replicates", F.lit(least).cast("bigint").alias("floor"))


@register("dge_dispatch_t_test", *STUDY, rank_cte("", PAIR), sql=t_sql(False))
def _(spark, d):
    return dge.run_dge(*study(spark, d), A, B, "t-test").select("gene", *r6("log2fc", "score", "pval"))


@register("condition_pair", CELLS, sql=f"SELECT min(condition) AS reference, max(condition) AS test FROM cells WHERE {PAIR}")
def _(spark, d):
    pair = dge.pick_conditions(demo.cells(spark, d).filter(F.col("condition").isin(A, B)))
    return demo.cells(spark, d).limit(1).select(F.lit(pair[0]).alias("reference"), F.lit(pair[1]).alias("test"))


@register("table_enrichment_stars", POINTS, knn_cte(10), enrichment_sql(), sql="""
 SELECT type_a, type_b, round(observed, 6) AS observed, round(z_score, 6) AS z_score, round(p_adj, 6) AS p_adj,
  CASE WHEN p_adj < 0.001 THEN '***' WHEN p_adj < 0.01 THEN '**' WHEN p_adj < 0.05 THEN '*' ELSE 'ns' END AS stars FROM enriched""")
def _(spark, d):
    labels = demo.points(spark, d).select("slide_id", "cell_id", F.col("cell_type").alias("label"))
    out = ft.enrichment_cells(spatial.enrichment_test(neighbors.spatial_knn(demo.points(spark, d), 10), labels))
    return out.select("type_a", "type_b", *r6("observed", "z_score", "p_adj"), "stars")


@register("table_display_sample", CELLS, sql="SELECT least(count(*), 1000) AS n, least(count(*), 1000) AS n_distinct FROM cells")
def _(spark, d):
    return summaries.seeded_sample(demo.cells(spark, d), 1000).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cell_id").alias("n_distinct"))
