"""Queries for panels, feature tables and regions of interest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dge, panel, roi
from ..sources import demo
from .registry import COUNTS, FEATURES, PANEL, POINTS, SIGNATURES, SLIDES, STUDY, register

BASE = (FEATURES, PANEL, SLIDES)
CUSTOM = """custom AS (SELECT DISTINCT slide_id, gene FROM features WHERE gene NOT IN (SELECT gene FROM panel)),
 cc AS (SELECT gene, count(*) AS n_slides, string_agg(slide_id, ',' ORDER BY slide_id) AS slides_present,
  CASE WHEN count(*) = (SELECT count(*) FROM slides) THEN 'shared_all' WHEN count(*) > 1 THEN 'shared_partial' ELSE 'unique' END AS category
  FROM custom GROUP BY gene)"""


def parts(spark, d):
    return demo.features(spark, d), demo.panel(spark, d), demo.slides(spark, d)


@register("panel_validation", *BASE, sql="""
 SELECT s.slide_id, s.condition, coalesce(n_total, 0) AS n_total, coalesce(n_base, 0) AS n_base, coalesce(n_custom, 0) AS n_custom, custom_genes,
  coalesce(n_base_missing, 0) AS n_base_missing, coalesce(missing_genes, '') AS missing_genes, coalesce(n_base_missing, 0) = 0 AS base_complete
 FROM slides s LEFT JOIN (SELECT slide_id, count(*) AS n_total, count(*) FILTER (gene IN (SELECT gene FROM panel)) AS n_base,
   count(*) FILTER (gene NOT IN (SELECT gene FROM panel)) AS n_custom,
   string_agg(gene, ',' ORDER BY gene) FILTER (gene NOT IN (SELECT gene FROM panel)) AS custom_genes FROM features GROUP BY 1) f USING (slide_id)
 LEFT JOIN (SELECT slide_id, count(*) AS n_base_missing, string_agg(gene, ',' ORDER BY gene) AS missing_genes FROM slides CROSS JOIN panel
   WHERE (slide_id, gene) NOT IN (SELECT (slide_id, gene) FROM features) GROUP BY 1) m USING (slide_id)""")
def _(spark, d):
    return panel.validate_panel(*parts(spark, d))


@register("panel_classification", *BASE, sql="""
 SELECT slide_id, gene, CASE WHEN gene IN (SELECT gene FROM panel) THEN 'base' ELSE 'custom' END AS panel_class FROM features""")
def _(spark, d):
    f, p, _ = parts(spark, d)
    return panel.classify(f, p).select("slide_id", "gene", "panel_class")


@register("panel_presence_matrix", *BASE, CUSTOM, sql="""
 SELECT c.gene, c.n_slides, s.slide_id, (s.slide_id, c.gene) IN (SELECT (slide_id, gene) FROM custom) AS present
 FROM cc c CROSS JOIN (SELECT DISTINCT slide_id FROM features) s""")
def _(spark, d):
    f, p, _ = parts(spark, d)
    return panel.presence_matrix(f, p)


@register("panel_custom_gene_counts", *BASE, CUSTOM, sql="SELECT gene, n_slides, slides_present, category FROM cc")
def _(spark, d):
    return panel.custom_gene_counts(*parts(spark, d))


def harmonise_sql(rule: str) -> str:
    return f"""SELECT gene, panel_class, n_slides FROM (SELECT gene, CASE WHEN gene IN (SELECT gene FROM panel) THEN 'base' ELSE 'custom' END AS panel_class,
  count(DISTINCT slide_id) AS n_slides FROM features GROUP BY gene) WHERE {rule}"""


@register("panel_intersection", *BASE, sql=harmonise_sql("panel_class = 'base' AND n_slides = 25"))
def _(spark, d):
    return panel.harmonised_genes(*parts(spark, d), mode="intersection")


@register("panel_partial_union", *BASE, sql=harmonise_sql("panel_class = 'base' OR n_slides >= 17"))
def _(spark, d):
    return panel.harmonised_genes(*parts(spark, d), mode="partial_union", min_slides=17)


@register("panel_union", *BASE, sql=harmonise_sql("true"))
def _(spark, d):
    return panel.harmonised_genes(*parts(spark, d), mode="union")


META = """seen AS (SELECT gene, count(DISTINCT slide_id) AS n_slides, string_agg(DISTINCT slide_id, ',' ORDER BY slide_id) AS slides_present FROM features GROUP BY gene),
 meta AS (SELECT s.slide_id, g.gene, CASE WHEN p.gene IS NOT NULL THEN 'base' WHEN n_slides > 1 THEN 'custom_shared' ELSE 'custom_unique' END AS panel_type,
  n_slides AS n_slides_present, slides_present, (s.slide_id, g.gene) NOT IN (SELECT (slide_id, gene) FROM features) AS zero_filled,
  annotation, ensembl_id, n_probesets FROM seen g CROSS JOIN slides s LEFT JOIN panel p ON p.gene = g.gene
  WHERE p.gene IS NOT NULL OR n_slides >= 17)"""


def meta(spark, d):
    return panel.gene_meta(*parts(spark, d), min_slides=17)


@register("panel_gene_meta", *BASE, META, sql="SELECT * FROM meta")
def _(spark, d):
    return meta(spark, d)


@register("panel_zero_filled_by_type", *BASE, META, sql="""
 SELECT slide_id, panel_type, count(*) FILTER (zero_filled) AS n_zero_filled, count(*) AS n_genes FROM meta GROUP BY 1, 2""")
def _(spark, d):
    return panel.zero_filled_by_type(meta(spark, d))


@register("panel_thresholds", *BASE, CUSTOM, sql="""
 SELECT t AS min_slides, count(*) AS n_kept, round(avg(25 - n_slides), 6) AS mean_zero_filled
 FROM cc JOIN (SELECT CAST(unnest(range(1, 26)) AS INTEGER) AS t) ON n_slides >= t GROUP BY t""")
def _(spark, d):
    return panel.threshold_table(*parts(spark, d)).withColumn("mean_zero_filled", F.round("mean_zero_filled", 6))


@register("panel_report", *BASE, CUSTOM, sql="""
 SELECT slide_id, count(*) FILTER (c.gene IS NULL) AS n_base, count(*) FILTER (category = 'shared_all') AS n_shared_all,
  count(*) FILTER (category = 'shared_partial') AS n_shared_partial, count(*) FILTER (category = 'unique') AS n_unique,
  coalesce(string_agg(f.gene, ',' ORDER BY f.gene) FILTER (category = 'unique'), '') AS unique_genes
 FROM features f LEFT JOIN cc c USING (gene) GROUP BY slide_id""")
def _(spark, d):
    return panel.panel_report(*parts(spark, d))


@register("panel_slide_count_histogram", *BASE, CUSTOM, sql="""
 SELECT n_slides, count(*) AS n_genes, n_slides >= 17 AS kept FROM cc GROUP BY n_slides""")
def _(spark, d):
    return panel.slide_count_histogram(*parts(spark, d), min_slides=17)


@register("zero_filled_gene_exclusion", *STUDY[:3], *BASE, META, sql="""
 SELECT e.slide_id, e.cell_id, e.gene, e.cnt AS count FROM counts e JOIN cells USING (cell_id) WHERE condition IN ('AFRICA', 'ASIA') AND e.gene NOT IN (
  SELECT gene FROM meta WHERE zero_filled AND slide_id IN (SELECT slide_id FROM slides WHERE condition IN ('AFRICA', 'ASIA')))""")
def _(spark, d):
    cells = demo.cells(spark, d).filter(F.col("condition").isin(demo.REFERENCE, demo.TEST))
    kept = dge.drop_zero_filled(demo.counts(spark, d), meta(spark, d), cells)
    inside = kept.join(cells.select("slide_id", "cell_id"), ["slide_id", "cell_id"], "left_semi")
    return inside.select("slide_id", "cell_id", "gene", F.col("count").cast("bigint").alias("count"))


@register("marker_coverage", SIGNATURES, *BASE, sql="""
 SELECT label, gene, position, in_panel, round(CAST(greatest(0.4, 1 - 0.2 * position) AS DOUBLE), 6) AS tier,
  round(avg(CASE WHEN in_panel THEN 1.0 ELSE 0 END) OVER (PARTITION BY label), 6) AS coverage
 FROM (SELECT *, gene IN (SELECT gene FROM features JOIN panel USING (gene) GROUP BY gene HAVING count(*) = 25) AS in_panel FROM signatures)""")
def _(spark, d):
    genes = panel.harmonised_genes(*parts(spark, d), mode="intersection")
    out = panel.marker_coverage(demo.signatures(spark), genes)
    return out.withColumn("tier", F.round("tier", 6)).withColumn("coverage", F.round("coverage", 6))


@register("gene_lookup", FEATURES, sql="""
 SELECT gene, match FROM (SELECT gene, CASE WHEN gene = 'g1' THEN 0 WHEN lower(gene) = 'g1' THEN 1 WHEN starts_with(lower(gene), 'g1') THEN 2
  WHEN contains(lower(gene), 'g1') THEN 3 END AS match FROM (SELECT DISTINCT gene FROM features)) WHERE match IS NOT NULL ORDER BY match, gene LIMIT 8""")
def _(spark, d):
    return panel.find_gene(demo.features(spark, d), "g1", 8)


@register("panel_search", PANEL, sql="SELECT * FROM panel WHERE contains(lower(gene), 'g2')")
def _(spark, d):
    return panel.search_panel(demo.panel(spark, d), "G2")


@register("feature_type_breakdown", FEATURES, sql="SELECT slide_id, feature_type, count(*) AS n_features FROM features GROUP BY 1, 2")
def _(spark, d):
    return panel.feature_breakdown(demo.features(spark, d))


@register("feature_type_filter", COUNTS, FEATURES, sql="""
 SELECT slide_id, cell_id, gene, cnt AS count FROM counts WHERE (slide_id, gene) IN (
  SELECT (slide_id, gene) FROM features WHERE feature_type = 'Gene Expression')""")
def _(spark, d):
    kept = panel.keep_expression_features(demo.counts(spark, d), demo.features(spark, d))
    return kept.select("slide_id", "cell_id", "gene", F.col("count").cast("bigint").alias("count"))


# ---- regions -----------------------------------------------------------------------------------------------

RING = [(-150.0, -150.0), (150.0, -140.0), (160.0, 150.0), (10.5, 20.25), (-140.0, 130.0)]
SIDES = list(zip(RING, RING[1:] + RING[:1]))
HIT = " + ".join(
    f"(CASE WHEN (({ay}) > y) <> (({by}) > y) AND x < (({bx}) - ({ax})) * (y - ({ay})) / (({by}) - ({ay})) + ({ax}) THEN 1 ELSE 0 END)"
    for (ax, ay), (bx, by) in SIDES)
# slide P3 has no region
TAGGED = f"tagged AS (SELECT *, CASE WHEN slide_id = 'P3' THEN NULL ELSE ({HIT}) % 2 = 1 END AS inside FROM points)"


def rois(spark):
    rows = [(s, "ring", [{"x": x, "y": y} for x, y in RING]) for s in ("P0", "P1", "P2")]
    return spark.createDataFrame(rows, "slide_id string, roi_name string, vertices array<struct<x:double,y:double>>")


@register("roi_filter", POINTS, TAGGED, sql="SELECT slide_id, cell_id, CASE WHEN inside THEN 'ring' END AS roi_name FROM tagged WHERE inside IS NULL OR inside")
def _(spark, d):
    return roi.apply_rois(demo.points(spark, d), rois(spark)).select("slide_id", "cell_id", "roi_name")


@register("roi_filter_inverted", POINTS, TAGGED, sql="SELECT slide_id, cell_id FROM tagged WHERE inside IS NULL OR NOT inside")
def _(spark, d):
    return roi.apply_rois(demo.points(spark, d), rois(spark), invert=True).select("slide_id", "cell_id")


@register("roi_yield", POINTS, TAGGED, sql="""
 SELECT slide_id, n_inside, n_total, pct, CASE WHEN n_inside = 0 THEN 'empty' WHEN pct > 60 THEN 'large' ELSE 'ok' END AS flag FROM (
  SELECT slide_id, count(*) FILTER (coalesce(inside, true)) AS n_inside, count(*) AS n_total,
   round(100.0 * count(*) FILTER (coalesce(inside, true)) / count(*), 2) AS pct FROM tagged GROUP BY slide_id)""")
def _(spark, d):
    return roi.yield_summary(demo.points(spark, d), rois(spark))


@register("roi_bounding_box", POINTS, sql="SELECT slide_id, cell_id FROM points WHERE x BETWEEN -50 AND 190 AND y BETWEEN -170 AND 30")
def _(spark, d):
    return roi.bounding_box(demo.points(spark, d), -50, 190, -170, 30).select("slide_id", "cell_id")


@register("roi_default_rectangle", POINTS, sql="""
 SELECT slide_id, round(min(x) + (max(x) - min(x)) * 0.35, 6) AS x_min, round(min(x) + (max(x) - min(x)) * 0.65, 6) AS x_max,
  round(min(y) + (max(y) - min(y)) * 0.55, 6) AS y_min, round(min(y) + (max(y) - min(y)) * 0.80, 6) AS y_max, 4 AS n_vertices
 FROM points GROUP BY slide_id""")
def _(spark, d):
    box = roi.default_rectangles(demo.points(spark, d))
    return box.select("slide_id", *[F.round(c, 6).alias(c) for c in ("x_min", "x_max", "y_min", "y_max")], F.size("vertices").alias("n_vertices"))
