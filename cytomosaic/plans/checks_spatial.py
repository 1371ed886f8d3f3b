"""Queries for neighbour joins, spatial statistics and ligand-receptor operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ligand_receptor as lr
from ..operators import neighbors as nb
from ..operators import roi, spatial
from ..operators.ranks import score_test
from ..session import cut
from ..sources import demo
from .registry import POINT_EXPR, POINTS, bh, enrichment_sql, knn_cte, p_normal, register, symmetric_cte

AXIS = lr.Axis("E1", "E2", "E3")
PAIR_GENES = ["E1", "E2", "E3", "E4", "E5"]


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def labels(spark, d):
    return demo.points(spark, d).select("slide_id", "cell_id", F.col("cell_type").alias("label"))


# ---- neighbour joins ---------------------------------------------------------------------------------------

@register("spatial_knn", POINTS, knn_cte(6), sql="SELECT slide_id, src, dst, round(dist, 6) AS dist, rk AS rank FROM knn")
def _(spark, d):
    return nb.spatial_knn(demo.points(spark, d), 6).select("slide_id", "src", "dst", *r6("dist"), F.col("rank").cast("bigint").alias("rank"))


POOLED = POINTS.replace("points AS (", "pts AS (") + ", points AS (SELECT 'all' AS slide_id, cell_id, x, y FROM pts)"


@register("spatial_knn_pooled", POOLED, knn_cte(6), sql="SELECT src, dst, round(dist, 6) AS dist, rk AS rank FROM knn")
def _(spark, d):
    out = nb.spatial_knn(demo.points(spark, d), 6, pool_slides=True)
    return out.select("src", "dst", *r6("dist"), F.col("rank").cast("bigint").alias("rank"))


@register("spatial_graph", POINTS, knn_cte(6), symmetric_cte(), sql="SELECT src, dst, round(dist, 6) AS dist, 1.0::DOUBLE AS weight FROM graph")
def _(spark, d):
    return spatial.spatial_graph(demo.points(spark, d), 6).select("src", "dst", *r6("dist"), "weight")


@register("graph_row_normalised", POINTS, knn_cte(6), symmetric_cte(), sql="""
 SELECT src, dst, round(1.0 / count(*) OVER (PARTITION BY src), 6) AS weight FROM graph""")
def _(spark, d):
    return nb.row_normalise(spatial.spatial_graph(demo.points(spark, d), 6)).select("src", "dst", *r6("weight"))


EMB = """ek AS (SELECT src, dst, dist, rk FROM (
 SELECT a.vec_id::VARCHAR AS src, b.vec_id::VARCHAR AS dst, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dist,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12), b.vec_id::VARCHAR) AS rk
 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rk <= 12)"""


@register("embedding_knn", EMB, sql="SELECT src, dst, round(dist, 6) AS dist, rk AS rank FROM ek")
def _(spark, d):
    # small blocks so that pruning and block pairs take part even on the sample
    out = nb.embedding_knn(demo.point_vectors(spark, d), 12, block_rows=256)
    return out.select("src", "dst", *r6("dist"), F.col("rank").cast("bigint").alias("rank"))


@register("embedding_knn_approximate", sql="SELECT count(*) AS n_sources, CAST(12 AS BIGINT) AS fewest, CAST(12 AS BIGINT) AS most, true AS recall_reached FROM embeddings")
def _(spark, d):
    vectors = demo.point_vectors(spark, d)
    found = cut(nb.approximate_embedding_knn(vectors, 12, bucket_length=1.0, radius=1.2))
    exact = nb.embedding_knn(vectors, 12).select("src", "dst", F.lit(1).alias("hit"))
    per = found.join(exact, ["src", "dst"], "left").groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits"))
    return per.agg(F.count(F.lit(1)).alias("n_sources"), F.min("n").alias("fewest"), F.max("n").alias("most"),
                   (F.sum("hits") >= 0.9 * F.sum("n")).alias("recall_reached"))


@register("graph_blend", POINTS, knn_cte(15), symmetric_cte(), EMB, sql="""
 , eg AS (SELECT src, dst FROM ek UNION SELECT dst, src FROM ek),
 m AS (SELECT src, dst, 0.7 / count(*) OVER (PARTITION BY src) AS w FROM eg UNION ALL SELECT src, dst, 0.3 / count(*) OVER (PARTITION BY src) FROM graph),
 b AS (SELECT src, dst, w FROM m UNION ALL SELECT dst, src, w FROM m)
 SELECT src, dst, round(sum(w) / 2, 6) AS weight FROM b GROUP BY 1, 2""")
def _(spark, d):
    space = spatial.spatial_graph(demo.points(spark, d), 15)
    expr = nb.symmetrise(nb.embedding_knn(demo.point_vectors(spark, d), 12))
    return nb.blend_graphs(expr, space, 0.3).select("src", "dst", *r6("weight"))


# ---- spatial statistics ------------------------------------------------------------------------------------

PDENSE = """pg AS (SELECT DISTINCT gene FROM pexpr),
 pd AS (SELECT p.slide_id, p.cell_id, p.condition, p.cell_type, g.gene, coalesce(e.lognorm, 0) AS v FROM points p CROSS JOIN pg g LEFT JOIN pexpr e USING (cell_id, gene))"""
WNORM = "wn AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM graph)"
LAGS = "lags AS (SELECT w.src AS cell_id, gene, sum(w.w * v) AS lag FROM wn w JOIN pd ON pd.cell_id = w.dst GROUP BY 1, 2)"


MORAN = (POINTS, POINT_EXPR, knn_cte(6), symmetric_cte(), PDENSE, WNORM, LAGS, f"""mz AS (
 SELECT d.gene, d.v - avg(d.v) OVER (PARTITION BY d.gene) AS z, l.lag - avg(d.v) OVER (PARTITION BY d.gene) AS lz FROM pd d JOIN lags l USING (cell_id, gene)),
 mi AS (SELECT gene, count(*) AS n, sum(z * lz) / sum(z * z) AS morans_i FROM mz GROUP BY gene),
 deg AS (SELECT src, count(*) AS k FROM graph GROUP BY 1),
 ms AS (SELECT sum(k) AS s0, 2.0 * sum(k) AS s1, sum(4.0 * k * k) AS s2 FROM deg),
 mt AS (SELECT gene, morans_i, -1.0::DOUBLE / (n - 1) AS expected_i,
  (morans_i + 1.0 / (n - 1)) / sqrt((n * n * s1 - n * s2 + 3.0 * s0 * s0) / ((n * n - 1.0) * s0 * s0) - 1.0 / ((n - 1.0) * (n - 1))) AS z_score FROM mi, ms),
 mp AS (SELECT *, {p_normal('z_score')} AS p_value FROM mt),
 mq AS (SELECT *, row_number() OVER (ORDER BY p_value) AS rk, count(*) OVER () AS m FROM mp),
 moran AS (SELECT gene, morans_i, expected_i, z_score, p_value, {bh('p_value')} AS p_adj FROM mq)""")


@register("morans_i", *MORAN, sql="""
 SELECT gene, round(morans_i, 6) AS morans_i, round(expected_i, 6) AS expected_i, round(z_score, 6) AS z_score, round(p_value, 6) AS p_value,
  round(p_adj, 6) AS p_adj FROM moran""")
def _(spark, d):
    points = demo.points(spark, d)
    out = spatial.morans_scan(spatial.spatial_graph(points, 6), demo.point_expression(spark, d), points)
    return out.select("gene", *r6("morans_i", "expected_i", "z_score", "p_value", "p_adj"))


@register("neighbour_lag", POINTS, POINT_EXPR, knn_cte(6), symmetric_cte(), PDENSE, WNORM, LAGS, sql="SELECT cell_id, gene, round(lag, 6) AS lag FROM lags WHERE lag > 0")
def _(spark, d):
    graph = nb.row_normalise(spatial.spatial_graph(demo.points(spark, d), 6))
    return spatial.neighbour_lag(graph, demo.point_expression(spark, d)).select("cell_id", "gene", *r6("lag"))


IN5 = "('E1', 'E2', 'E3', 'E4', 'E5')"


@register("lag_coexpression", POINTS, POINT_EXPR, knn_cte(6), symmetric_cte(), PDENSE, WNORM, LAGS, sql=f"""
 , r AS (SELECT a.gene AS ga, l.gene AS gb, corr(a.v, l.lag) AS r FROM pd a JOIN lags l USING (cell_id) WHERE a.gene IN {IN5} AND l.gene IN {IN5} GROUP BY 1, 2)
 SELECT x.ga AS gene_a, x.gb AS gene_b, round(CASE WHEN x.ga = x.gb THEN 1 ELSE (x.r + y.r) / 2 END, 6) AS value
 FROM r x JOIN r y ON x.ga = y.gb AND x.gb = y.ga""")
def _(spark, d):
    points = demo.points(spark, d)
    out = spatial.lag_coexpression(spatial.spatial_graph(points, 6), demo.point_expression(spark, d), points, PAIR_GENES)
    return out.select("gene_a", "gene_b", *r6("value"))


@register("local_coexpression", POINTS, POINT_EXPR, knn_cte(10), PDENSE, sql=f"""
 , c AS (SELECT k.src, a.gene AS gene_a, b.gene AS gene_b, CASE WHEN stddev_pop(a.v) >= 1e-9 AND stddev_pop(b.v) >= 1e-9 THEN corr(a.v, b.v) END AS r
  FROM knn k JOIN pd a ON a.cell_id = k.dst JOIN pd b ON b.cell_id = k.dst
  WHERE a.gene IN {IN5} AND b.gene IN {IN5} AND a.gene <> b.gene GROUP BY 1, 2, 3)
 SELECT gene_a, gene_b, round(coalesce(avg(r), 0), 6) AS value FROM c GROUP BY 1, 2""")
def _(spark, d):
    points = demo.points(spark, d)
    out = spatial.local_coexpression(nb.spatial_knn(points, 10), demo.point_expression(spark, d), points, PAIR_GENES)
    return out.select("gene_a", "gene_b", *r6("value"))


@register("neighbourhood_observed", POINTS, knn_cte(10), sql="""
 , n AS (SELECT a.cell_type AS type_a, b.cell_type AS type_b, count(*) AS n FROM knn JOIN points a ON a.cell_id = src JOIN points b ON b.cell_id = dst GROUP BY 1, 2),
 t AS (SELECT DISTINCT cell_type FROM points)
 SELECT x.cell_type AS type_a, y.cell_type AS type_b, round(coalesce(n / sum(n) OVER (PARTITION BY x.cell_type), 0), 6) AS observed
 FROM t x CROSS JOIN t y LEFT JOIN n ON type_a = x.cell_type AND type_b = y.cell_type""")
def _(spark, d):
    return spatial.observed_enrichment(nb.spatial_knn(demo.points(spark, d), 10), labels(spark, d)).select("type_a", "type_b", *r6("observed"))


SCORES = ["observed", "null_mean", "z_score", "p_value", "p_adj"]


@register("neighbourhood_enrichment", POINTS, knn_cte(10), enrichment_sql(), sql=f"""
 SELECT type_a, type_b, {', '.join(f'round({c}, 6) AS {c}' for c in SCORES)} FROM enriched""")
def _(spark, d):
    return spatial.enrichment_test(nb.spatial_knn(demo.points(spark, d), 10), labels(spark, d)).select("type_a", "type_b", *r6(*SCORES))


@register("spatial_coherence", POINTS, knn_cte(15), sql="""
 SELECT a.cell_id, a.cell_type AS label, round(avg(CASE WHEN a.cell_type = b.cell_type THEN 1.0 ELSE 0 END), 6) AS coherence
 FROM knn JOIN points a ON a.cell_id = src JOIN points b ON b.cell_id = dst GROUP BY 1, 2""")
def _(spark, d):
    out = spatial.label_coherence(nb.spatial_knn(demo.points(spark, d), 15), labels(spark, d))
    return out.select("cell_id", "label", *r6("coherence"))


@register("region_dge", POINTS, POINT_EXPR, PDENSE, sql="""
 , box AS (SELECT * FROM pd JOIN points USING (cell_id) WHERE x BETWEEN -100 AND 200 AND y BETWEEN -150 AND 100),
 r AS (SELECT gene, pd_condition AS condition, v, rank() OVER (PARTITION BY gene ORDER BY v) + (count(*) OVER (PARTITION BY gene, v) - 1) / 2.0 AS r
  FROM (SELECT gene, round(v, 12) AS v, box.condition AS pd_condition FROM box)),
 g AS (SELECT gene, count(*) AS n, count(*) FILTER (condition = 'B') AS nb, sum(r) FILTER (condition = 'B') AS rs FROM r GROUP BY 1)
 SELECT gene, round((rs - nb * (n + 1) / 2.0) / sqrt(nb * (n - nb) * (n + 1) / 12.0), 6) AS score, n - nb AS n_cells_a, nb AS n_cells_b FROM g""")
def _(spark, d):
    out = roi.region_dge(demo.point_expression(spark, d), demo.points(spark, d), (-100, 200, -150, 100), "A", "B", "wilcoxon")
    return out.select("gene", *r6("score"), "n_cells_a", "n_cells_b")


# ---- ligand-receptor ---------------------------------------------------------------------------------------

TABLE = """ax AS (SELECT p.*, coalesce(l, 0) AS ligand, coalesce(a, 0) AS r1, coalesce(b, 0) AS r2 FROM points p LEFT JOIN (
  SELECT cell_id, max(lognorm) FILTER (gene = 'E1') AS l, max(lognorm) FILTER (gene = 'E2') AS a, max(lognorm) FILTER (gene = 'E3') AS b
  FROM pexpr GROUP BY 1) USING (cell_id)),
 axis AS (SELECT *, ligand > 0.05 AS lig_pos, r1 > 0.05 AS r1_pos, r2 > 0.05 AS r2_pos, ligand / (r1 + r2 + 1) AS idx FROM ax)"""
LR = (POINTS, POINT_EXPR, TABLE)


def axis(spark, d):
    return lr.axis_table(demo.point_expression(spark, d), demo.points(spark, d), AXIS, threshold=0.05)


@register("lr_status", *LR, sql="""
 SELECT cell_id, round(idx, 6) AS index, CASE WHEN lig_pos AND r1_pos THEN 'E1+E2+' WHEN lig_pos AND r2_pos THEN 'E1+E3+' WHEN lig_pos THEN 'E1+only'
  WHEN r1_pos AND r2_pos THEN 'E2+E3+' WHEN r1_pos THEN 'E2+only' WHEN r2_pos THEN 'E3+only' ELSE 'Negative' END AS status FROM axis""")
def _(spark, d):
    return axis(spark, d).select("cell_id", *r6("index"), "status")


@register("lr_gene_presence", POINT_EXPR, sql="SELECT gene, gene IN (SELECT gene FROM pexpr) AS present FROM (VALUES ('E1'), ('E2'), ('E3')) t(gene)")
def _(spark, d):
    return lr.gene_presence(demo.point_expression(spark, d), AXIS)


@register("lr_coexpression_proportions", *LR, sql="""
 , c AS (SELECT condition, count(*) FILTER (lig_pos) AS n_ligand_pos, count(*) FILTER (lig_pos AND r1_pos) AS n_ligand_r1, count(*) FILTER (lig_pos AND r2_pos) AS n_ligand_r2,
  count(*) FILTER (lig_pos AND r1_pos AND r2_pos) AS n_both_receptors, count(*) FILTER (lig_pos AND (r1_pos OR r2_pos)) AS n_any_receptor FROM axis GROUP BY 1)
 SELECT *, round(100.0 * n_ligand_r1 / greatest(n_ligand_pos, 1), 6) AS pct_r1, round(100.0 * n_ligand_r2 / greatest(n_ligand_pos, 1), 6) AS pct_r2,
  round(100.0 * n_any_receptor / greatest(n_ligand_pos, 1), 6) AS pct_any_receptor FROM c""")
def _(spark, d):
    out = lr.coexpression_proportions(axis(spark, d))
    return out.select(*[c for c in out.columns if not c.startswith("pct")], *r6("pct_r1", "pct_r2", "pct_any_receptor"))


@register("lr_niche_score", *LR, knn_cte(15), sql="""
 SELECT p.cell_id, round(s, 6) AS niche_score FROM points p LEFT JOIN (
  SELECT src, avg(CASE WHEN b.r1_pos OR b.r2_pos THEN 1.0 ELSE 0 END) AS s FROM knn JOIN axis a ON a.cell_id = src AND a.lig_pos JOIN axis b ON b.cell_id = dst GROUP BY 1) q
 ON q.src = p.cell_id""")
def _(spark, d):
    return lr.niche_scores(demo.points(spark, d), axis(spark, d)).select("cell_id", *r6("niche_score"))


NEAR = """, dd AS (SELECT a.cell_id, a.condition, (SELECT min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))) FROM axis b WHERE b.slide_id = a.slide_id AND b.r1_pos) AS dist_r1,
  (SELECT min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))) FROM axis b WHERE b.slide_id = a.slide_id AND b.r2_pos) AS dist_r2 FROM axis a WHERE a.lig_pos)"""


@register("lr_receptor_distances", *LR, sql=NEAR + " SELECT cell_id, condition, round(dist_r1, 6) AS dist_r1, round(dist_r2, 6) AS dist_r2 FROM dd")
def _(spark, d):
    return lr.receptor_distances(demo.points(spark, d), axis(spark, d)).select("cell_id", "condition", *r6("dist_r1", "dist_r2"))


@register("lr_distance_summary", *LR, sql=NEAR + """
 , u AS (SELECT condition, 'r1' AS receptor, dist_r1 AS dist FROM dd UNION ALL SELECT condition, 'r2', dist_r2 FROM dd)
 SELECT condition, receptor, count(*) AS n, round(avg(dist), 6) AS mean, round(quantile_cont(dist, 0.25), 6) AS q25, round(quantile_cont(dist, 0.5), 6) AS median,
  round(quantile_cont(dist, 0.75), 6) AS q75 FROM u WHERE dist IS NOT NULL GROUP BY 1, 2""")
def _(spark, d):
    out = lr.distance_summary(lr.receptor_distances(demo.points(spark, d), axis(spark, d)))
    return out.select("condition", "receptor", "n", *r6("mean", "q25", "median", "q75"))


@register("lr_regional_summary", *LR, PDENSE, sql="""
 SELECT p.cell_type AS region, p.condition, p.gene, round(avg(v), 6) AS mean_expr, round(100.0 * avg(CASE WHEN v > 0 THEN 1.0 ELSE 0 END), 6) AS pct_expressing,
  count(*) AS n_cells, round(avg(idx), 6) AS index_mean FROM pd p JOIN axis a USING (cell_id) WHERE gene IN ('E1', 'E2', 'E3') GROUP BY 1, 2, 3""")
def _(spark, d):
    out = lr.regional_summary(demo.point_expression(spark, d), demo.points(spark, d), axis(spark, d), "cell_type", AXIS)
    return out.select("region", "condition", "gene", *r6("mean_expr", "pct_expressing"), "n_cells", *r6("index_mean"))


@register("lr_chi_squared", *LR, sql="""
 , t AS (SELECT CAST(count(*) FILTER (condition = 'A' AND r1_pos) AS DOUBLE) AS a, CAST(count(*) FILTER (condition = 'A' AND NOT r1_pos) AS DOUBLE) AS b,
  CAST(count(*) FILTER (condition = 'B' AND r1_pos) AS DOUBLE) AS c, CAST(count(*) FILTER (condition = 'B' AND NOT r1_pos) AS DOUBLE) AS d FROM axis WHERE lig_pos),
 x AS (SELECT *, (a+b+c+d) * pow(greatest(abs(a*d - b*c) - (a+b+c+d) / 2, 0), 2) / ((a+b)*(c+d)*(a+c)*(b+d)) AS chi2 FROM t)
 SELECT a, b, c, d, round(chi2, 6) AS chi2, round(""" + p_normal("sqrt(chi2)") + ", 6) AS pval FROM x")
def _(spark, d):
    return lr.receptor_chi_squared(axis(spark, d), "A", "B", "r1_pos").select("a", "b", "c", "d", *r6("chi2", "pval"))


@register("lr_status_contingency", *LR, sql="""
 , s AS (SELECT condition, CASE WHEN r1_pos THEN 'r1' WHEN r2_pos THEN 'r2' ELSE 'none' END AS status, count(*) AS n FROM axis WHERE lig_pos GROUP BY 1, 2),
 e AS (SELECT n, sum(n) OVER (PARTITION BY condition) * sum(n) OVER (PARTITION BY status) / sum(n) OVER () AS e FROM s)
 SELECT round(sum((n - e) * (n - e) / e), 6) AS chi2, 2.0::DOUBLE AS df, round(exp(-sum((n - e) * (n - e) / e) / 2), 6) AS pval FROM e""")
def _(spark, d):
    t = axis(spark, d).filter("lig_pos").withColumn("s", F.when(F.col("r1_pos"), "r1").when(F.col("r2_pos"), "r2").otherwise("none"))
    counts = t.groupBy("condition", "s").agg(F.count(F.lit(1)).alias("n"))
    return lr.contingency_chi_squared(counts, "condition", "s").select(*r6("chi2"), "df", *r6("pval"))


@register("lr_index_rank_test", *LR, sql=f"""
 , r AS (SELECT condition, rank() OVER (ORDER BY round(idx, 12)) + (count(*) OVER (PARTITION BY round(idx, 12)) - 1) / 2.0 AS r FROM axis),
 g AS (SELECT count(*) AS n, count(*) FILTER (condition = 'B') AS nb, sum(r) FILTER (condition = 'B') AS rs FROM r),
 z AS (SELECT nb AS n_test, n - nb AS n_reference, rs - nb * (nb + 1) / 2.0 AS u_stat, (rs - nb * (n + 1) / 2.0) / sqrt(nb * (n - nb) * (n + 1) / 12.0) AS z FROM g)
 SELECT 'index' AS metric, n_test, n_reference, round(u_stat, 6) AS u_stat, round(z, 6) AS z, round({p_normal('z')}, 6) AS pval FROM z""")
def _(spark, d):
    scores = axis(spark, d).withColumn("metric", F.lit("index"))
    return score_test(scores, ["metric"], "condition", "index", "B", "A").select(
        "metric", "n_test", "n_reference", *r6("u_stat", "z", "pval"))
