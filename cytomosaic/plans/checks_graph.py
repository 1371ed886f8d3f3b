"""Queries for embeddings, graphs, communities, cluster quality and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import StudyConfig
from ..operators import community, descent, embedding, neighbors, quality, spatial, summaries, sweeps
from ..session import cut
from ..sources import demo
from . import pipelines
from .registry import CELLS, POINTS, STUDY, knn_cte, register, symmetric_cte


# scaled to the weakly structured sample: at the default resolution all of it is one domain, which has no markers
DOMAINS = StudyConfig(domain_resolution=1.2, domain_min_cells=3)


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def study(spark, d):
    return demo.expression(spark, d), demo.cells(spark, d)


def labels(spark, d):
    return demo.points(spark, d).select("cell_id", F.col("cell_type").alias("label"))


def variant_labels(spark, d):
    return labels(spark, d).withColumn("variant", F.lit("given"))


def graph(spark, d, k=10):
    return spatial.spatial_graph(demo.points(spark, d), k)


# ---- embedding ---------------------------------------------------------------------------------------------

@register("pca_scores")
def _(spark, d):
    scores, _, _ = embedding.pca(*study(spark, d), StudyConfig.n_pcs)
    return scores.select("slide_id", "cell_id", *[F.round(F.col("vec")[i], 6).alias(f"pc{i}") for i in range(StudyConfig.n_pcs)])


@register("pca_total_variance", *STUDY, sql="""
 SELECT round(sum(v), 6) AS total_variance FROM (SELECT var_samp(v) AS v FROM dense GROUP BY gene)""")
def _(spark, d):
    _, _, variance = embedding.pca(*study(spark, d), 49)
    # all but one component are kept, so the total follows from any ratio
    return variance.filter("pc = 0").select(F.round(F.col("variance") / F.col("ratio"), 6).alias("total_variance"))


@register("pca_cumulative_variance")
def _(spark, d):
    _, _, variance = embedding.pca(*study(spark, d), StudyConfig.n_pcs)
    return summaries.cumulative_variance(variance)


@register("batch_confounding", CELLS, sql="""
 SELECT count(*) AS n_batches, max(c) AS max_conditions_per_batch, max(c) = 1 AS nested FROM (SELECT slide_id, count(DISTINCT condition) AS c FROM cells GROUP BY 1)""")
def _(spark, d):
    return embedding.confounded(demo.cells(spark, d))


@register("harmony_embedding")
def _(spark, d):
    scores, _, _ = embedding.pca(*study(spark, d), StudyConfig.n_pcs)
    return embedding.harmony(scores, demo.cells(spark, d), StudyConfig.batch_key, StudyConfig.harmony_max_iter, seed=StudyConfig.random_state)


@register("fuzzy_neighbour_weights")
def _(spark, d):
    return pipelines.expression_graph(demo.point_vectors(spark, d), 12)


@register("embedding_knn_descent", sql="SELECT count(*) AS n_cells, 10 * count(*) AS n_edges, true AS recall_of_95_percent FROM embeddings")
def _(spark, d):
    vectors = demo.point_vectors(spark, d)
    # blocks far smaller than the table, so that the rounds do the work
    found = cut(descent.descent_knn(vectors, 10, block_rows=128))
    return descent.recall(found, neighbors.embedding_knn(vectors, 10)).select("n_cells", "n_edges", (F.col("recall") >= 0.95).alias("recall_of_95_percent"))


# ---- communities and quality -------------------------------------------------------------------------------

@register("communities")
def _(spark, d):
    return community.detect_communities(pipelines.expression_graph(demo.point_vectors(spark, d), 12), 0.6)


@register("modularity_given_labels", POINTS, knn_cte(10), symmetric_cte(), sql="""
 , e AS (SELECT a.cell_type AS la, b.cell_type AS lb FROM graph JOIN points a ON a.cell_id = src JOIN points b ON b.cell_id = dst),
 p AS (SELECT la, count(*) AS tot, count(*) FILTER (la = lb) AS inside FROM e GROUP BY la)
 SELECT count(*) AS n_labels, round(sum(inside) / sum(tot) - sum(CAST(tot AS DOUBLE) * tot) / pow(sum(tot), 2), 6) AS modularity FROM p""")
def _(spark, d):
    return community.modularity(graph(spark, d), labels(spark, d)).select("n_labels", *r6("modularity"))


@register("silhouette_given_labels", """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)""", sql="""
 , d AS (SELECT a.vec_id, a.label AS la, b.label AS lb, sum(list_distance(a.e, b.e)) AS s, count(*) AS n FROM v a JOIN v b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
 p AS (SELECT vec_id, max(s / n) FILTER (la = lb) AS a, min(s / n) FILTER (la <> lb) AS b FROM d GROUP BY 1)
 SELECT 'given' AS variant, round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM p""")
def _(spark, d):
    return quality.silhouette(demo.point_vectors(spark, d), variant_labels(spark, d)).select("variant", *r6("silhouette"))


@register("scatter_given_labels", """v AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i))""", sql="""
 , c AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM v GROUP BY 1, 2),
 g AS (SELECT i, avg(x) AS m FROM v GROUP BY 1),
 b AS (SELECT sum(c.n * pow(c.m - g.m, 2)) AS b FROM c JOIN g USING (i)),
 r AS (SELECT v.label, v.vec_id, sum(pow(x - m, 2)) AS d2 FROM v JOIN c USING (label, i) GROUP BY 1, 2),
 w AS (SELECT sum(d2) AS w, count(*) AS n, count(DISTINCT label) AS k FROM r),
 s AS (SELECT label, avg(sqrt(d2)) AS s FROM r GROUP BY 1),
 m AS (SELECT a.label AS la, z.label AS lz, sqrt(sum(pow(a.m - z.m, 2))) AS d FROM c a JOIN c z ON a.i = z.i AND a.label <> z.label GROUP BY 1, 2),
 db AS (SELECT la, max((p.s + q.s) / d) AS worst FROM m JOIN s p ON p.label = la JOIN s q ON q.label = lz GROUP BY 1)
 SELECT 'given' AS variant, round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz, round((SELECT avg(worst) FROM db), 6) AS davies_bouldin FROM b, w""")
def _(spark, d):
    return quality.scatter_indices(demo.point_vectors(spark, d), variant_labels(spark, d)).select("variant", *r6("calinski_harabasz", "davies_bouldin"))


@register("resolution_sweep")
def _(spark, d):
    g = cut(pipelines.expression_graph(demo.point_vectors(spark, d), 12))
    near = cut(neighbors.spatial_knn(demo.points(spark, d), 15))
    metrics, _ = sweeps.resolution_sweep(g, demo.point_vectors(spark, d), near)
    return metrics


@register("cluster_lineage")
def _(spark, d):
    g = cut(pipelines.expression_graph(demo.point_vectors(spark, d), 12))
    names = community.lineage_levels([f"{0.1 * i:.2f}" for i in range(1, 21)])
    variants = spark.createDataFrame([(n, float(n)) for n in names], "variant string, gamma double")
    return community.lineage(cut(community.communities(g, variants)), names)


@register("lineage_given_labels", POINTS, sql="""
 , a AS (SELECT cell_id, cell_type AS parent, slide_id AS child FROM points)
 SELECT 'type' AS variant, 'slide' AS next, parent, child, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY parent), 6) AS share_of_parent,
  round(count(*) / sum(count(*)) OVER (PARTITION BY child), 6) AS share_of_child FROM a GROUP BY parent, child""")
def _(spark, d):
    p = demo.points(spark, d)
    both = p.select("cell_id", F.expr("stack(2, 'type', cell_type, 'slide', slide_id) AS (variant, label)"))
    return community.lineage(both, ["type", "slide"]).select("variant", "next", "parent", "child", "n", *r6("share_of_parent", "share_of_child"))


@register("lambda_sweep")
def _(spark, d):
    expr = cut(pipelines.expression_graph(demo.point_vectors(spark, d), 12))
    space = cut(graph(spark, d, 15))
    return sweeps.lambda_sweep(expr, space, demo.point_vectors(spark, d))[0]


COMPONENTS = """same AS (SELECT g.src, g.dst FROM graph g JOIN points a ON a.cell_id = g.src JOIN points b ON b.cell_id = g.dst WHERE a.cell_type = b.cell_type),
 reach AS (SELECT cell_id, cell_id AS other FROM points UNION SELECT r.cell_id, s.dst FROM reach r JOIN same s ON s.src = r.other),
 comp AS (SELECT cell_id, min(other) AS component FROM reach GROUP BY 1)"""


@register("domain_components", POINTS, knn_cte(10), symmetric_cte(), COMPONENTS, sql="SELECT cell_id, component FROM comp")
def _(spark, d):
    g, l = cut(graph(spark, d)), labels(spark, d)
    a, b = (l.select(F.col("cell_id").alias(s), F.col("label").alias(f"l{s}")) for s in ("src", "dst"))
    inside = g.join(a, "src").join(b, "dst").filter("lsrc = ldst")
    return community.connected_components(inside, l)


@register("domain_refinement", POINTS, knn_cte(10), symmetric_cte(), COMPONENTS, sql="""
 , small AS (SELECT cell_id FROM comp WHERE component IN (SELECT component FROM comp GROUP BY 1 HAVING count(*) < 5)),
 votes AS (SELECT a.cell_id, b.cell_type, count(*) AS n FROM graph JOIN points a ON a.cell_id = src JOIN points b ON b.cell_id = dst
  WHERE a.cell_type <> b.cell_type AND a.cell_id IN (SELECT cell_id FROM small) GROUP BY 1, 2),
 pick AS (SELECT cell_id, cell_type FROM votes QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY n DESC, cell_type) = 1)
 SELECT p.cell_id, coalesce(k.cell_type, p.cell_type) AS label FROM points p LEFT JOIN pick k USING (cell_id)""")
def _(spark, d):
    return community.refine_domains(labels(spark, d), graph(spark, d), 5)


@register("spatial_domains")
def _(spark, d):
    expr = pipelines.expression_graph(demo.point_vectors(spark, d), 12)
    found, _, _ = pipelines.spatial_domains(demo.points(spark, d), demo.point_expression(spark, d), cut(expr), DOMAINS, with_markers=False)
    return found


@register("domain_markers")
def _(spark, d):
    expr = pipelines.expression_graph(demo.point_vectors(spark, d), 12)
    return pipelines.spatial_domains(demo.points(spark, d), demo.point_expression(spark, d), cut(expr), DOMAINS)[2]


@register("subcluster_counts")
def _(spark, d):
    points = demo.points(spark, d)
    biggest = points.groupBy("slide_id").count().orderBy(F.desc("count"), "slide_id").first()[0]
    return pipelines.subcluster(points, demo.point_vectors(spark, d), demo.point_expression(spark, d), "slide_id", biggest, ["E1", "E2"])[2]


@register("preprocessing_pipeline")
def _(spark, d):
    config = StudyConfig(min_counts=200, max_counts=2000, min_genes=12, max_genes=40)
    done = pipelines.preprocess(demo.cells(spark, d), demo.counts(spark, d), config)
    return done.cells.select("slide_id", "cell_id", "cluster")
