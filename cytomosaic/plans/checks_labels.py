"""Queries for annotation, signatures, composition, summaries and pseudobulk."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import min_max_unit
from ..operators import annotate, composition, pseudobulk, summaries
from ..sources import demo
from .registry import CELLS, COUNTS, FEATURES, SIGNATURES, STUDY, bh, p_normal, p_student, register

A, B = demo.REFERENCE, demo.TEST


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def study(spark, d):
    return demo.expression(spark, d), demo.cells(spark, d)


SPEC = "spec AS (SELECT gene, 1.0::DOUBLE / count(DISTINCT label) AS weight FROM signatures GROUP BY gene)"


@register("specificity_weights", SIGNATURES, SPEC, COUNTS, sql="""
 SELECT gene, round(weight, 6) AS weight FROM spec WHERE gene IN (SELECT gene FROM counts)""")
def _(spark, d):
    on = demo.counts(spark, d).select("gene").distinct()
    return annotate.specificity_weights(demo.signatures(spark).join(on, "gene", "left_semi")).select("gene", *r6("weight"))


@register("tier_weights", SIGNATURES, COUNTS, sql="""
 SELECT gene, round(CAST(max(greatest(0.4, 1 - 0.2 * position)) AS DOUBLE), 6) AS tier FROM signatures WHERE gene IN (SELECT gene FROM counts) GROUP BY gene""")
def _(spark, d):
    on = demo.counts(spark, d).select("gene").distinct()
    return annotate.tier_weights(demo.signatures(spark).join(on, "gene", "left_semi")).select("gene", *r6("tier"))


SCORES = """lev AS (SELECT gene, round(sum(lognorm), 6) AS level FROM expr GROUP BY gene),
 bins AS (SELECT gene, floor(rank() OVER (ORDER BY level) / greatest(round(count(*) OVER () / 24.0), 1)) AS bin FROM lev),
 ctl AS (SELECT label, gene FROM (SELECT t.label, b.gene, row_number() OVER (PARTITION BY t.label, t.bin ORDER BY md5('0:'||b.gene), b.gene) AS r
   FROM (SELECT DISTINCT label, bin FROM signatures JOIN bins USING (gene)) t JOIN bins b USING (bin)
   WHERE (t.label, b.gene) NOT IN (SELECT (label, gene) FROM signatures)) WHERE r <= 2),
 wt AS (SELECT label, gene, 1.0::DOUBLE / count(*) OVER (PARTITION BY label) AS w FROM signatures
   UNION ALL SELECT label, gene, -1.0::DOUBLE / count(*) OVER (PARTITION BY label) FROM ctl),
 sc AS (SELECT d.slide_id, d.cell_id, d.condition, d.cell_type, label, sum(v * w) AS score FROM dense d JOIN wt USING (gene) GROUP BY ALL)"""
SIG = (*STUDY, SIGNATURES, SPEC, SCORES)


def scores(spark, d):
    return annotate.gene_set_scores(*study(spark, d), demo.signatures(spark), min_genes=2, ctrl_size=2)


@register("gene_set_scores", *SIG, sql="SELECT slide_id, cell_id, label, round(score, 6) AS score FROM sc")
def _(spark, d):
    return scores(spark, d).select("slide_id", "cell_id", "label", *r6("score"))


@register("annotate_by_scores", *SIG, sql="""
 , f AS (SELECT label, avg(weight) AS factor FROM signatures JOIN spec USING (gene) GROUP BY label),
 k AS (SELECT slide_id, cell_id, label, score * factor AS s, row_number() OVER (PARTITION BY cell_id ORDER BY round(score * factor, 9) DESC, label) AS r FROM sc JOIN f USING (label))
 SELECT a.slide_id, a.cell_id, CASE WHEN round(a.s - b.s, 9) < 0.05 THEN 'Unknown' ELSE a.label END AS cell_type, round(a.s - b.s, 6) AS confidence
 FROM k a JOIN k b ON a.cell_id = b.cell_id AND a.r = 1 AND b.r = 2""")
def _(spark, d):
    out = annotate.annotate(*study(spark, d), "marker_scoring", demo.signatures(spark), ctrl_size=2)
    return out.select("slide_id", "cell_id", "cell_type", *r6("confidence"))


@register("dominant_module", *SIG, sql="""
 SELECT slide_id, cell_id, CASE WHEN score > 0.05 THEN label ELSE 'unassigned' END AS module, round(score, 6) AS best FROM sc
 QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY round(score, 9) DESC, label) = 1""")
def _(spark, d):
    return annotate.dominant_module(scores(spark, d)).select("slide_id", "cell_id", "module", *r6("best"))


@register("module_profile", *SIG, sql="""
 , m AS (SELECT cell_type, label AS module, avg(score) AS mean_score FROM sc GROUP BY 1, 2)
 SELECT cell_type, module, round(mean_score, 6) AS mean_score, round((mean_score - avg(mean_score) OVER w) / stddev_pop(mean_score) OVER w, 6) AS z FROM m WINDOW w AS (PARTITION BY module)""")
def _(spark, d):
    return annotate.label_profile(scores(spark, d), demo.cells(spark, d)).select("cell_type", "module", *r6("mean_score", "z"))


@register("module_mean_sem", *SIG, sql="""
 SELECT condition, label AS module, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_samp(score) / sqrt(count(*)), 6) AS sem FROM sc GROUP BY 1, 2""")
def _(spark, d):
    tagged = scores(spark, d).withColumnRenamed("label", "module").join(demo.cells(spark, d).select("slide_id", "cell_id", "condition"), ["slide_id", "cell_id"])
    return annotate.mean_sem(tagged, ["condition", "module"], "score").select("condition", "module", "n", *r6("mean", "sem"))


def mwu(source: str, key: str, value: str) -> str:
    return f"""mr AS (SELECT {key}, condition, rank() OVER w + (count(*) OVER (PARTITION BY {key}, round({value}, 12)) - 1) / 2.0 AS r,
  count(*) OVER (PARTITION BY {key}, round({value}, 12)) AS t FROM {source} WHERE condition IN ('{A}', '{B}') WINDOW w AS (PARTITION BY {key} ORDER BY round({value}, 12))),
 mg AS (SELECT {key}, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (condition = '{B}') AS n_test, count(*) FILTER (condition = '{A}') AS n_reference,
  sum(r) FILTER (condition = '{B}') AS rs, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM mr GROUP BY 1),
 mz AS (SELECT *, rs - n_test * (n_test + 1) / 2.0 AS u_stat,
  sign(rs - n_test * (n + 1) / 2.0) * greatest(abs(rs - n_test * (n + 1) / 2.0) - 0.5, 0) / sqrt(n_test * n_reference / 12.0 * (n + 1 - ties / (n * (n - 1)))) AS z FROM mg),
 mp AS (SELECT *, {p_normal('z')} AS pval FROM mz),
 mq AS (SELECT *, row_number() OVER (ORDER BY pval) AS rk, count(*) OVER () AS m FROM mp),
 mt AS (SELECT *, {bh('pval')} AS pval_adj FROM mq)"""


MWU_OUT = "n_test, n_reference, round(u_stat, 6) AS u_stat, round(z, 6) AS z, round(pval, 6) AS pval, round(pval_adj, 6) AS pval_adj"


@register("module_rank_tests", *SIG, mwu("sc", "label", "score"), sql=f"SELECT label AS module, {MWU_OUT} FROM mt")
def _(spark, d):
    out = annotate.module_tests(scores(spark, d), demo.cells(spark, d), A, B)
    return out.select("module", "n_test", "n_reference", *r6("u_stat", "z", "pval", "pval_adj"))


@register("gene_rank_tests_by_type", *STUDY, "one AS (SELECT * FROM dense WHERE gene = 'G4')", mwu("one", "cell_type", "v"), sql=f"""
 SELECT cell_type, {MWU_OUT}, round(log2fc, 6) AS log2fc FROM mt JOIN (SELECT cell_type,
  (avg(v) FILTER (condition = '{B}') - avg(v) FILTER (condition = '{A}')) / ln(2) AS log2fc FROM one GROUP BY 1) USING (cell_type)""")
def _(spark, d):
    out = annotate.gene_by_type_tests(*study(spark, d), "G4", A, B)
    return out.select("cell_type", "n_test", "n_reference", *r6("u_stat", "z", "pval", "pval_adj", "log2fc"))


CLUSTER = """cm AS (SELECT cell_type AS cluster, gene, avg(v) AS mean FROM dense GROUP BY 1, 2),
 cz AS (SELECT *, (mean - avg(mean) OVER w) / (stddev_pop(mean) OVER w + 1e-6) AS z FROM cm WINDOW w AS (PARTITION BY gene)),
 cs AS (SELECT cluster, label, sum(z * weight) AS score FROM cz JOIN signatures USING (gene) JOIN spec USING (gene) GROUP BY 1, 2),
 cr AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(score, 9) DESC, label) AS r FROM cs)"""


def clustered(spark, d):
    expr, cells = study(spark, d)
    return expr, cells.withColumnRenamed("cell_type", "cluster")


@register("label_clusters", *STUDY, SIGNATURES, SPEC, CLUSTER, sql="""
 SELECT cluster, CASE WHEN max(score) >= 0 THEN min_by(label, r) ELSE 'Unknown' END AS cell_type, round(min_by(score, r), 6) AS score,
  string_agg(label, ',' ORDER BY r) AS top3 FROM cr WHERE r <= 3 GROUP BY cluster""")
def _(spark, d):
    return annotate.label_clusters(*clustered(spark, d), "cluster", demo.signatures(spark)).select("cluster", "cell_type", *r6("score"), "top3")


@register("annotated_cells", *STUDY, SIGNATURES, SPEC, CLUSTER, sql="""
 SELECT slide_id, cell_id, CASE WHEN score >= 0 THEN label ELSE 'Unknown' END AS cell_type FROM cells JOIN cr ON cluster = cell_type AND r = 1""")
def _(spark, d):
    expr, cells = clustered(spark, d)
    names = annotate.label_clusters(expr, cells, "cluster", demo.signatures(spark))
    return annotate.attach_labels(cells, names, "cluster", "cell_type").select("slide_id", "cell_id", "cell_type")


@register("annotate_by_correlation", *STUDY, SIGNATURES, SPEC, CLUSTER, sql="""
 , pr AS (SELECT cluster, l.label, corr(mean, CASE WHEN s.gene IS NULL THEN 0.0 ELSE 1.0 END) AS r FROM cm CROSS JOIN (SELECT DISTINCT label FROM signatures) l
  LEFT JOIN signatures s ON s.gene = cm.gene AND s.label = l.label GROUP BY 1, 2)
 SELECT cluster, CASE WHEN r >= 0.05 THEN label ELSE 'Unknown' END AS cell_type, round(r, 6) AS confidence FROM pr
 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round(r, 9) DESC, label) = 1""")
def _(spark, d):
    out = annotate.annotate(*clustered(spark, d), "correlation", demo.signatures(spark), min_r=0.05)
    return out.select("cluster", "cell_type", *r6("confidence"))


RULES = [("first", "G1", 2.5), ("second", "G2", 2.2), ("first", "G3", 1.9), ("third", "G10", 1.5), ("fourth", "X1", 0.5)]
RULE_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{l}', '{g}', {t}::DOUBLE)" for i, (l, g, t) in enumerate(RULES)) + ") r(rule, label, gene, threshold))"


@register("annotate_by_threshold", *STUDY, RULE_SQL, sql="""
 , h AS (SELECT cell_id, rule, label, lognorm FROM expr JOIN rules USING (gene) WHERE lognorm > threshold QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY rule) = 1)
 SELECT c.slide_id, c.cell_id, coalesce(label, 'Unknown') AS cell_type, round(coalesce(lognorm / (max(lognorm) OVER (PARTITION BY rule) + 1e-9), 0), 6) AS confidence
 FROM cells c LEFT JOIN h USING (cell_id)""")
def _(spark, d):
    out = annotate.annotate(*study(spark, d), "threshold", rules=annotate.rule_table(spark, RULES))
    return out.select("slide_id", "cell_id", "cell_type", *r6("confidence"))


@register("annotation_rules_skipped", FEATURES, RULE_SQL, sql="""
 SELECT count(*) AS n_rules, count(*) FILTER (f.gene IS NULL) AS n_skipped, count(*) FILTER (f.gene IS NULL) > 0.5 * count(*) AS doubtful
 FROM rules LEFT JOIN (SELECT DISTINCT gene FROM features) f USING (gene)""")
def _(spark, d):
    return annotate.rules_skipped(annotate.rule_table(spark, RULES), demo.features(spark, d))


# ---- composition -------------------------------------------------------------------------------------------

@register("composition_proportions", CELLS, sql="""
 SELECT condition, cell_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY condition), 6) AS pct FROM cells GROUP BY 1, 2""")
def _(spark, d):
    return composition.proportions(demo.cells(spark, d)).select("condition", "cell_type", "n", *r6("pct"))


COMP = """comp AS (SELECT r.replicate_id, r.condition, r.n_cells, t.cell_type, coalesce(n, 0) AS n
 FROM (SELECT replicate_id, min(condition) AS condition, count(*) AS n_cells FROM cells GROUP BY 1) r CROSS JOIN (SELECT DISTINCT cell_type FROM cells) t
 LEFT JOIN (SELECT replicate_id, cell_type, count(*) AS n FROM cells GROUP BY 1, 2) c USING (replicate_id, cell_type))"""


@register("composition_table", CELLS, COMP, sql="SELECT * FROM comp")
def _(spark, d):
    return composition.composition_table(demo.cells(spark, d))


@register("composition_clr_test", CELLS, COMP, sql=f"""
 , lp AS (SELECT *, ln((n + 0.5) / sum(n + 0.5) OVER (PARTITION BY replicate_id)) AS lp FROM comp WHERE condition IN ('{A}', '{B}')),
 clr AS (SELECT *, lp - avg(lp) OVER (PARTITION BY replicate_id) AS clr FROM lp),
 st AS (SELECT cell_type, avg(clr) FILTER (condition = '{A}') AS ma, avg(clr) FILTER (condition = '{B}') AS mb,
  var_samp(clr) FILTER (condition = '{A}') / count(*) FILTER (condition = '{A}') AS ea, var_samp(clr) FILTER (condition = '{B}') / count(*) FILTER (condition = '{B}') AS eb,
  count(*) FILTER (condition = '{A}') AS na, count(*) FILTER (condition = '{B}') AS nb FROM clr GROUP BY 1),
 t AS (SELECT cell_type, (mb - ma) / ln(2) AS log2fc, (mb - ma) / sqrt(ea + eb) AS t_stat, pow(ea + eb, 2) / (ea * ea / (na - 1) + eb * eb / (nb - 1)) AS dof FROM st),
 p AS (SELECT *, {p_student('t_stat', 'dof')} AS pval FROM t),
 q AS (SELECT *, row_number() OVER (ORDER BY pval) AS rk, count(*) OVER () AS m FROM p)
 SELECT cell_type, round(log2fc, 6) AS log2fc, round(t_stat, 6) AS t_stat, round(dof, 6) AS dof, round(pval, 6) AS pval, round({bh('pval')}, 6) AS pval_adj FROM q""")
def _(spark, d):
    out = composition.composition_analysis(demo.cells(spark, d), reference=A, test=B)
    return out.select("cell_type", *r6("log2fc", "t_stat", "dof", "pval", "pval_adj"))


@register("cross_tab", CELLS, sql="""
 SELECT cell_type, condition, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY cell_type), 6) AS share_of_a,
  round(count(*) / sum(count(*)) OVER (PARTITION BY condition), 6) AS share_of_b FROM cells GROUP BY 1, 2""")
def _(spark, d):
    return composition.cross_tab(demo.cells(spark, d), "cell_type", "condition").select("cell_type", "condition", "n", *r6("share_of_a", "share_of_b"))


@register("supplementary_clusters", CELLS, sql=f"""
 SELECT slide_id AS cluster, cell_type, count(*) AS n_cells_total, count(*) FILTER (condition = '{A}') AS n_reference, count(*) FILTER (condition = '{B}') AS n_test,
  round(100.0 * count(*) / (SELECT count(*) FROM cells), 2) AS pct_total FROM cells GROUP BY 1, 2""")
def _(spark, d):
    cells = demo.cells(spark, d).withColumn("cluster", F.col("slide_id"))
    return composition.supplementary_clusters(cells, "cluster", A, B)


@register("distinct_counts", CELLS, sql="""
 SELECT condition, count(DISTINCT slide_id) AS n_slide_id, count(DISTINCT cell_type) AS n_cell_type FROM cells GROUP BY 1""")
def _(spark, d):
    return composition.distinct_counts(demo.cells(spark, d), "condition", ["slide_id", "cell_type"])


@register("representative_slides", CELLS, sql="""
 SELECT condition, CASE WHEN condition = 'ASIA' THEN 'N12' ELSE min(slide_id) END AS slide_id FROM cells GROUP BY 1""")
def _(spark, d):
    return composition.representative_slides(demo.cells(spark, d), {"ASIA": "N12"})


# ---- summaries ---------------------------------------------------------------------------------------------

@register("colour_limits", *STUDY, sql="""
 SELECT gene, count(*) AS n_positive, round(CASE WHEN count(*) >= 11 THEN quantile_cont(lognorm, 0.99) ELSE 1.0 END, 6) AS "limit" FROM expr WHERE lognorm > 0 GROUP BY gene""")
def _(spark, d):
    return summaries.positive_limit(demo.expression(spark, d), ["gene"], min_positive=11).select("gene", "n_positive", *r6("limit"))


@register("density_curve", *STUDY, sql="""
 , s AS (SELECT condition, count(*) AS n, stddev_samp(v) * 0.3 AS h, quantile_cont(v, 0.99) AS top FROM dense WHERE gene = 'G1' GROUP BY 1),
 g AS (SELECT *, CAST(unnest(range(0, 200)) AS INTEGER) AS point FROM s)
 SELECT g.condition, point, round(any_value(top * point / 199), 6) AS x, round(sum(exp(-0.5 * pow((top * point / 199 - v) / h, 2))) / any_value(n * h * sqrt(2 * pi())), 6) AS density
 FROM g JOIN dense d ON d.condition = g.condition AND d.gene = 'G1' GROUP BY 1, 2""")
def _(spark, d):
    expr, cells = study(spark, d)
    one = cells.join(expr.filter("gene = 'G1'").select("slide_id", "cell_id", F.round("lognorm", 12).alias("v")), ["slide_id", "cell_id"], "left").fillna(0.0, subset=["v"])
    return summaries.density_curve(one, ["condition"], "v").select("condition", "point", *r6("x", "density"))


@register("box_summary", *STUDY, sql="""
 , q AS (SELECT condition, count(*) AS n, quantile_cont(lognorm, 0.25) AS q25, quantile_cont(lognorm, 0.5) AS median, quantile_cont(lognorm, 0.75) AS q75 FROM expr JOIN cells USING (cell_id) GROUP BY 1)
 SELECT condition, any_value(n) AS n, round(any_value(q25), 6) AS q25, round(any_value(median), 6) AS median, round(any_value(q75), 6) AS q75,
  round(min(lognorm) FILTER (lognorm >= q25 - 1.5 * (q75 - q25)), 6) AS whisker_lo, round(max(lognorm) FILTER (lognorm <= q75 + 1.5 * (q75 - q25)), 6) AS whisker_hi
 FROM expr JOIN cells USING (cell_id) JOIN q USING (condition) GROUP BY 1""")
def _(spark, d):
    expr, cells = study(spark, d)
    values = expr.join(cells.select("slide_id", "cell_id", "condition"), ["slide_id", "cell_id"])
    return summaries.box_summary(values, ["condition"], "lognorm").select("condition", "n", *r6("q25", "median", "q75", "whisker_lo", "whisker_hi"))


@register("seeded_sample_sizes", CELLS, sql="SELECT condition, least(count(*), 100) AS n, least(count(*), 100) AS n_distinct FROM cells GROUP BY 1")
def _(spark, d):
    sample = summaries.seeded_sample(demo.cells(spark, d), 100, ["condition"])
    return sample.groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cell_id").alias("n_distinct"))


@register("min_max_scaling", CELLS, COUNTS, sql="""
 , m AS (SELECT gene, CAST(sum(cnt) AS DOUBLE) AS total FROM counts GROUP BY gene)
 SELECT gene, round((total - min(total) OVER ()) / (max(total) OVER () - min(total) OVER ()), 6) AS scaled,
  round(1 - (total - min(total) OVER ()) / (max(total) OVER () - min(total) OVER ()), 6) AS inverted FROM m""")
def _(spark, d):
    totals = demo.counts(spark, d).groupBy("gene").agg(F.sum("count").cast("double").alias("total"))
    return min_max_unit(min_max_unit(totals, "total", "scaled"), "total", "inverted", invert=True).select("gene", *r6("scaled", "inverted"))


# ---- pseudobulk --------------------------------------------------------------------------------------------

@register("pseudobulk_sums", *STUDY, sql="""
 SELECT condition, replicate_id, gene, count(*) AS n_cells, CAST(sum(cnt) AS BIGINT) AS count FROM dense GROUP BY 1, 2, 3""")
def _(spark, d):
    return pseudobulk.pseudobulk_sums(demo.counts(spark, d), demo.cells(spark, d), [])


PB = """pb AS (SELECT condition, replicate_id, gene, count(*) AS n_cells, sum(cnt) AS c FROM dense GROUP BY 1, 2, 3 HAVING count(*) >= 50),
 pk AS (SELECT * FROM pb WHERE gene IN (SELECT gene FROM pb GROUP BY gene HAVING sum(c) >= 10)),
 lg AS (SELECT *, CASE WHEN c > 0 THEN ln(c) END AS l, min(c) OVER (PARTITION BY gene) > 0 AS ok, avg(CASE WHEN c > 0 THEN ln(c) END) OVER (PARTITION BY gene) AS ref FROM pk)"""


@register("pseudobulk_size_factors", *STUDY, PB, sql="""
 SELECT condition, replicate_id, round(exp(quantile_cont(l - ref, 0.5) FILTER (ok)), 6) AS size_factor FROM lg GROUP BY 1, 2""")
def _(spark, d):
    sums = pseudobulk.filter_samples(pseudobulk.pseudobulk_sums(demo.counts(spark, d), demo.cells(spark, d), []), [], 50, 10)
    return pseudobulk.size_factors(sums, [], ["condition", "replicate_id"]).select("condition", "replicate_id", *r6("size_factor"))


@register("pseudobulk_sample_filter", *STUDY, PB, sql="SELECT condition, replicate_id, gene, n_cells, CAST(c AS BIGINT) AS count FROM pk")
def _(spark, d):
    return pseudobulk.filter_samples(pseudobulk.pseudobulk_sums(demo.counts(spark, d), demo.cells(spark, d), []), [], 50, 10)


@register("pseudo_replicate_sizes", CELLS, sql="""
 SELECT condition, CAST(part AS BIGINT) AS part, CAST(floor((part + 1) * n / 3) - floor(part * n / 3) AS BIGINT) AS n FROM (
  SELECT condition, count(*) AS n FROM cells GROUP BY 1) CROSS JOIN (SELECT unnest(range(0, 3)) AS part)""".replace("floor((part + 1) * n / 3) - floor(part * n / 3)", "ceil((part + 1) * n / 3.0) - ceil(part * n / 3.0)"))
def _(spark, d):
    out = pseudobulk.pseudo_replicates(demo.cells(spark, d), 3)
    part = F.element_at(F.split("pseudo_replicate", "_"), -1).cast("bigint")
    return out.groupBy("condition", part.alias("part")).agg(F.count(F.lit(1)).alias("n"))


@register("pseudobulk_dge")
def _(spark, d):
    return pseudobulk.pseudobulk_dge(demo.counts(spark, d), demo.cells(spark, d), A, B)


@register("pseudobulk_dge_per_type")
def _(spark, d):
    return pseudobulk.pseudobulk_dge(demo.counts(spark, d), demo.cells(spark, d), A, B, group="cell_type", min_cells=3,
                                     min_samples=4, min_cells_per_side=5)


@register("pseudobulk_dge_pseudo_replicates")
def _(spark, d):
    return pseudobulk.pseudobulk_dge(demo.counts(spark, d), demo.cells(spark, d), A, B, replicate=None)
