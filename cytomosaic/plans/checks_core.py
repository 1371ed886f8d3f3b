"""Queries for quality control, normalisation, rank tests and markers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import dge, matrix, normalize, qc
from ..sources import demo
from .registry import CELLS, COUNTS, EXPR, METRICS, STUDY, bh, p_normal, p_student, register

A, B = demo.REFERENCE, demo.TEST
QC = dict(min_counts=200, max_counts=2000, min_genes=12, max_genes=40, min_cell_area=20.0)


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def study(spark, d):
    return demo.expression(spark, d), demo.cells(spark, d)


# ---- quality control ---------------------------------------------------------------------------------------

@register("qc_cell_metrics", CELLS, COUNTS, METRICS, sql="SELECT slide_id, cell_id, total_counts, n_genes FROM metrics")
def _(spark, d):
    return qc.cell_metrics(demo.cells(spark, d), demo.counts(spark, d)).select("slide_id", "cell_id", "total_counts", "n_genes")


@register("qc_gene_metrics", CELLS, COUNTS, sql="""
 SELECT gene, count(*) AS n_cells, CAST(sum(cnt) AS BIGINT) AS total_counts,
  round(sum(cnt) / (SELECT count(*) FROM cells), 6) AS mean_counts,
  round(100.0 * (1 - count(*) / (SELECT count(*) FROM cells)), 6) AS pct_dropout FROM counts GROUP BY gene""")
def _(spark, d):
    g = qc.gene_metrics(demo.cells(spark, d), demo.counts(spark, d))
    return g.select("gene", "n_cells", "total_counts", *r6("mean_counts", "pct_dropout"))


FLAGS = """flags AS (SELECT *, total_counts BETWEEN 200 AND 2000 AS ok_counts, n_genes BETWEEN 12 AND 40 AS ok_genes,
 (cell_area IS NOT NULL AND cell_area >= 20) AS ok_area, control_probe_counts = 0 AS ok_probe,
 control_codeword_counts = 0 AS ok_codeword FROM metrics),
 passing AS (SELECT * FROM flags WHERE ok_counts AND ok_genes AND ok_area AND ok_probe AND ok_codeword)"""


@register("qc_removal_report", CELLS, COUNTS, METRICS, FLAGS, sql="""
 SELECT condition, count(*) AS n_before, count(*) FILTER (NOT ok_counts) AS removed_counts,
  count(*) FILTER (NOT ok_genes) AS removed_genes, count(*) FILTER (NOT ok_area) AS removed_area,
  count(*) FILTER (NOT ok_probe) AS removed_probe, count(*) FILTER (NOT ok_codeword) AS removed_codeword,
  count(*) FILTER (ok_counts AND ok_genes AND ok_area AND ok_probe AND ok_codeword) AS n_after
 FROM flags GROUP BY condition""")
def _(spark, d):
    flags = qc.qc_flags(qc.cell_metrics(demo.cells(spark, d), demo.counts(spark, d)), **QC)
    return qc.removal_report(flags, ["condition"])


@register("qc_filtered_counts", CELLS, COUNTS, METRICS, FLAGS, sql="""
 SELECT c.slide_id, c.cell_id, c.gene, c.cnt AS count FROM counts c
 WHERE c.cell_id IN (SELECT cell_id FROM passing) AND c.gene IN (
  SELECT gene FROM counts WHERE cell_id IN (SELECT cell_id FROM passing) GROUP BY gene
  HAVING count(*) >= 300)""")
def _(spark, d):
    _, kept, _ = qc.run_qc(demo.cells(spark, d), demo.counts(spark, d), min_cells_per_gene=300, **QC)
    return kept.select("slide_id", "cell_id", "gene", F.col("count").cast("bigint").alias("count"))


@register("qc_distribution_summary", CELLS, COUNTS, METRICS, sql="""
 SELECT condition, count(*) AS n, quantile_cont(total_counts, 0.0) AS total00, quantile_cont(total_counts, 0.25) AS total25,
  quantile_cont(total_counts, 0.5) AS total50, quantile_cont(total_counts, 0.75) AS total75,
  CAST(max(total_counts) AS DOUBLE) AS total100 FROM metrics GROUP BY condition""")
def _(spark, d):
    m = qc.cell_metrics(demo.cells(spark, d), demo.counts(spark, d))
    return qc.percentiles(m, ["condition"], "total_counts", [0.0, 0.25, 0.5, 0.75, 1.0], "total")


@register("cells_overview", CELLS, COUNTS, METRICS, sql="""
 SELECT slide_id, condition, count(*) AS n_cells, quantile_cont(total_counts, 0.5) AS median_counts
 FROM metrics GROUP BY 1, 2""")
def _(spark, d):
    m = qc.cell_metrics(demo.cells(spark, d), demo.counts(spark, d))
    return qc.cells_overview(m, ["slide_id", "condition"])


@register("condition_balance", CELLS, sql="""
 SELECT condition, count(DISTINCT slide_id) AS n_slides, count(*) AS n_cells,
  round(count(*) / (SELECT count(*) FROM cells), 6) AS share FROM cells GROUP BY condition""")
def _(spark, d):
    return qc.condition_balance(demo.cells(spark, d)).withColumn("share", F.round("share", 6))


# ---- normalisation -----------------------------------------------------------------------------------------

@register("normalise_lognorm", CELLS, COUNTS, EXPR, sql="""
 SELECT slide_id, cell_id, gene, cnt AS count, round(lognorm, 6) AS lognorm FROM expr""")
def _(spark, d):
    return demo.expression(spark, d, stage=False).select(
        "slide_id", "cell_id", "gene", F.col("count").cast("bigint").alias("count"), *r6("lognorm"))


AREA = """factor AS (SELECT cell_id, CASE WHEN cell_area > 0 THEN
  (SELECT quantile_cont(cell_area, 0.5) FROM cells WHERE cell_area > 0) / cell_area ELSE 1.0 END AS f FROM cells)"""


@register("normalise_area_after_total", CELLS, COUNTS, AREA, sql="""
 SELECT slide_id, cell_id, gene, round(ln(1 + cnt * 100.0 / sum(cnt) OVER (PARTITION BY cell_id) * f), 6) AS lognorm
 FROM counts JOIN factor USING (cell_id)""")
def _(spark, d):
    out = normalize.normalise(demo.counts(spark, d), demo.cells(spark, d), by_area=True, area_stage="after_total")
    return out.select("slide_id", "cell_id", "gene", *r6("lognorm"))


@register("normalise_area_before_total", CELLS, COUNTS, AREA, sql="""
 SELECT slide_id, cell_id, gene, round(ln(1 + cnt * f * 100.0 / sum(cnt * f) OVER (PARTITION BY cell_id)), 6) AS lognorm
 FROM counts JOIN factor USING (cell_id)""")
def _(spark, d):
    out = normalize.normalise(demo.counts(spark, d), demo.cells(spark, d), by_area=True)
    return out.select("slide_id", "cell_id", "gene", *r6("lognorm"))


@register("integer_counts", CELLS, COUNTS, AREA, sql="""
 SELECT slide_id, cell_id, gene, CAST(round(cnt * f) AS BIGINT) AS count FROM counts JOIN factor USING (cell_id)
 WHERE round(cnt * f) <> 0""")
def _(spark, d):
    scaled = normalize.scale_by_area(demo.counts(spark, d), demo.cells(spark, d)).drop("count")
    out = normalize.integer_counts(scaled, "scaled")
    return out.select("slide_id", "cell_id", "gene", F.col("count").cast("bigint").alias("count"))


HVG = """st AS (SELECT condition, gene, avg(exp(v) - 1) AS mean, var_samp(exp(v) - 1) AS var, max(v) AS top FROM dense GROUP BY 1, 2),
 base AS (SELECT condition, gene, ln(1 + mean) AS lm, ln(var / mean) AS ld FROM st WHERE top > 0),
 binned AS (SELECT *, least(greatest(ceil((lm - min(lm) OVER p) / (max(lm) OVER p - min(lm) OVER p) * 20), 1), 20) AS bin
  FROM base WINDOW p AS (PARTITION BY condition)),
 scored AS (SELECT condition, gene, CASE WHEN count(*) OVER b = 1 THEN 1.0
  ELSE (ld - avg(ld) OVER b) / stddev_samp(ld) OVER b END AS nd FROM binned WINDOW b AS (PARTITION BY condition, bin)),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY round(nd, 9) DESC NULLS LAST, gene) AS rk FROM scored)"""


@register("variable_genes", *STUDY, HVG, sql="""
 , m AS (SELECT gene, count(*) FILTER (rk <= 15) AS n_batches, quantile_cont(rk, 0.5) AS median_rank FROM ranked GROUP BY gene)
 SELECT gene, n_batches, median_rank,
  row_number() OVER (ORDER BY n_batches DESC, median_rank, gene) <= 15 AS highly_variable FROM m""")
def _(spark, d):
    return normalize.variable_genes(*study(spark, d), n_top=15)


@register("variable_genes_from_counts")
def _(spark, d):
    return normalize.variable_genes_from_counts(demo.counts(spark, d), demo.cells(spark, d), n_top=15)


@register("zscore_heatmap", *STUDY, sql="""
 SELECT slide_id, cell_id, gene, round(least(greatest((v - m) / (s + 1e-9), -3), 3), 6) AS z FROM (
  SELECT *, avg(v) OVER (PARTITION BY gene) AS m, stddev_pop(v) OVER (PARTITION BY gene) AS s
  FROM dense WHERE gene IN ('G1', 'G2', 'G3'))""")
def _(spark, d):
    z = normalize.zscore_clipped(*study(spark, d), ["G1", "G2", "G3"])
    return z.select("slide_id", "cell_id", "gene", *r6("z"))


# ---- grouped moments ---------------------------------------------------------------------------------------

@register("group_mean_pct", *STUDY, sql="""
 SELECT cell_type, gene, count(*) AS n_cells, round(avg(v), 6) AS mean, round(avg(CASE WHEN v > 0 THEN 1.0 ELSE 0 END), 6) AS pct,
  round(var_pop(v), 6) AS var_pop FROM dense GROUP BY 1, 2""")
def _(spark, d):
    st = matrix.group_gene_stats(*study(spark, d), ["cell_type"])
    return st.select("cell_type", "gene", "n_cells", *r6("mean", "pct", "var_pop"))


@register("correlation_one_vs_all", *STUDY, sql="""
 , pair AS (SELECT a.gene, a.v AS x, b.v AS y FROM dense a JOIN dense b ON a.cell_id = b.cell_id AND b.gene = 'G1'
  WHERE a.gene <> 'G1')
 SELECT gene, round(coalesce(corr(x, y), 0), 6) AS r,
  row_number() OVER (ORDER BY round(abs(coalesce(corr(x, y), 0)), 9) DESC, gene) AS rank FROM pair GROUP BY gene
 QUALIFY rank <= 20""")
def _(spark, d):
    from pyspark.sql import Window as W

    r = matrix.gene_correlations(*study(spark, d), "G1").withColumn("r", F.coalesce("r", F.lit(0.0)))
    rank = F.row_number().over(W.orderBy(F.round(F.abs("r"), 9).desc(), "gene")).cast("bigint")
    return r.withColumn("rank", rank).filter("rank <= 20").select("gene", *r6("r"), "rank")


@register("correlation_by_group", *STUDY, sql="""
 , pair AS (SELECT a.cell_type, a.gene, a.v AS x, b.v AS y FROM dense a JOIN dense b ON a.cell_id = b.cell_id AND b.gene = 'G1'
  WHERE a.gene <> 'G1')
 SELECT cell_type, gene, count(*) AS n_cells,
  round(CASE WHEN count(*) >= 10 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END, 6) AS r
 FROM pair GROUP BY 1, 2""")
def _(spark, d):
    r = matrix.gene_correlations(*study(spark, d), "G1", ["cell_type"])
    return r.withColumn("r", F.when(F.col("n_cells") >= 10, F.round("r", 6)))


# ---- rank tests --------------------------------------------------------------------------------------------

def rank_cte(keys: str, where: str) -> str:
    part = f"{keys}, gene" if keys else "gene"
    lead = f"{keys}, " if keys else ""
    return f"""pairc AS (SELECT * FROM dense WHERE {where}),
 rk AS (SELECT {lead}gene, condition, v, rank() OVER (PARTITION BY {part} ORDER BY v)
   + (count(*) OVER (PARTITION BY {part}, v) - 1) / 2.0 AS r FROM pairc),
 st AS (SELECT {lead}gene, count(*) AS n, count(*) FILTER (condition = '{A}') AS n_cells_a,
   count(*) FILTER (condition = '{B}') AS n_cells_b,
   avg(v) FILTER (condition = '{A}') AS mean_a, avg(v) FILTER (condition = '{B}') AS mean_b,
   avg(CASE WHEN v > 0 THEN 1.0 ELSE 0 END) FILTER (condition = '{A}') AS pct_a,
   avg(CASE WHEN v > 0 THEN 1.0 ELSE 0 END) FILTER (condition = '{B}') AS pct_b,
   var_samp(v) FILTER (condition = '{A}') AS var_a, var_samp(v) FILTER (condition = '{B}') AS var_b,
   sum(r) FILTER (condition = '{B}') AS rank_sum FROM rk GROUP BY ALL),
 t0 AS (SELECT *, log2((exp(mean_b) - 1 + 1e-9) / (exp(mean_a) - 1 + 1e-9)) AS log2fc,
   (rank_sum - n_cells_b * (n + 1) / 2.0) / sqrt(n_cells_a * n_cells_b * (n + 1) / 12.0) AS score FROM st),
 t1 AS (SELECT *, {p_normal('score')} AS pval FROM t0),
 t2 AS (SELECT *, row_number() OVER ({'PARTITION BY ' + keys if keys else ''} ORDER BY pval) AS rk,
   count(*) OVER ({'PARTITION BY ' + keys if keys else ''}) AS m FROM t1),
 dge AS (SELECT *, {bh('pval', keys)} AS pval_adj FROM t2)"""


PAIR = f"condition IN ('{A}', '{B}')"
DGE_OUT = """gene, round(log2fc, 6) AS log2fc, round(score, 6) AS score, round(pval, 6) AS pval,
 round(pval_adj, 6) AS pval_adj, round(pct_a, 6) AS pct_a, round(pct_b, 6) AS pct_b, n_cells_a, n_cells_b"""


def dge_out(df, *keys):
    return df.select(*keys, "gene", *r6("log2fc", "score", "pval", "pval_adj", "pct_a", "pct_b"), "n_cells_a", "n_cells_b")


@register("dge_wilcoxon", *STUDY, rank_cte("", PAIR), sql=f"SELECT {DGE_OUT} FROM dge")
def _(spark, d):
    return dge_out(dge.two_condition_dge(*study(spark, d), A, B))


def t_sql(over: bool) -> str:
    n1 = "n_cells_b" if over else "n_cells_a"
    return f"""
 , w AS (SELECT *, (mean_b - mean_a) / sqrt(var_a / {n1} + var_b / n_cells_b) AS tt,
   pow(var_a / {n1} + var_b / n_cells_b, 2) / (pow(var_a / {n1}, 2) / ({n1} - 1) + pow(var_b / n_cells_b, 2) / (n_cells_b - 1)) AS dof
   FROM t0)
 SELECT gene, round(log2fc, 6) AS log2fc, round(tt, 6) AS score, round({p_student('tt', 'dof')}, 6) AS pval FROM w"""


@register("dge_t_test", *STUDY, rank_cte("", PAIR), sql=t_sql(False))
def _(spark, d):
    return dge.two_condition_dge(*study(spark, d), A, B, method="t-test").select("gene", *r6("log2fc", "score", "pval"))


@register("dge_t_test_overestimated", *STUDY, rank_cte("", PAIR), sql=t_sql(True))
def _(spark, d):
    out = dge.two_condition_dge(*study(spark, d), A, B, method="t-test_overestim_var")
    return out.select("gene", *r6("log2fc", "score", "pval"))


AGREE = f""", per_rep AS (SELECT gene, condition, replicate_id, avg(v) AS mr FROM pairc GROUP BY ALL),
 agree AS (SELECT gene,
  count(*) FILTER (condition = '{A}' AND sign(mean_b - mr) = sign(mean_b - mean_a)) AS n_consistent_a,
  count(*) FILTER (condition = '{B}' AND sign(mr - mean_a) = sign(mean_b - mean_a)) AS n_consistent_b
  FROM per_rep JOIN st USING (gene) GROUP BY gene),
 staged AS (SELECT *, abs(log2fc) >= 0.01 AS s1, n_consistent_a >= 3 AND n_consistent_b >= 3 AS s2, pval_adj < 0.9 AS s3,
  greatest(pct_a, pct_b) >= 0.1 AS s4, greatest(mean_a, mean_b) >= 0.1 AS s5 FROM dge JOIN agree USING (gene))"""
LOOSE = dict(lfc_min=0.01, p_max=0.9)


@register("dge_stringent", *STUDY, rank_cte("", PAIR), sql=AGREE + f"""
 SELECT {DGE_OUT}, n_consistent_a, n_consistent_b FROM staged WHERE s1 AND s2 AND s3 AND s4 AND s5""")
def _(spark, d):
    out = dge.stringent_dge(*study(spark, d), A, B, **LOOSE)
    return out.select(*dge_out(out).columns[:1], *r6("log2fc", "score", "pval", "pval_adj", "pct_a", "pct_b"),
                      "n_cells_a", "n_cells_b", "n_consistent_a", "n_consistent_b")


@register("dge_stringent_stages", *STUDY, rank_cte("", PAIR), sql=AGREE + """
 SELECT count(*) AS n_tested, count(*) FILTER (s1) AS n_after_lfc, count(*) FILTER (s1 AND s2) AS n_after_replicates,
  count(*) FILTER (s1 AND s2 AND s3) AS n_after_pval, count(*) FILTER (s1 AND s2 AND s3 AND s4) AS n_after_pct,
  count(*) FILTER (s1 AND s2 AND s3 AND s4 AND s5) AS n_after_mean FROM staged""")
def _(spark, d):
    return dge.stage_survivors(dge.stringent_dge(*study(spark, d), A, B, keep_all=True, **LOOSE))


BY_TYPE = rank_cte("cell_type", PAIR)
FLAG = """, flagged AS (SELECT *, CASE WHEN abs(log2fc) >= 0.1 AND pval_adj < 0.9 AND log2fc > 0 THEN 'up'
 WHEN abs(log2fc) >= 0.1 AND pval_adj < 0.9 AND log2fc < 0 THEN 'down' ELSE 'ns' END AS direction FROM dge)"""
FLAGS_AT = dict(lfc_min=0.1, p_max=0.9)


def by_type(spark, d):
    return dge.group_dge(*study(spark, d), A, B, "cell_type", "wilcoxon", **FLAGS_AT)


@register("dge_per_cell_type", *STUDY, BY_TYPE, sql=FLAG + f"SELECT cell_type, {DGE_OUT}, direction, direction <> 'ns' AS significant FROM flagged")
def _(spark, d):
    out, _ = by_type(spark, d)
    return out.select("cell_type", "gene", *r6("log2fc", "score", "pval", "pval_adj", "pct_a", "pct_b"),
                      "n_cells_a", "n_cells_b", "direction", "significant")


@register("dge_group_summary", *STUDY, BY_TYPE, sql=FLAG + """
 SELECT cell_type, count(*) FILTER (direction = 'up') AS n_up, count(*) FILTER (direction = 'down') AS n_down,
  count(*) FILTER (direction <> 'ns') AS n_total, count(*) AS n_genes FROM flagged GROUP BY cell_type""")
def _(spark, d):
    return by_type(spark, d)[1]


@register("dge_top_per_group", *STUDY, BY_TYPE, sql=FLAG + """
 SELECT cell_type, direction, gene, round(log2fc, 6) AS log2fc, row_number() OVER (PARTITION BY cell_type, direction
  ORDER BY CASE WHEN direction = 'up' THEN -log2fc ELSE log2fc END, gene) AS rank FROM flagged WHERE direction <> 'ns'
 QUALIFY rank <= 5""")
def _(spark, d):
    top = dge.top_per_direction(by_type(spark, d)[0], "cell_type", 5)
    return top.select("cell_type", "direction", "gene", *r6("log2fc"), F.col("rank").cast("bigint").alias("rank"))


@register("dge_effect_pivot", *STUDY, BY_TYPE, sql="""
 , hits AS (SELECT gene, cell_type, avg(log2fc) AS f FROM dge WHERE pval_adj < 0.9 GROUP BY 1, 2)
 SELECT g.gene, t.cell_type, round(coalesce(f, 0), 6) AS mean_log2fc FROM (SELECT DISTINCT gene FROM hits) g
  CROSS JOIN (SELECT DISTINCT cell_type FROM dge) t LEFT JOIN hits USING (gene, cell_type)""")
def _(spark, d):
    return dge.effect_pivot(by_type(spark, d)[0], "cell_type", 0.9).select("gene", "cell_type", *r6("mean_log2fc"))


@register("dge_top_overall", *STUDY, rank_cte("", PAIR), sql=FLAG.replace(">=", ">") + """
 SELECT direction, gene, round(log2fc, 6) AS log2fc, row_number() OVER (PARTITION BY direction
  ORDER BY CASE WHEN direction = 'up' THEN -log2fc ELSE log2fc END, gene) AS rank FROM flagged WHERE direction <> 'ns'
 QUALIFY rank <= 10""")
def _(spark, d):
    top = dge.top_half_and_half(dge.two_condition_dge(*study(spark, d), A, B), 20, **FLAGS_AT)
    return top.select("direction", "gene", *r6("log2fc"), F.col("rank").cast("bigint").alias("rank"))


@register("dge_volcano", *STUDY, rank_cte("", PAIR), sql=FLAG.replace(">=", ">") + """
 , v AS (SELECT gene, direction, log2fc, -log10(greatest(pval_adj, 1e-300)) AS nl FROM flagged)
 SELECT gene, direction, round(log2fc, 6) AS log2fc, round(nl, 4) AS neg_log10_p,
  CASE WHEN direction <> 'ns' AND rk <= 5 THEN rk END AS label_rank FROM (
   SELECT *, row_number() OVER (PARTITION BY direction <> 'ns' ORDER BY round(abs(log2fc) * nl, 9) DESC, gene) AS rk FROM v)""")
def _(spark, d):
    v = dge.volcano_labels(dge.two_condition_dge(*study(spark, d), A, B), 5, **FLAGS_AT)
    return v.select("gene", "direction", *r6("log2fc"), F.round("neg_log10_p", 4).alias("neg_log10_p"),
                    F.col("label_rank").cast("bigint").alias("label_rank"))


MARKERS = f"""rk AS (SELECT gene, cell_type, v, rank() OVER (PARTITION BY gene ORDER BY v)
  + (count(*) OVER (PARTITION BY gene, v) - 1) / 2.0 AS r FROM dense),
 per AS (SELECT gene, cell_type, count(*) AS nb, sum(r) AS rs, sum(v) AS s, sum(CASE WHEN v > 0 THEN 1.0 ELSE 0 END) AS nz FROM rk GROUP BY 1, 2),
 tot AS (SELECT *, sum(nb) OVER (PARTITION BY gene) AS n, sum(s) OVER (PARTITION BY gene) AS st, sum(nz) OVER (PARTITION BY gene) AS nzt FROM per),
 sc AS (SELECT gene, cell_type, CAST(nb AS BIGINT) AS n_cells_b, CAST(n - nb AS BIGINT) AS n_cells_a, nz / nb AS pct_b, (nzt - nz) / (n - nb) AS pct_a,
  log2((exp(s / nb) - 1 + 1e-9) / (exp((st - s) / (n - nb)) - 1 + 1e-9)) AS log2fc,
  (rs - nb * (n + 1) / 2.0) / sqrt(nb * (n - nb) * (n + 1) / 12.0) AS score FROM tot),
 sp AS (SELECT *, {p_normal('score')} AS pval FROM sc),
 sr AS (SELECT *, row_number() OVER (PARTITION BY cell_type ORDER BY pval) AS rk, count(*) OVER (PARTITION BY cell_type) AS m FROM sp),
 sa AS (SELECT *, {bh('pval', 'cell_type')} AS pval_adj,
  row_number() OVER (PARTITION BY cell_type ORDER BY round(score, 9) DESC, gene) AS rank FROM sr)"""
MARKER_OUT = """cell_type, rank, gene, round(score, 6) AS score, round(log2fc, 6) AS log2fc, round(pval, 6) AS pval,
 round(pval_adj, 6) AS pval_adj, round(pct_a, 6) AS pct_a, round(pct_b, 6) AS pct_b, n_cells_a, n_cells_b"""


def marker_out(m):
    return m.select("cell_type", F.col("rank").cast("bigint").alias("rank"), "gene",
                    *r6("score", "log2fc", "pval", "pval_adj", "pct_a", "pct_b"), "n_cells_a", "n_cells_b")


@register("markers_vs_rest", *STUDY, MARKERS, sql=f"SELECT {MARKER_OUT} FROM sa WHERE rank <= 25")
def _(spark, d):
    return marker_out(dge.cluster_markers(*study(spark, d), "cell_type", n_genes=25))


@register("markers_top_unique", *STUDY, MARKERS, sql="""
 SELECT cell_type, rank, gene FROM sa WHERE rank <= 5
 QUALIFY row_number() OVER (PARTITION BY gene ORDER BY cell_type, rank) = 1""")
def _(spark, d):
    m = dge.cluster_markers(*study(spark, d), "cell_type", n_genes=25)
    return dge.unique_markers(m, "cell_type", 5).select("cell_type", F.col("rank").cast("bigint").alias("rank"), "gene")


@register("markers_vs_named", *STUDY, """pr AS (SELECT t.cell_type AS cmp, d.* FROM (SELECT DISTINCT cell_type FROM cells WHERE cell_type <> 'BUILDING') t
  JOIN dense d ON d.cell_type = t.cell_type OR d.cell_type = 'BUILDING'),
 rk AS (SELECT cmp, gene, cell_type, v, rank() OVER (PARTITION BY cmp, gene ORDER BY v)
  + (count(*) OVER (PARTITION BY cmp, gene, v) - 1) / 2.0 AS r FROM pr),
 g AS (SELECT cmp, gene, count(*) AS n, count(*) FILTER (cell_type = cmp) AS nb, sum(r) FILTER (cell_type = cmp) AS rs FROM rk GROUP BY 1, 2)""",
          sql="""SELECT cmp AS cell_type, gene, round((rs - nb * (n + 1) / 2.0) / sqrt(nb * (n - nb) * (n + 1) / 12.0), 6) AS score,
  n - nb AS n_cells_a, nb AS n_cells_b FROM g""")
def _(spark, d):
    m = dge.cluster_markers(*study(spark, d), "cell_type", n_genes=None, reference="BUILDING")
    return m.select("cell_type", "gene", *r6("score"), "n_cells_a", "n_cells_b")


@register("markers_t_test", *STUDY, sql="""
 , per AS (SELECT gene, cell_type, count(*) AS nb, sum(v) AS s, sum(v * v) AS q FROM dense GROUP BY 1, 2),
 tot AS (SELECT *, sum(nb) OVER w AS n, sum(s) OVER w AS st, sum(q) OVER w AS qt FROM per WINDOW w AS (PARTITION BY gene)),
 mo AS (SELECT gene, cell_type, nb, n - nb AS na, s / nb AS mb, (st - s) / (n - nb) AS ma,
  (q - s * s / nb) / (nb - 1) AS vb, ((qt - q) - (st - s) * (st - s) / (n - nb)) / (n - nb - 1) AS va FROM tot)
 SELECT cell_type, gene, round((mb - ma) / sqrt(va / na + vb / nb), 6) AS score FROM mo""")
def _(spark, d):
    m = dge.cluster_markers(*study(spark, d), "cell_type", method="t-test", n_genes=None)
    return m.select("cell_type", "gene", *r6("score"))


@register("markers_logreg")
def _(spark, d):
    return dge.logreg_markers(*study(spark, d), "cell_type", n_genes=10)


@register("dge_search_top", *STUDY, rank_cte("", PAIR), sql="""
 SELECT gene, round(pval_adj, 6) AS pval_adj FROM dge WHERE pval_adj < 0.95 ORDER BY round(pval_adj, 9), gene LIMIT 20""")
def _(spark, d):
    out = dge.two_condition_dge(*study(spark, d), A, B)
    return dge.search_results(out, 0.95, 20, [F.round("pval_adj", 9), F.col("gene")]).select("gene", *r6("pval_adj"))


@register("label_sort_and_stars", *STUDY, BY_TYPE, sql="""
 SELECT cell_type, gene, CASE WHEN pval < 0.001 THEN '***' WHEN pval < 0.01 THEN '**' WHEN pval < 0.05 THEN '*' ELSE 'ns' END AS stars,
  round(least(-log10(greatest(pval, 1e-300)), 8), 4) AS capped FROM dge""")
def _(spark, d):
    out, _ = by_type(spark, d)
    return out.select("cell_type", "gene", stats.stars(F.col("pval")).alias("stars"),
                      F.round(F.least(stats.neg_log10(F.col("pval")), F.lit(8.0)), 4).alias("capped"))
