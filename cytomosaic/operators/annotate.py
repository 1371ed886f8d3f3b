"""Cell-type annotation and signature scores. Signatures, rules and profiles are ordinary DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import bh_adjust
from ..schemas import CELL_KEY
from .matrix import distinct_values, group_gene_stats
from .ranks import score_test

UNKNOWN = "Unknown"


def signature_table(spark, markers: dict[str, list[str]], set_name: str = "markers") -> DataFrame:
    """label -> ordered genes as rows; the listing order of labels decides ties."""
    rows = [(set_name, label, order, gene, i) for order, (label, genes) in enumerate(markers.items()) for i, gene in enumerate(genes)]
    return spark.createDataFrame(rows, "set_name string, label string, label_order int, gene string, position int")


def specificity_weights(signatures: DataFrame) -> DataFrame:
    """1 / number of lists that contain the gene."""
    return signatures.groupBy("gene").agg((1.0 / F.countDistinct("label")).alias("weight"))


def tier_weights(signatures: DataFrame, floor: float = 0.4, step: float = 0.2) -> DataFrame:
    """Earlier positions weigh more; a gene on several lists keeps its best tier."""
    return signatures.groupBy("gene").agg(F.max(F.greatest(F.lit(floor), 1.0 - step * F.col("position"))).alias("tier"))


def control_genes(expr: DataFrame, signatures: DataFrame, ctrl_size: int, n_bins: int = 25, seed: int = 0) -> DataFrame:
    """Control genes per label: from each expression bin the set touches, the first ``ctrl_size`` others in hash order.

    Gene totals rank like gene means, so no cell count is needed. All tables here are panel-sized.
    """
    means = expr.groupBy("gene").agg(F.round(F.sum("lognorm"), 6).alias("level"))
    size = F.greatest(F.round(F.count(F.lit(1)).over(W.partitionBy()) / (n_bins - 1)), F.lit(1.0))
    binned = means.withColumn("bin", F.floor(F.rank().over(W.orderBy("level")) / size))
    held = signatures.select("label", "gene").distinct()
    touched = held.join(binned.select("gene", "bin"), "gene").select("label", "bin").distinct()
    pool = touched.join(binned.select("gene", "bin"), "bin").join(held, ["label", "gene"], "left_anti")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("gene")))
    rank = F.row_number().over(W.partitionBy("label", "bin").orderBy(order, "gene"))
    return pool.withColumn("_r", rank).filter(F.col("_r") <= ctrl_size).select("label", "gene").distinct()


def gene_set_scores(expr: DataFrame, cells: DataFrame, signatures: DataFrame, min_genes: int = 1,
                    ctrl_size: int | None = None, seed: int = 0) -> DataFrame:
    """Mean of the set minus mean of its controls for every (cell, label) as one weighted sum over non-zeros."""
    present = signatures.join(expr.select("gene").distinct(), "gene", "left_semi").select("label", "gene").distinct()
    enough = present.groupBy("label").agg(F.count(F.lit(1)).alias("n_set")).filter(F.col("n_set") >= min_genes)
    used = present.join(enough, "label")
    if ctrl_size is None:
        ctrl_size = max(1, min(50, expr.select("gene").distinct().count() // 25))
    controls = control_genes(expr, used, ctrl_size, seed=seed)
    n_ctrl = controls.groupBy("label").agg(F.count(F.lit(1)).alias("n_ctrl"))
    weights = used.select("label", "gene", (1.0 / F.col("n_set")).alias("w")).unionByName(
        controls.join(n_ctrl, "label").select("label", "gene", (-1.0 / F.col("n_ctrl")).alias("w")))
    summed = expr.select(*CELL_KEY, "gene", "lognorm").join(weights, "gene").groupBy(*CELL_KEY, "label").agg(
        F.sum(F.col("lognorm") * F.col("w")).alias("score"))
    grid = cells.select(*CELL_KEY).withColumn("label", F.explode(distinct_values(enough, "label")))
    return grid.join(summed, [*CELL_KEY, "label"], "left").fillna(0.0, subset=["score"])


def _label_orders(signatures: DataFrame) -> DataFrame:
    return signatures.groupBy("label").agg(F.min("label_order").alias("label_order"))


def score_annotation(expr: DataFrame, cells: DataFrame, signatures: DataFrame, min_delta: float = 0.05,
                     specificity: bool = True, ctrl_size: int | None = None) -> DataFrame:
    """Best-scoring label per cell with the margin gate: a lead below ``min_delta`` becomes Unknown."""
    scores = gene_set_scores(expr, cells, signatures, 1, ctrl_size)
    if specificity:
        present = signatures.join(expr.select("gene").distinct(), "gene", "left_semi")
        factor = present.join(specificity_weights(signatures), "gene").groupBy("label").agg(
            F.when(F.count(F.lit(1)) >= 2, F.avg("weight")).otherwise(F.lit(1.0)).alias("factor"))
        scores = scores.join(factor, "label").withColumn("score", F.col("score") * F.col("factor")).drop("factor")
    # labels per cell are bounded by the signature list, so the window is small
    order = W.partitionBy(*CELL_KEY).orderBy(F.round("score", 9).desc(), "label_order")
    ranked = scores.join(_label_orders(signatures), "label").withColumn("_r", F.row_number().over(order)).filter("_r <= 2")
    best = ranked.groupBy(*CELL_KEY).agg(
        F.max(F.when(F.col("_r") == 1, F.col("label"))).alias("_label"),
        (F.max(F.when(F.col("_r") == 1, F.col("score"))) - F.coalesce(F.max(F.when(F.col("_r") == 2, F.col("score"))), F.lit(0.0))).alias("confidence"))
    return best.select(*CELL_KEY, F.when(F.round("confidence", 9) < min_delta, UNKNOWN).otherwise(F.col("_label")).alias("cell_type"), "confidence")


def dominant_module(scores: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Label with the highest score per cell, unassigned unless it exceeds the threshold."""
    best = scores.groupBy(*CELL_KEY).agg(F.max("score").alias("best"), F.min_by("label", F.struct(-F.round("score", 9), "label")).alias("_l"))
    return best.select(*CELL_KEY, F.when(F.col("best") > threshold, F.col("_l")).otherwise("unassigned").alias("module"), "best")


def label_profile(scores: DataFrame, labels: DataFrame, label: str = "cell_type") -> DataFrame:
    """Mean score per (cell label, module) and its z across labels per module (zero spread counts as 1)."""
    mean = scores.withColumnRenamed("label", "module").join(labels.select(*CELL_KEY, label), CELL_KEY).groupBy(label, "module").agg(
        F.avg("score").alias("mean_score"))
    by = W.partitionBy("module")
    sd = F.stddev_pop("mean_score").over(by)
    spread = F.when(sd < 1e-12, F.lit(1.0)).otherwise(sd)
    return mean.withColumn("z", (F.col("mean_score") - F.avg("mean_score").over(by)) / spread)


def mean_sem(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and standard error; a single value has error 0."""
    n = F.count(value)
    return df.groupBy(*by).agg(
        n.alias("n"), F.avg(value).alias("mean"),
        F.when(n > 1, F.stddev_samp(value) / F.sqrt(n)).otherwise(F.lit(0.0)).alias("sem"))


def module_tests(scores: DataFrame, cells: DataFrame, reference: str, test: str, min_n: int = 3) -> DataFrame:
    """Mann-Whitney (tie and continuity corrected) per module, BH over the tested modules."""
    tagged = scores.withColumnRenamed("label", "module").join(cells.select(*CELL_KEY, "condition"), CELL_KEY)
    out = score_test(tagged, ["module"], "condition", "score", test, reference, True, True, min_n)
    return bh_adjust(out, "pval", [], "pval_adj")


def gene_by_type_tests(expr: DataFrame, cells: DataFrame, gene: str, reference: str, test: str, min_n: int = 3) -> DataFrame:
    """One gene, every cell type: Mann-Whitney, difference of mean lognorm over ln 2, BH over types."""
    values = cells.join(expr.filter(F.col("gene") == gene).select(*CELL_KEY, "lognorm"), CELL_KEY, "left").fillna(
        0.0, subset=["lognorm"]).filter(F.col("condition").isin(reference, test))
    tests = score_test(values, ["cell_type"], "condition", "lognorm", test, reference, True, True, min_n)
    side = lambda who: F.avg(F.when(F.col("condition") == who, F.col("lognorm")))
    means = values.groupBy("cell_type").agg(((side(test) - side(reference)) / F.log(F.lit(2.0))).alias("log2fc"))
    return bh_adjust(tests.join(means, "cell_type"), "pval", [], "pval_adj")


def cluster_label_scores(expr: DataFrame, cells: DataFrame, cluster: str, signatures: DataFrame, specificity: bool = True) -> DataFrame:
    """Weighted sum of across-cluster z of the signature genes, per (cluster, label), zero where no gene is present."""
    st = group_gene_stats(expr, cells, [cluster])
    by = W.partitionBy("gene")
    z = (F.col("mean") - F.avg("mean").over(by)) / (F.stddev_pop("mean").over(by) + 1e-6)
    marks = signatures.select("label", "gene")
    marks = marks.join(specificity_weights(signatures), "gene") if specificity else marks.withColumn("weight", F.lit(1.0))
    sums = st.withColumn("z", z).join(marks, "gene").groupBy(cluster, "label").agg(F.sum(F.col("z") * F.col("weight")).alias("score"))
    grid = cells.select(cluster).distinct().withColumn("label", F.explode(distinct_values(signatures, "label")))
    return grid.join(sums, [cluster, "label"], "left").fillna(0.0, subset=["score"]).join(_label_orders(signatures), "label")


def label_clusters(expr: DataFrame, cells: DataFrame, cluster: str, signatures: DataFrame, min_score: float = 0.0,
                   specificity: bool = True, fallback: str = UNKNOWN) -> DataFrame:
    """Cluster labels: best score wins, first-listed label on ties, below ``min_score`` the fallback; top three kept."""
    scores = cluster_label_scores(expr, cells, cluster, signatures, specificity)
    rank = F.row_number().over(W.partitionBy(cluster).orderBy(F.round("score", 9).desc(), "label_order"))
    top = scores.withColumn("_r", rank).filter("_r <= 3").groupBy(cluster).agg(
        F.array_sort(F.collect_list(F.struct("_r", "label", "score"))).alias("t"))
    best = F.col("t")[0]
    return top.select(cluster, F.when(F.round(best["score"], 9) >= min_score, best["label"]).otherwise(fallback).alias("cell_type"),
                      best["score"].alias("score"), F.array_join(F.col("t.label"), ",").alias("top3"))


def attach_labels(cells: DataFrame, labels: DataFrame, key: str, column: str, fallback: str = UNKNOWN) -> DataFrame:
    return cells.drop(column).join(labels.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(fallback)))


def micro_reference(signatures: DataFrame, genes: DataFrame) -> DataFrame:
    """0/1 profile from marker lists on the panel genes, used when no reference profile is given."""
    names = distinct_values(signatures, "label")
    grid = genes.select("gene").distinct().withColumn("cell_type", F.explode(names))
    hit = signatures.select("gene", F.col("label").alias("cell_type"), F.lit(1.0).alias("value")).distinct()
    return grid.join(hit, ["gene", "cell_type"], "left").fillna(0.0, subset=["value"])


def correlation_annotation(expr: DataFrame, cells: DataFrame, cluster: str, profile: DataFrame, min_r: float = 0.3) -> DataFrame:
    """Cluster mean against each reference profile over shared genes; the best Pearson r names the cluster."""
    st = group_gene_stats(expr, cells, [cluster]).select(cluster, "gene", F.col("mean").alias("q"))
    r = st.join(profile, "gene").groupBy(cluster, "cell_type").agg(
        F.corr("q", "value").alias("r"), F.stddev_pop("q").alias("sq"), F.stddev_pop("value").alias("sv"))
    usable = r.filter((F.col("sq") >= 1e-9) & (F.col("sv") >= 1e-9))
    best = usable.groupBy(cluster).agg(F.max("r").alias("r"), F.min_by("cell_type", F.struct(-F.round("r", 9), "cell_type")).alias("_t"))
    every = cells.select(cluster).distinct().join(best, cluster, "left").fillna(-1.0, subset=["r"])
    return every.select(cluster, F.when(F.col("r") >= min_r, F.col("_t")).otherwise(UNKNOWN).alias("cell_type"), F.col("r").alias("confidence"))


def rule_table(spark, rules: list[tuple[str, str, float]]) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], "rule int, label string, gene string, threshold double")


def threshold_annotation(expr: DataFrame, cells: DataFrame, rules: DataFrame) -> DataFrame:
    """First matching rule in list order; confidence is the value over the largest among the cells that rule labelled."""
    hits = expr.join(rules, "gene").filter(F.col("lognorm") > F.col("threshold")).groupBy(*CELL_KEY).agg(
        F.min(F.struct("rule", "label", "lognorm")).alias("h"))
    matched = hits.select(*CELL_KEY, "h.rule", "h.label", "h.lognorm")
    peak = matched.groupBy("rule").agg(F.max("lognorm").alias("peak"))
    scored = matched.join(peak, "rule").select(*CELL_KEY, F.col("label").alias("cell_type"),
                                               (F.col("lognorm") / (F.col("peak") + 1e-9)).alias("confidence"))
    return cells.select(*CELL_KEY).join(scored, CELL_KEY, "left").fillna({"cell_type": UNKNOWN, "confidence": 0.0})


def rules_skipped(rules: DataFrame, genes: DataFrame) -> DataFrame:
    """Share of rules whose gene is not on the panel; above one half the annotation is doubtful."""
    on = genes.select("gene").distinct().withColumn("_on", F.lit(True))
    return rules.join(on, "gene", "left").agg(
        F.count(F.lit(1)).alias("n_rules"), F.count_if(F.col("_on").isNull()).alias("n_skipped")).withColumn(
        "doubtful", F.col("n_skipped") / F.col("n_rules") > 0.5)


def annotate(expr: DataFrame, cells: DataFrame, method: str = "marker_scoring", signatures: DataFrame | None = None,
             rules: DataFrame | None = None, profile: DataFrame | None = None, cluster: str = "cluster", **options) -> DataFrame:
    """Dispatch by method name."""
    if method == "marker_scoring":
        return score_annotation(expr, cells, signatures, **options)
    if method == "correlation":
        profile = profile if profile is not None else micro_reference(signatures, expr)
        return correlation_annotation(expr, cells, cluster, profile, **options)
    if method == "threshold":
        return threshold_annotation(expr, cells, rules)
    raise ValueError(f"unknown annotation method {method}")
