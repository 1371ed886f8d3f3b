"""Differential expression: two-condition tests, per-group tests and cluster markers as single plans.

A group (cell type, cluster, region) is one more key of the rank kernel and of the BH family, never a driver loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import bh_adjust, label_order
from ..functions.tails import normal_two_sided, t_two_sided
from ..schemas import CELL_KEY
from .matrix import distinct_values, group_gene_frame, group_gene_stats, group_sizes, with_labels
from .ranks import lognorm_range, rank_sums, rank_z

ALL = "_all"


def pick_conditions(cells: DataFrame, key: str = "condition") -> tuple[str, str]:
    """(reference, test) when the caller names none: the sorted pair, an error unless there are exactly two."""
    found = sorted(r[0] for r in cells.select(key).distinct().limit(3).collect())
    if len(found) != 2:
        raise ValueError(f"{key} must hold exactly two values, found {found}")
    return found[0], found[1]


def drop_zero_filled(expr: DataFrame, gene_meta: DataFrame, cells: DataFrame, scope: str = "any_slide") -> DataFrame:
    """Remove structural zeros: genes filled in on any compared slide (or on the first slide, for parity)."""
    slides = cells.select("slide_id").distinct()
    if scope == "first_slide":
        slides = slides.agg(F.min("slide_id").alias("slide_id"))
    elif scope != "any_slide":
        raise ValueError(f"unknown zero-fill scope {scope}")
    filled = gene_meta.filter("zero_filled").join(slides, "slide_id", "left_semi").select("gene").distinct()
    return expr.join(filled, "gene", "left_anti")


def _paired(stats: DataFrame, keys: list[str], label: str, a: str, b: str, columns: list[str]) -> DataFrame:
    """Rows per (keys, gene) with the two labels side by side, suffixed _a and _b."""
    side = lambda c, who, tag: F.max(F.when(F.col(label) == who, F.col(c))).alias(f"{c}_{tag}")
    return stats.groupBy(*keys, "gene").agg(*[side(c, a, "a") for c in columns], *[side(c, b, "b") for c in columns])


def _fold(mean_b: Column, mean_a: Column) -> Column:
    return F.log2((F.expm1(mean_b) + 1e-9) / (F.expm1(mean_a) + 1e-9))


def _t_columns(df: DataFrame, over_estimate: bool) -> DataFrame:
    """Welch t of b against a; the over-estimating variant divides both variances by n_b."""
    na, nb = F.col("n_cells_a"), F.col("n_cells_b")
    va = F.col("var_pop_a") * na / F.greatest(na - 1, F.lit(1))
    vb = F.col("var_pop_b") * nb / F.greatest(nb - 1, F.lit(1))
    ea, eb = va / (nb if over_estimate else na), vb / nb
    prepared = df.withColumn("_ea", ea).withColumn("_eb", eb).withColumn("_e", F.col("_ea") + F.col("_eb"))
    da, db = F.greatest((nb if over_estimate else na) - 1, F.lit(1)), F.greatest(nb - 1, F.lit(1))
    dof = F.when(F.col("_e") > 0, F.col("_e") * F.col("_e") / (F.col("_ea") * F.col("_ea") / da + F.col("_eb") * F.col("_eb") / db))
    return (prepared.withColumn("score", F.when(F.col("_e") > 0, (F.col("mean_b") - F.col("mean_a")) / F.sqrt("_e")).otherwise(F.lit(0.0)))
            .withColumn("dof", dof)
            .withColumn("pval", F.coalesce(t_two_sided(F.col("score"), F.col("dof")), F.lit(1.0)))
            .drop("_ea", "_eb", "_e"))


def two_condition_dge(expr: DataFrame, cells: DataFrame, reference: str, test: str, condition: str = "condition",
                      group: str | None = None, method: str = "wilcoxon", min_cells: int = 0,
                      target_sum: float = 100.0) -> DataFrame:
    """Test against reference for every gene, per ``group`` when given.

    Groups with fewer than ``min_cells`` on a side are left out. ``method``: wilcoxon, t-test, t-test_overestim_var.
    """
    keys = [group] if group else []
    pair = cells.filter(F.col(condition).isin(reference, test))
    if group and min_cells:
        sides = pair.groupBy(group).agg(
            F.count_if(F.col(condition) == reference).alias("_a"), F.count_if(F.col(condition) == test).alias("_b"))
        pair = pair.join(sides.filter((F.col("_a") >= min_cells) & (F.col("_b") >= min_cells)).select(group), group, "left_semi")
    genes = distinct_values(expr, "gene")
    labelled = expr.join(pair.select(*CELL_KEY, *keys, condition), CELL_KEY)
    stats = group_gene_stats(labelled, pair, [*keys, condition], "lognorm", genes)
    wide = _paired(stats, keys, condition, reference, test, ["n_cells", "mean", "pct", "var_pop"])
    wide = wide.filter(F.col("n_cells_a").isNotNull() & F.col("n_cells_b").isNotNull()).withColumn(
        "log2fc", _fold(F.col("mean_b"), F.col("mean_a")))
    if method == "wilcoxon":
        frame = group_gene_frame(pair, genes, [*keys, condition])
        ranks = rank_sums(labelled, [*keys, "gene"], condition, "lognorm", frame, lognorm_range(target_sum))
        tested = ranks.filter(F.col(condition) == test)
        z = rank_z(F.col("n_label"), F.col("n_total"), F.col("rank_sum"), F.col("tie_term"))
        scored = tested.select(*keys, "gene", z.alias("score"))
        table = wide.join(scored, [*keys, "gene"]).withColumn("pval", normal_two_sided(F.col("score")))
    elif method in ("t-test", "t-test_overestim_var"):
        table = _t_columns(wide, method == "t-test_overestim_var")
    else:
        raise ValueError(f"unknown method {method}")
    adjusted = bh_adjust(table, "pval", keys, "pval_adj")
    return adjusted.select(
        *keys, "gene", "log2fc", "score", "pval", "pval_adj",
        F.col("pct_a"), F.col("pct_b"), F.col("mean_a"), F.col("mean_b"),
        F.col("n_cells_a"), F.col("n_cells_b"), F.lit(method).alias("method"))


def direction(log2fc: Column, p: Column, lfc_min: float, p_max: float, inclusive: bool = True) -> Column:
    """up / down / ns; tables include the fold-change bound, plots exclude it."""
    strong = F.abs(log2fc) >= lfc_min if inclusive else F.abs(log2fc) > lfc_min
    hit = strong & (p < p_max)
    return F.when(hit & (log2fc > 0), "up").when(hit & (log2fc < 0), "down").otherwise("ns")


def with_flags(dge: DataFrame, lfc_min: float = 1.0, p_max: float = 0.01, inclusive: bool = True) -> DataFrame:
    label = direction(F.col("log2fc"), F.col("pval_adj"), lfc_min, p_max, inclusive)
    return dge.withColumn("direction", label).withColumn("significant", F.col("direction") != "ns")


def replicate_agreement(expr: DataFrame, cells: DataFrame, reference: str, test: str, condition: str = "condition",
                        replicate: str = "replicate_id", group: str | None = None) -> DataFrame:
    """Replicates per side whose mean lies on the same side of the other condition's grand mean as the effect."""
    keys = [group] if group else []
    pair = cells.filter(F.col(condition).isin(reference, test))
    genes = distinct_values(expr, "gene")
    labelled = expr.join(pair.select(*CELL_KEY, *keys, condition, replicate), CELL_KEY)
    per_rep = group_gene_stats(labelled, pair, [*keys, condition, replicate], "lognorm", genes)
    # condition means follow from the replicate sums: no second pass over the matrix
    family = W.partitionBy(*keys, "gene")
    n, s = F.col("n_cells"), F.col("s1")
    pick = lambda who, c: F.sum(F.when(F.col(condition) == who, c)).over(family)
    wide = per_rep.withColumn("mean_a", pick(reference, s) / pick(reference, n)).withColumn(
        "mean_b", pick(test, s) / pick(test, n))
    effect = F.signum(F.col("mean_b") - F.col("mean_a"))
    agrees_b = (F.col(condition) == test) & (F.signum(F.col("mean") - F.col("mean_a")) == effect)
    agrees_a = (F.col(condition) == reference) & (F.signum(F.col("mean_b") - F.col("mean")) == effect)
    return wide.groupBy(*keys, "gene").agg(
        F.count_if(agrees_a).alias("n_consistent_a"), F.count_if(agrees_b).alias("n_consistent_b"))


def stringent_dge(expr: DataFrame, cells: DataFrame, reference: str, test: str, condition: str = "condition",
                  replicate: str | None = "replicate_id", group: str | None = None, lfc_min: float = 1.0,
                  p_max: float = 0.01, min_pct: float = 0.10, min_mean: float = 0.1, min_consistent: int = 3,
                  min_cells: int = 0, keep_all: bool = False) -> DataFrame:
    """Rank-sum test, BH over all genes, then fold change, replicate agreement, p, fraction and mean filters.

    Stage columns are cumulative, so survivors per stage are plain sums; ``keep_all`` returns unfiltered rows.
    """
    base = two_condition_dge(expr, cells, reference, test, condition, group, "wilcoxon", min_cells)
    keys = [group] if group else []
    if replicate:
        agree = replicate_agreement(expr, cells, reference, test, condition, replicate, group)
        base = base.join(agree, [*keys, "gene"], "left")
        consistent = (F.col("n_consistent_a") >= min_consistent) & (F.col("n_consistent_b") >= min_consistent)
    else:
        consistent = F.lit(True)
    stages = [
        ("pass_lfc", F.abs("log2fc") >= lfc_min),
        ("pass_replicates", consistent),
        ("pass_pval", F.col("pval_adj") < p_max),
        ("pass_pct", F.greatest("pct_a", "pct_b") >= min_pct),
        ("pass_mean", F.greatest("mean_a", "mean_b") >= min_mean),
    ]
    previous = F.lit(True)
    for name, rule in stages:
        base = base.withColumn(name, previous & rule)
        previous = F.col(name)
    base = base.withColumn("method", F.lit("stringent_wilcoxon"))
    return base if keep_all else base.filter("pass_mean").drop(*[s[0] for s in stages])


def stage_survivors(stringent: DataFrame, by: list[str] | None = None) -> DataFrame:
    count = lambda c: F.sum(F.col(c).cast("bigint")).alias(c.replace("pass_", "n_after_"))
    return stringent.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_tested"), *[count(f"pass_{s}") for s in ("lfc", "replicates", "pval", "pct", "mean")])


def cluster_markers(expr: DataFrame, cells: DataFrame, groupby: str, method: str = "wilcoxon", n_genes: int | None = 25,
                    reference: str = "rest", min_cells: int = 1, target_sum: float = 100.0) -> DataFrame:
    """Each cluster against all other cells, or against one named cluster; one rank pass serves all clusters."""
    if reference != "rest":
        return _markers_vs_named(expr, cells, groupby, method, n_genes, reference, min_cells, target_sum)
    sizes = group_sizes(cells, [groupby])
    allowed = sizes.filter(F.col("n_cells") >= min_cells).select(groupby)
    inside = cells.join(allowed, groupby, "left_semi")
    genes = distinct_values(expr, "gene")
    labelled = expr.join(inside.select(*CELL_KEY, groupby), CELL_KEY)
    st = group_gene_stats(labelled, inside, [groupby], "lognorm", genes)
    every = W.partitionBy("gene")
    total = lambda c: F.sum(c).over(every)
    n_rest = total("n_cells") - F.col("n_cells")
    s1_rest, s2_rest = total("s1") - F.col("s1"), total("s2") - F.col("s2")
    table = (st.withColumn("n_cells_b", F.col("n_cells")).withColumn("n_cells_a", n_rest)
             .withColumn("mean_b", F.col("mean")).withColumn("mean_a", s1_rest / n_rest)
             .withColumn("pct_b", F.col("pct")).withColumn("pct_a", (total("nnz") - F.col("nnz")) / n_rest)
             .withColumn("var_pop_b", F.col("var_pop"))
             .withColumn("var_pop_a", F.greatest(F.lit(0.0), s2_rest / n_rest - F.col("mean_a") * F.col("mean_a")))
             .filter(F.col("n_cells_a") > 0)
             .withColumn("log2fc", _fold(F.col("mean_b"), F.col("mean_a"))))
    if method == "wilcoxon":
        frame = group_gene_frame(inside, genes, [groupby])
        ranks = rank_sums(labelled, ["gene"], groupby, "lognorm", frame, lognorm_range(target_sum))
        z = rank_z(F.col("n_label"), F.col("n_total"), F.col("rank_sum"), F.col("tie_term"))
        table = table.join(ranks.select(groupby, "gene", z.alias("score")), [groupby, "gene"]).withColumn(
            "pval", normal_two_sided(F.col("score")))
    elif method in ("t-test", "t-test_overestim_var"):
        table = _t_columns(table, method == "t-test_overestim_var")
    else:
        raise ValueError(f"unknown method {method}")
    return _top_markers(table, groupby, n_genes)


def _markers_vs_named(expr, cells, groupby, method, n_genes, reference, min_cells, target_sum):
    """Every other cluster against one named cluster: the named cells take part in each comparison's ranks.

    The comparison is a key; the reference cluster's collapsed values are repeated per comparison, not its cells.
    """
    sizes = group_sizes(cells, [groupby])
    others = sizes.filter((F.col("n_cells") >= min_cells) & (F.col(groupby) != reference))
    targets = distinct_values(others, groupby)
    genes = distinct_values(expr, "gene")
    st = group_gene_stats(expr, cells, [groupby], "lognorm", genes)
    columns = ["n_cells", "mean", "pct", "var_pop"]
    base = st.filter(F.col(groupby) == reference).select("gene", *[F.col(c).alias(f"{c}_a") for c in columns])
    table = (st.join(others.select(groupby), groupby, "left_semi")
             .select(groupby, "gene", *[F.col(c).alias(f"{c}_b") for c in columns]).join(base, "gene")
             .withColumn("log2fc", _fold(F.col("mean_b"), F.col("mean_a"))))
    if method == "wilcoxon":
        spread = lambda df: df.withColumn("_side", F.when(F.col(groupby) == reference, "a").otherwise("b")).withColumn(
            "_cmp", F.explode(F.when(F.col(groupby) == reference, targets).otherwise(F.array(groupby))))
        tallied = with_labels(expr, cells, [groupby]).groupBy("gene", groupby, F.round("lognorm", 12).alias("v")).agg(
            F.count(F.lit(1)).alias("weight"))
        frame = spread(group_gene_frame(cells, genes, [groupby]))
        ranks = rank_sums(spread(tallied), ["_cmp", "gene"], "_side", "v", frame, lognorm_range(target_sum), "weight")
        z = rank_z(F.col("n_label"), F.col("n_total"), F.col("rank_sum"), F.col("tie_term"))
        scored = ranks.filter("_side = 'b'").select(F.col("_cmp").alias(groupby), "gene", z.alias("score"))
        table = table.join(scored, [groupby, "gene"]).withColumn("pval", normal_two_sided(F.col("score")))
    elif method in ("t-test", "t-test_overestim_var"):
        table = _t_columns(table, method == "t-test_overestim_var")
    else:
        raise ValueError(f"unknown method {method}")
    return _top_markers(table, groupby, n_genes)


def _top_markers(table: DataFrame, groupby: str, n_genes: int | None) -> DataFrame:
    adjusted = bh_adjust(table, "pval", [groupby], "pval_adj")
    rank = F.row_number().over(W.partitionBy(groupby).orderBy(F.round("score", 9).desc(), "gene"))
    ranked = adjusted.withColumn("rank", rank)
    ranked = ranked if n_genes is None else ranked.filter(F.col("rank") <= n_genes)
    return ranked.select(groupby, "rank", "gene", "score", "log2fc", "pval", "pval_adj", "pct_a", "pct_b",
                         "n_cells_a", "n_cells_b")


def logreg_markers(expr: DataFrame, cells: DataFrame, groupby: str, n_genes: int = 25, max_iter: int = 100) -> DataFrame:
    """Multinomial logistic regression coefficients as marker scores (reference set: all other clusters)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector

    spark = expr.sparkSession
    genes = [r[0] for r in expr.select("gene").distinct().orderBy("gene").collect()]  # panel-sized
    # one dense vector per cell: sparse entries summed into their slot of the panel
    index = F.array_position(F.array(*[F.lit(g) for g in genes]), F.col("gene")) - 1
    entries = with_labels(expr, cells, [groupby]).withColumn("_i", index)
    packed = cells.select(*CELL_KEY, groupby).join(
        entries.groupBy(*CELL_KEY).agg(F.map_from_entries(F.collect_list(F.struct("_i", "lognorm"))).alias("_m")),
        CELL_KEY, "left")
    slots = F.sequence(F.lit(0), F.lit(len(genes) - 1))
    dense = F.transform(slots, lambda i: F.coalesce(F.element_at(F.coalesce("_m", F.create_map().cast("map<bigint,double>")), i.cast("bigint")), F.lit(0.0)))
    rows = packed.select(groupby, array_to_vector(dense).alias("features"))
    indexer = StringIndexer(inputCol=groupby, outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    model = LogisticRegression(maxIter=max_iter, family="multinomial", regParam=1e-4, standardization=False).fit(
        indexer.transform(rows))
    coef = model.coefficientMatrix.toArray()  # clusters x panel
    flat = [(lab, g, float(coef[i, j])) for i, lab in enumerate(indexer.labels) for j, g in enumerate(genes)]
    scored = spark.createDataFrame(flat, f"{groupby} string, gene string, score double")
    rank = F.row_number().over(W.partitionBy(groupby).orderBy(F.col("score").desc(), "gene"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= n_genes)


def run_dge(expr: DataFrame, cells: DataFrame, reference: str, test: str, method: str = "stringent_wilcoxon",
            counts: DataFrame | None = None, group: str | None = None, **options) -> DataFrame:
    """Dispatch by method name; every result carries gene, log2fc and pval_adj."""
    if method in ("wilcoxon", "t-test", "t-test_overestim_var"):
        return two_condition_dge(expr, cells, reference, test, group=group, method=method, **options)
    if method == "stringent_wilcoxon":
        return stringent_dge(expr, cells, reference, test, group=group, **options)
    if method in ("pydeseq2", "pseudobulk", "cside"):
        from .pseudobulk import pseudobulk_dge

        if counts is None:
            raise ValueError(f"{method} needs the raw counts")
        key = group or ("cell_type" if method == "cside" else None)
        if method == "cside":
            options = {"min_cells_per_side": 5, "min_samples": 4, **options}
        return pseudobulk_dge(counts, cells, reference, test, group=key, **options)
    raise ValueError(f"unknown method {method}")


def group_dge(expr: DataFrame, cells: DataFrame, reference: str, test: str, group: str = "cell_type",
              method: str = "stringent_wilcoxon", min_cells: int = 10, lfc_min: float = 1.0, p_max: float = 0.01,
              counts: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Per-group test with significance flags, and its summary; both for every method."""
    if method not in ("pydeseq2", "pseudobulk", "cside"):
        options["min_cells"] = min_cells
    result = run_dge(expr, cells, reference, test, method, counts=counts, group=group, **options)
    flagged = with_flags(result, lfc_min, p_max)
    return flagged, deg_counts(flagged, group)


def deg_counts(flagged: DataFrame, group: str) -> DataFrame:
    return flagged.groupBy(group).agg(
        F.count_if(F.col("direction") == "up").alias("n_up"),
        F.count_if(F.col("direction") == "down").alias("n_down"),
        F.count_if(F.col("direction") != "ns").alias("n_total"),
        F.count(F.lit(1)).alias("n_genes")).orderBy(*label_order(F.col(group)))


def top_per_direction(flagged: DataFrame, group: str, n: int) -> DataFrame:
    """Largest effects among up, smallest among down, per group."""
    effect = F.when(F.col("direction") == "up", -F.col("log2fc")).otherwise(F.col("log2fc"))
    rank = F.row_number().over(W.partitionBy(group, "direction").orderBy(effect, "gene"))
    return flagged.filter(F.col("direction") != "ns").withColumn("rank", rank).filter(F.col("rank") <= n)


def top_half_and_half(dge: DataFrame, n: int = 40, lfc_min: float = 1.0, p_max: float = 0.01) -> DataFrame:
    """n/2 strongest up and n/2 strongest down genes overall (strict fold-change bound, as plotted)."""
    flagged = with_flags(dge, lfc_min, p_max, inclusive=False)
    return top_per_direction(flagged.withColumn(ALL, F.lit(1)), ALL, n // 2).drop(ALL)


def volcano_labels(dge: DataFrame, n: int = 25, lfc_min: float = 1.0, p_max: float = 0.01) -> DataFrame:
    """-log10 p, direction and the rank by |log2fc| x -log10 p among significant genes (label_rank <= n)."""
    from ..functions.stats import neg_log10

    table = with_flags(dge, lfc_min, p_max, inclusive=False).withColumn("neg_log10_p", neg_log10(F.col("pval_adj")))
    weight = F.round(F.abs("log2fc") * F.col("neg_log10_p"), 9)
    rank = F.row_number().over(W.partitionBy(F.col("direction") != "ns").orderBy(weight.desc(), "gene"))
    return table.withColumn("label_rank", F.when((F.col("direction") != "ns") & (rank <= n), rank))


def unique_markers(markers: DataFrame, groupby: str, n: int) -> DataFrame:
    """n markers per cluster in cluster order, repeated genes kept at their first appearance."""
    top = markers.filter(F.col("rank") <= n)
    first = F.row_number().over(W.partitionBy("gene").orderBy(*label_order(F.col(groupby)), "rank"))
    return top.withColumn("_first", first).filter("_first = 1").drop("_first")


def effect_pivot(flagged: DataFrame, group: str, p_max: float = 0.05) -> DataFrame:
    """Mean significant log2fc per (gene, group) in long form, 0 where nothing is significant."""
    hits = flagged.filter(F.col("pval_adj") < p_max).groupBy("gene", group).agg(F.avg("log2fc").alias("mean_log2fc"))
    genes = hits.select(F.array_sort(F.collect_set("gene"))).scalar()
    grid = flagged.select(group).distinct().withColumn("gene", F.explode(genes))
    return grid.join(hits, ["gene", group], "left").fillna(0.0, subset=["mean_log2fc"])


def effect_order(flagged: DataFrame, groups_of: DataFrame) -> DataFrame:
    """Genes by functional group position, then effect (largest first)."""
    joined = flagged.join(groups_of, "gene")
    position = F.row_number().over(W.orderBy("group_position", F.col("log2fc").desc(), "gene"))
    return joined.withColumn("position", position)


def search_results(dge: DataFrame, p_max: float = 0.05, limit: int = 200, order: list[Column] | None = None) -> DataFrame:
    """Result browser: rows below p, best first."""
    return dge.filter(F.col("pval_adj") < p_max).orderBy(*(order or [F.col("pval_adj"), F.col("gene")])).limit(limit)
