"""Gene panels across slides: validation, harmonisation, annotation and reports as set logic on small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .matrix import distinct_values


def n_slides(slides: DataFrame) -> Column:
    return slides.select(F.countDistinct("slide_id")).scalar()


def classify(features: DataFrame, panel: DataFrame) -> DataFrame:
    """Mark each feature base or custom."""
    known = panel.select("gene").distinct().withColumn("_b", F.lit(True))
    return features.join(known, "gene", "left").withColumn(
        "panel_class", F.when(F.col("_b"), "base").otherwise("custom")).drop("_b")


def validate_panel(features: DataFrame, panel: DataFrame, slides: DataFrame, strict: bool = False) -> DataFrame:
    """Per slide: totals, missing base genes, custom genes; ``strict`` raises when a base gene is missing."""
    listed = lambda keep: F.array_join(F.array_sort(F.collect_list(F.when(keep, F.col("gene")))), ",")
    base = F.col("panel_class") == "base"
    per_slide = classify(features, panel).groupBy("slide_id").agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(base).alias("n_base"), F.count_if(~base).alias("n_custom"),
        listed(~base).alias("custom_genes"))
    base_genes = distinct_values(panel, "gene")
    expected = slides.select("slide_id", "condition").withColumn("gene", F.explode(base_genes))
    absent = expected.join(features.select("slide_id", "gene"), ["slide_id", "gene"], "left_anti").groupBy("slide_id").agg(
        F.count(F.lit(1)).alias("n_base_missing"), F.array_join(F.array_sort(F.collect_list("gene")), ",").alias("missing_genes"))
    table = slides.select("slide_id", "condition").join(per_slide, "slide_id", "left").join(absent, "slide_id", "left").fillna(
        {"n_base_missing": 0, "missing_genes": ""}).withColumn("base_complete", F.col("n_base_missing") == 0)
    if strict:
        broken = [r.slide_id for r in table.filter(~F.col("base_complete")).select("slide_id").collect()]
        if broken:
            raise ValueError(f"base panel incomplete on {', '.join(sorted(broken))}")
    return table


def presence_matrix(features: DataFrame, panel: DataFrame) -> DataFrame:
    """Custom gene x slide presence in long form with each gene's slide count."""
    custom = classify(features, panel).filter("panel_class = 'custom'").select("gene", "slide_id").distinct()
    slides = distinct_values(features, "slide_id")
    genes = custom.groupBy("gene").agg(F.count(F.lit(1)).alias("n_slides"))
    grid = genes.withColumn("slide_id", F.explode(slides))
    return grid.join(custom.withColumn("present", F.lit(True)), ["gene", "slide_id"], "left").fillna(False, subset=["present"])


def custom_gene_counts(features: DataFrame, panel: DataFrame, slides: DataFrame) -> DataFrame:
    """Slides per custom gene and its sharing category."""
    custom = classify(features, panel).filter("panel_class = 'custom'").select("gene", "slide_id").distinct()
    n = n_slides(slides)
    k = F.col("n_slides")
    return custom.groupBy("gene").agg(
        F.count(F.lit(1)).alias("n_slides"), F.array_join(F.array_sort(F.collect_list("slide_id")), ",").alias("slides_present"),
    ).withColumn("category", F.when(k == n, "shared_all").when(k > 1, "shared_partial").otherwise("unique"))


def harmonised_genes(features: DataFrame, panel: DataFrame, slides: DataFrame, mode: str = "partial_union",
                     min_slides: int = 2) -> DataFrame:
    """The gene list every slide is aligned to.

    intersection: base genes on all slides. partial_union: base genes anywhere plus custom genes on at least
    ``min_slides`` slides. union: every gene seen.
    """
    seen = classify(features, panel).groupBy("gene", "panel_class").agg(F.countDistinct("slide_id").alias("n_slides"))
    base = F.col("panel_class") == "base"
    if mode == "intersection":
        rule = base & (F.col("n_slides") == n_slides(slides))
    elif mode == "partial_union":
        rule = base | (F.col("n_slides") >= min_slides)
    elif mode == "union":
        rule = F.lit(True)
    else:
        raise ValueError(f"unknown harmonisation mode {mode}")
    return seen.filter(rule)


def gene_meta(features: DataFrame, panel: DataFrame, slides: DataFrame, mode: str = "partial_union",
              min_slides: int = 2) -> DataFrame:
    """Per (slide, gene) annotation of the harmonised panel with the structural-zero flag; no zero rows are stored."""
    kept = harmonised_genes(features, panel, slides, mode, min_slides)
    order = features.join(kept.select("gene"), "gene", "left_semi").groupBy("gene").agg(
        F.array_join(F.array_sort(F.collect_set("slide_id")), ",").alias("slides_present"))
    all_slides = distinct_values(slides, "slide_id")
    grid = kept.join(order, "gene").withColumn("slide_id", F.explode(all_slides))
    present = features.select("slide_id", "gene").distinct().withColumn("_on", F.lit(True))
    kind = F.when(F.col("panel_class") == "base", "base").when(F.col("n_slides") > 1, "custom_shared").otherwise("custom_unique")
    annotated = grid.join(present, ["slide_id", "gene"], "left").join(panel, "gene", "left")
    return annotated.select(
        "slide_id", "gene", kind.alias("panel_type"), F.col("n_slides").alias("n_slides_present"), "slides_present",
        F.col("_on").isNull().alias("zero_filled"), "annotation", "ensembl_id", "n_probesets")


def threshold_table(features: DataFrame, panel: DataFrame, slides: DataFrame) -> DataFrame:
    """Custom genes kept and mean zero-filled slide entries for every possible minimum slide count."""
    counts = custom_gene_counts(features, panel, slides).select("n_slides")
    n = n_slides(slides)
    reach = counts.withColumn("n", n).withColumn("min_slides", F.explode(F.sequence(F.lit(1), F.col("n_slides").cast("int"))))
    return reach.groupBy("min_slides").agg(
        F.count(F.lit(1)).alias("n_kept"), F.avg(F.col("n") - F.col("n_slides")).alias("mean_zero_filled"))


def recommend_min_slides(thresholds: DataFrame, target: int) -> int:
    """The largest threshold that still keeps ``target`` custom genes; 1 when none does."""
    row = thresholds.filter(F.col("n_kept") >= target).agg(F.max("min_slides")).first()
    return int(row[0]) if row and row[0] is not None else 1


def panel_report(features: DataFrame, panel: DataFrame, slides: DataFrame) -> DataFrame:
    """Per slide: base, shared and unique custom genes, with the unique ones listed."""
    cats = custom_gene_counts(features, panel, slides).select("gene", "category")
    tagged = classify(features, panel).join(cats, "gene", "left")
    is_ = lambda c: F.col("category") == c
    return tagged.groupBy("slide_id").agg(
        F.count_if(F.col("panel_class") == "base").alias("n_base"), F.count_if(is_("shared_all")).alias("n_shared_all"),
        F.count_if(is_("shared_partial")).alias("n_shared_partial"), F.count_if(is_("unique")).alias("n_unique"),
        F.array_join(F.array_sort(F.collect_list(F.when(is_("unique"), F.col("gene")))), ",").alias("unique_genes"))


def slide_count_histogram(features: DataFrame, panel: DataFrame, slides: DataFrame, min_slides: int) -> DataFrame:
    return custom_gene_counts(features, panel, slides).groupBy("n_slides").agg(
        F.count(F.lit(1)).alias("n_genes")).withColumn("kept", F.col("n_slides") >= min_slides)


def zero_filled_by_type(meta: DataFrame) -> DataFrame:
    return meta.groupBy("slide_id", "panel_type").agg(
        F.count_if("zero_filled").alias("n_zero_filled"), F.count(F.lit(1)).alias("n_genes"))


def marker_coverage(signatures: DataFrame, genes: DataFrame) -> DataFrame:
    """Which signature genes the panel holds; tier weight by list position."""
    on = genes.select("gene").distinct().withColumn("in_panel", F.lit(True))
    tier = F.greatest(F.lit(0.4), 1.0 - 0.2 * F.col("position"))
    every = W.partitionBy("label")
    return signatures.join(on, "gene", "left").fillna(False, subset=["in_panel"]).select(
        "label", "gene", "position", "in_panel", tier.alias("tier"),
        F.avg(F.col("in_panel").cast("double")).over(every).alias("coverage"))


def find_gene(genes: DataFrame, text: str, limit: int = 5) -> DataFrame:
    """Exact match first, then case-insensitive, then prefix, then substring suggestions."""
    low, key = F.lower("gene"), text.lower()
    kind = (F.when(F.col("gene") == text, 0).when(low == key, 1).when(low.startswith(key), 2)
            .when(low.contains(key), 3))
    return genes.select("gene").distinct().withColumn("match", kind).filter("match IS NOT NULL").orderBy("match", "gene").limit(limit)


def search_panel(genes: DataFrame, text: str) -> DataFrame:
    return genes.filter(F.lower("gene").contains(text.lower()))


def feature_breakdown(features: DataFrame) -> DataFrame:
    return features.groupBy("slide_id", "feature_type").agg(F.count(F.lit(1)).alias("n_features"))


def keep_expression_features(counts: DataFrame, features: DataFrame, kind: str = "Gene Expression") -> DataFrame:
    """Counts of real genes only: control feature types leave before anything else runs."""
    wanted = features.filter(F.col("feature_type") == kind).select("slide_id", "gene").distinct()
    return counts.join(wanted, ["slide_id", "gene"], "left_semi")


def harmonise(counts: DataFrame, features: DataFrame, panel: DataFrame, slides: DataFrame, mode: str = "partial_union",
              min_slides: int = 2) -> tuple[DataFrame, DataFrame]:
    """Counts of the harmonised genes only, and the gene annotation with its structural-zero flags.

    Genes outside the harmonised panel leave before any cell total is taken. Genes a slide lacks are zeros already.
    """
    genes = harmonised_genes(features, panel, slides, mode, min_slides).select("gene")
    return counts.join(genes, "gene", "left_semi"), gene_meta(features, panel, slides, mode, min_slides)
