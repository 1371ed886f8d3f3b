"""Study tables derived from a TPC-H-like star schema: stand-in inputs for checks and benchmarks.

Customers are cells, nations are slides (and replicates), regions are conditions, market segments are cell types,
part sizes are genes and summed quantities are counts. Embedding rows are cells with coordinates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REFERENCE, TEST = "AFRICA", "ASIA"
BASE_SIZE = 40
SIGNATURE_SIZES = {"S1": [1, 2, 3], "S2": [3, 4, 5], "S3": [10, 11], "S4": [20, 21, 22], "S5": [22, 30]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.concat(F.lit("N"), F.col("n_nationkey")).alias("slide_id"), F.col("r_name").alias("condition"),
        F.concat(F.lit("N"), F.col("n_nationkey")).alias("replicate_id"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("N"), F.col("c_nationkey")).alias("slide_id"),
        F.col("c_custkey").cast("string").alias("cell_id"),
        F.col("c_mktsegment").alias("cell_type"), F.col("c_acctbal").alias("cell_area"),
        F.when(F.col("c_custkey") % 20 == 0, 1).otherwise(0).alias("control_probe_counts"),
        F.when(F.col("c_custkey") % 33 == 0, 1).otherwise(0).alias("control_codeword_counts"))
    return customer.join(slides(spark, sf_dir), "slide_id")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("G"), F.col("p_size")).alias("gene"))
    owner = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("N"), F.col("c_nationkey")).alias("slide_id"))
    rows = line.join(part, line.l_partkey == part.p_partkey).join(order, line.l_orderkey == order.o_orderkey)
    # collapse to (cell, gene) before the slide is attached: the wide join runs on far fewer rows
    per_gene = rows.groupBy("o_custkey", "gene").agg(F.sum("l_quantity").cast("int").alias("count"))
    return per_gene.join(owner, "o_custkey").select(
        "slide_id", F.col("o_custkey").cast("string").alias("cell_id"), "gene", "count")


def expression(spark: SparkSession, sf_dir: str, stage: bool = False) -> DataFrame:
    """Normalised values, lazily, so that gene and cell filters of a query reach them; ``stage`` writes them for loops that read them often."""
    from ..operators.normalize import lognorm
    from ..session import cut

    values = lognorm(counts(spark, sf_dir))
    return cut(values) if stage else values


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base panel: part sizes up to BASE_SIZE, annotated by the size's tens digit."""
    size = table(spark, sf_dir, "part").select("p_size").distinct().filter(F.col("p_size") <= BASE_SIZE)
    return size.select(
        F.concat(F.lit("G"), F.col("p_size")).alias("gene"), F.concat(F.lit("ENS"), F.col("p_size")).alias("ensembl_id"),
        (F.col("p_size") % 8 + 1).cast("int").alias("n_probesets"),
        F.concat(F.lit("annotation "), F.floor(F.col("p_size") / 10).cast("string")).alias("annotation"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which gene is on which slide's panel, plus control feature types."""
    size = table(spark, sf_dir, "part").select("p_size").distinct()
    sizes = size.select(F.array_sort(F.collect_set("p_size"))).scalar()
    nation = table(spark, sf_dir, "nation").select("n_nationkey")
    grid = nation.withColumn("p_size", F.explode(sizes))
    custom = F.col("p_size") > BASE_SIZE
    present = F.when(custom, (F.col("n_nationkey") * 7 + F.col("p_size")) % 3 != 0).otherwise(
        (F.col("n_nationkey") * 31 + F.col("p_size")) % 97 != 0)
    kind = F.when(F.col("p_size") % 25 == 7, "Negative Control Probe").otherwise("Gene Expression")
    return grid.filter(present).select(
        F.concat(F.lit("N"), F.col("n_nationkey")).alias("slide_id"), F.concat(F.lit("G"), F.col("p_size")).alias("gene"),
        kind.alias("feature_type"))


def signatures(spark: SparkSession) -> DataFrame:
    from ..operators.annotate import signature_table

    return signature_table(spark, {label: [f"G{n}" for n in sizes] for label, sizes in SIGNATURE_SIZES.items()}, "demo")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with coordinates: the first two embedding components in micrometres, four slides, two conditions."""
    e = F.col("embedding")
    slide = F.col("vec_id") % 4
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("P"), slide).alias("slide_id"), F.col("vec_id").cast("string").alias("cell_id"),
        F.when(slide < 2, "A").otherwise("B").alias("condition"), F.concat(F.lit("P"), slide).alias("replicate_id"),
        (e[0].cast("double") * 1000).alias("x"), (e[1].cast("double") * 1000).alias("y"),
        F.concat(F.lit("L"), F.col("label")).alias("cell_type"))


def point_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("P"), F.col("vec_id") % 4).alias("slide_id"), F.col("vec_id").cast("string").alias("cell_id"),
        F.transform("embedding", lambda v: v.cast("double")).alias("vec"))


def point_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse non-negative values at the points: positive embedding components, one gene per dimension."""
    exploded = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("P"), F.col("vec_id") % 4).alias("slide_id"), F.col("vec_id").cast("string").alias("cell_id"),
        F.posexplode("embedding").alias("dim", "value"))
    return exploded.filter(F.col("value") > 0).select(
        "slide_id", "cell_id", F.concat(F.lit("E"), F.col("dim") + 1).alias("gene"),
        F.col("value").cast("double").alias("lognorm"))
