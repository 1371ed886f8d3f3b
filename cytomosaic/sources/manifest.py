"""Slide manifests: slide_id, condition, run_dir and an optional replicate_id (default: the slide)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SLIDES
from .slides import path_exists


def from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    table = [(str(r["slide_id"]), str(r["condition"]), str(r.get("replicate_id") or r["slide_id"]), str(r["run_dir"])) for r in rows]
    ids = [t[0] for t in table]
    if len(set(ids)) != len(ids):
        raise ValueError("slide ids must be unique")
    return spark.createDataFrame(table, SLIDES)


def from_csv(spark: SparkSession, path: str) -> DataFrame:
    """A first row whose third cell is neither an absolute nor an existing path is a header."""
    first = spark.read.csv(path).first()
    if first is None or len(first) < 3:
        raise ValueError(f"{path}: a manifest has at least slide_id, condition and run_dir")
    third = str(first[2]).strip()
    absolute = third.startswith("/") or "://" in third
    raw = spark.read.csv(path, header=not (absolute or path_exists(spark, third)))
    named = raw.toDF(*["slide_id", "condition", "run_dir", "replicate_id", *[f"extra_{i}" for i in range(len(raw.columns))]][:len(raw.columns)])
    replicate = F.coalesce("replicate_id", "slide_id") if "replicate_id" in named.columns else F.col("slide_id")
    return named.select("slide_id", "condition", replicate.alias("replicate_id"), "run_dir")


def summary(slides: DataFrame) -> DataFrame:
    return slides.groupBy("condition").agg(
        F.count(F.lit(1)).alias("n_slides"), F.countDistinct("replicate_id").alias("n_replicates"),
        F.array_join(F.array_sort(F.collect_list("slide_id")), ",").alias("slides"))


def check_replicates(slides: DataFrame, expected: dict[str, int]) -> None:
    """Fail when a condition does not have the expected number of slides."""
    found = {r.condition: r.n_slides for r in summary(slides).collect()}
    wrong = {c: (n, found.get(c, 0)) for c, n in expected.items() if found.get(c, 0) != n}
    if wrong:
        raise ValueError("slides per condition: " + ", ".join(f"{c} expected {n}, found {m}" for c, (n, m) in wrong.items()))
