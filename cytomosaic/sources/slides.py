"""Slide directories: sparse matrix, barcodes, features, cell table, run metadata and transcripts.

All slides are read in one plan per file kind; the file path, not a driver loop, ties rows to their slide. Gzip files
cannot be split, so a study is landed once as Parquet (``land_study``) and analysed from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.panel import keep_expression_features

# fixed names that must match the instrument output
MATRIX = "cell_feature_matrix/matrix.mtx.gz"
BARCODES = "cell_feature_matrix/barcodes.tsv.gz"
FEATURES = "cell_feature_matrix/features.tsv.gz"
CELL_FILES = ["cells.parquet", "cells.csv.gz", "cells.csv"]
TRANSCRIPTS = "transcripts.parquet"
ID_COLUMNS = ["cell_id", "Cell ID", "cellid", "CellID"]
X_NAMES = {"centroid_x", "x_centroid", "x", "centroid_x_um", "cell_centroid_x", "x_um"}
Y_NAMES = {"centroid_y", "y_centroid", "y", "centroid_y_um", "cell_centroid_y", "y_um"}
OPTIONAL = {"cell_area": "double", "control_probe_counts": "int", "control_codeword_counts": "int"}


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def _bare(path: Column) -> Column:
    """Path without scheme and trailing slash, so that manifest entries and scanned files compare equal."""
    return F.regexp_replace(F.regexp_replace(path, "^[A-Za-z0-9]+:/+", "/"), "/+$", "")


def _with_slide(files: DataFrame, slides: DataFrame, relative: str) -> DataFrame:
    home = F.regexp_replace(_bare(F.col("_path")), f"/{relative}$", "")
    lookup = slides.select("slide_id", _bare(F.col("run_dir")).alias("_home"))
    return files.withColumn("_home", home).join(lookup, "_home").drop("_home", "_path")


def _paths(slides: DataFrame, relative: str) -> list[str]:
    return [f"{r.run_dir.rstrip('/')}/{relative}" for r in slides.select("run_dir").collect()]  # one row per slide


def _numbered(scan: DataFrame, out: str) -> DataFrame:
    """0-based row number within the file, whatever the file splits.

    ``scan`` carries _path, _block (start of the split) and _n, an id that rises by one within a split. A split's rows start at the
    total of the file's earlier splits; only one row per split is ranked.
    """
    blocks = scan.groupBy("_path", "_block").agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = W.partitionBy("_path").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.select("_path", "_block", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return scan.join(starts, ["_path", "_block"]).withColumn(out, F.col("_n") + F.col("_shift")).drop("_block", "_n", "_shift")


def _place() -> list[Column]:
    return [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_n")]


def _lines(spark: SparkSession, slides: DataFrame, relative: str) -> DataFrame:
    """Text lines with their 0-based position in the file."""
    raw = spark.read.text(_paths(slides, relative)).select("value", *_place())
    return _with_slide(_numbered(raw, "line"), slides, relative)


def read_features(spark: SparkSession, slides: DataFrame) -> DataFrame:
    part = F.split("value", "\t")
    table = _lines(spark, slides, FEATURES).select(
        "slide_id", F.col("line").alias("feature_idx"), part[0].alias("gene_id"), part[1].alias("gene"), part[2].alias("feature_type"))
    return unique_names(table, "gene", ["slide_id"], "feature_idx")


def read_barcodes(spark: SparkSession, slides: DataFrame) -> DataFrame:
    return _lines(spark, slides, BARCODES).select("slide_id", F.col("line").alias("cell_idx"), F.trim(F.split("value", "\t")[0]).alias("barcode"))


def unique_names(df: DataFrame, name: str, by: list[str], order: str) -> DataFrame:
    """Repeated names get -1, -2, ... in file order; repeats of one gene name on a panel are few."""
    repeat = F.row_number().over(W.partitionBy(*by, name).orderBy(order)) - 1
    return df.withColumn("_r", repeat).withColumn(
        name, F.when(F.col("_r") > 0, F.concat_ws("-", F.col(name), F.col("_r"))).otherwise(F.col(name))).drop("_r")


def read_matrix(spark: SparkSession, slides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries(slide_id, feature_idx, cell_idx, count), sizes(slide_id, n_features, n_cells, n_entries)); indices 0-based."""
    raw = spark.read.text(_paths(slides, MATRIX)).select("value", F.col("_metadata.file_path").alias("_path"), F.monotonically_increasing_id().alias("_n"))
    body = raw.filter(~F.col("value").startswith("%"))
    head = body.groupBy("_path").agg(F.min("_n").alias("_head"))
    part = F.split(F.trim("value"), r"\s+")
    numbered = body.join(head, "_path").select("_path", (F.col("_n") == F.col("_head")).alias("is_size"), part.alias("p"))
    sizes = numbered.filter("is_size").select("_path", *[F.col("p")[i].cast("bigint").alias(c) for i, c in enumerate(("n_features", "n_cells", "n_entries"))])
    entries = numbered.filter("NOT is_size").select(
        "_path", (F.col("p")[0].cast("bigint") - 1).alias("feature_idx"), (F.col("p")[1].cast("bigint") - 1).alias("cell_idx"),
        F.col("p")[2].cast("double").alias("count"))
    return _with_slide(entries, slides, MATRIX), _with_slide(sizes, slides, MATRIX)


def check_shapes(sizes: DataFrame, features: DataFrame, barcodes: DataFrame) -> None:
    """Matrix dimensions must equal features x barcodes on every slide."""
    f = features.groupBy("slide_id").agg(F.count(F.lit(1)).alias("f"))
    b = barcodes.groupBy("slide_id").agg(F.count(F.lit(1)).alias("b"))
    bad = sizes.join(f, "slide_id", "left").join(b, "slide_id", "left").filter("NOT (n_features <=> f AND n_cells <=> b)").collect()
    if bad:
        raise ValueError("matrix shape differs from features x barcodes on " + ", ".join(
            f"{r.slide_id} ({r.n_features} x {r.n_cells} vs {r.f} x {r.b})" for r in bad))


def _standard_columns(df: DataFrame) -> DataFrame:
    """Centroid aliases to x / y, the id column to cell_key, optional columns to typed columns (NULL when absent)."""
    by_lower = {c.lower(): c for c in df.columns}
    find = lambda names: next((by_lower[n] for n in sorted(names) if n in by_lower), None)
    x, y = find(X_NAMES), find(Y_NAMES)
    key = next((c for c in ID_COLUMNS if c in df.columns), None)
    pick = lambda c, kind: (F.col(f"`{c}`") if c else F.lit(None)).cast(kind)
    return df.select(
        "_path", "row_index", pick(key, "string").alias("cell_key"), pick(x, "double").alias("x"), pick(y, "double").alias("y"),
        *[pick(c if c in df.columns else None, kind).alias(c) for c, kind in OPTIONAL.items()])


def read_cell_tables(spark: SparkSession, slides: DataFrame) -> DataFrame:
    """Cell tables in the first format each slide offers; slides without one are simply missing here."""
    by_format: dict[str, list[str]] = {}
    for r in slides.select("run_dir").collect():
        root = r.run_dir.rstrip("/")
        found = next((name for name in CELL_FILES if path_exists(spark, f"{root}/{name}")), None)
        if found:
            by_format.setdefault(found, []).append(f"{root}/{found}")
    tables = None
    for name, paths in by_format.items():
        if name.endswith(".parquet"):
            groups = _same_columns(spark, paths)
        else:
            groups = [[p] for p in paths]  # header rows may differ between files
        for group in groups:
            if name.endswith(".parquet"):
                scan = spark.read.parquet(*group).select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("row_index"))
            else:
                scan = _numbered(spark.read.csv(group, header=True).select("*", *_place()), "row_index")
            part = _with_slide(_standard_columns(scan), slides, name)
            tables = part if tables is None else tables.unionByName(part)
    if tables is None:
        return spark.createDataFrame([], "row_index bigint, cell_key string, x double, y double, cell_area double, control_probe_counts int, "
                                         "control_codeword_counts int, slide_id string")
    return tables


def _same_columns(spark: SparkSession, paths: list[str]) -> list[list[str]]:
    groups: dict[tuple, list[str]] = {}
    for p in paths:
        groups.setdefault(tuple(spark.read.parquet(p).dtypes), []).append(p)
    return list(groups.values())


STRATEGIES = ["id", "index", "zero_based", "positional"]


def align_cells(barcodes: DataFrame, tables: DataFrame, allow_positional: bool = False, min_share: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Barcodes with their cell attributes, and per slide the strategy, the barcodes matched and their share.

    Tried in order: id column, row index as text, 1-based barcode to 0-based row, position (opt-in). The strategy that
    matches most barcodes of the slide wins, the earlier one on ties; a slide with a table but no match, or with a smaller matched
    share than ``min_share``, is an error.
    """
    number = F.col("barcode").try_cast("bigint")
    left_keys = {"id": F.col("barcode"), "index": F.col("barcode"), "zero_based": (number - 1).cast("string"), "positional": F.col("cell_idx").cast("string")}
    right_keys = {"id": F.col("cell_key"), "index": F.when(F.col("cell_key").isNull(), F.col("row_index").cast("string")),
                  "zero_based": F.col("row_index").cast("string"), "positional": F.col("row_index").cast("string")}
    names = STRATEGIES if allow_positional else STRATEGIES[:3]
    long = lambda df, keys, extra: df.select(*extra, F.explode(F.array(*[
        F.struct(F.lit(i).alias("strategy"), keys[n].alias("k")) for i, n in enumerate(names)])).alias("s")).select(*extra, "s.strategy", "s.k").filter("k IS NOT NULL")
    asked = long(barcodes, left_keys, ["slide_id", "cell_idx", "barcode"])
    attributes = [c for c in tables.columns if c not in ("slide_id", "cell_key", "row_index")]
    offered = long(tables, right_keys, ["slide_id", *attributes])
    matched = asked.join(offered, ["slide_id", "strategy", "k"])
    counts = matched.groupBy("slide_id", "strategy").agg(F.count(F.lit(1)).alias("n"))
    chosen = counts.groupBy("slide_id").agg(F.min_by(F.struct("strategy", "n"), F.struct(-F.col("n"), "strategy")).alias("c")).select("slide_id", "c.strategy", "c.n")
    lost = tables.select("slide_id").distinct().join(chosen, "slide_id", "left_anti").collect()
    if lost:
        raise ValueError("no cell of the table matches a barcode on " + ", ".join(sorted(r.slide_id for r in lost)))
    sizes = barcodes.groupBy("slide_id").agg(F.count(F.lit(1)).alias("n_barcodes"))
    chosen = chosen.join(sizes, "slide_id").withColumn("share", F.col("n") / F.col("n_barcodes"))
    if min_share > 0:
        poor = chosen.filter(F.col("share") < min_share).collect()
        if poor:
            raise ValueError("too few barcodes matched on " + ", ".join(f"{r.slide_id} ({r.n} of {r.n_barcodes})" for r in sorted(poor, key=lambda r: r.slide_id)))
    used = matched.join(chosen.select("slide_id", "strategy"), ["slide_id", "strategy"]).select("slide_id", "cell_idx", *attributes)
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("strategy") + 1)
    return barcodes.join(used, ["slide_id", "cell_idx"], "left"), chosen.select(
        "slide_id", label.alias("strategy"), F.col("n").alias("n_matched"), F.col("share").alias("matched_share"))


def read_run_metadata(spark: SparkSession, slides: DataFrame, file_name: str) -> DataFrame:
    """One row per slide with its JSON run description as text and as a string map."""
    raw = spark.read.text(_paths(slides, file_name), wholetext=True).select("value", F.col("_metadata.file_path").alias("_path"))
    return _with_slide(raw, slides, file_name.replace(".", r"\.")).select(
        "slide_id", F.col("value").alias("json"), F.from_json("value", "map<string,string>").alias("entries"))


def read_transcripts(spark: SparkSession, slides: DataFrame) -> DataFrame:
    """Per-molecule tables, lazily; columns stay as written and pruning reaches the scan."""
    scan = spark.read.option("mergeSchema", True).parquet(*_paths(slides, TRANSCRIPTS)).select("*", F.col("_metadata.file_path").alias("_path"))
    return _with_slide(scan, slides, TRANSCRIPTS)


def read_study(spark: SparkSession, slides: DataFrame, allow_positional: bool = False, min_share: float = 0.0):
    """(cells, counts, features) of all slides with study-wide cell ids ``slide__barcode``; control features dropped from counts."""
    features, barcodes = read_features(spark, slides), read_barcodes(spark, slides)
    entries, sizes = read_matrix(spark, slides)
    check_shapes(sizes, features, barcodes)
    aligned, _ = align_cells(barcodes, read_cell_tables(spark, slides), allow_positional, min_share)
    labelled = unique_names(aligned, "barcode", ["slide_id"], "cell_idx").withColumn("cell_id", F.concat_ws("__", "slide_id", "barcode"))
    cells = labelled.join(slides.select("slide_id", "condition", F.coalesce("replicate_id", "slide_id").alias("replicate_id")), "slide_id").drop("barcode", "cell_idx")
    named = entries.join(features.select("slide_id", "feature_idx", "gene"), ["slide_id", "feature_idx"])
    real = keep_expression_features(named, features).filter("count <> 0")
    counts = real.join(labelled.select("slide_id", "cell_idx", "cell_id"), ["slide_id", "cell_idx"]).select(
        "slide_id", "cell_id", "gene", F.col("count").cast("int").alias("count"))
    return cells, counts, features


def union_studies(first: DataFrame, second: DataFrame) -> DataFrame:
    """Outer union of two table sets; absent genes need no zero rows in sparse form, absent columns become NULL."""
    return first.unionByName(second, allowMissingColumns=True)


def prefix_cells(df: DataFrame, label: str) -> DataFrame:
    """Cell ids made unique across runs: ``label__id``."""
    return df.withColumn("cell_id", F.concat_ws("__", F.lit(label), F.col("cell_id")))


def two_condition_runs(spark: SparkSession, dir_a: str, dir_b: str, label_a: str, label_b: str):
    """Two runs as a study with one slide per condition: (cells, counts, features). Tests on it have no replicates."""
    from .manifest import from_rows

    return read_study(spark, from_rows(spark, [
        {"slide_id": label_a, "condition": label_a, "run_dir": dir_a}, {"slide_id": label_b, "condition": label_b, "run_dir": dir_b}]))
