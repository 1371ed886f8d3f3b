"""Panel, region and profile files, stage tables and result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .slides import path_exists

# fixed column names of panel files
PANEL_COLUMNS = {"Genes": "gene", "Ensembl_ID": "ensembl_id", "Num_Probesets": "n_probesets", "Annotation": "annotation"}
ROI_SCHEMA = ("slide_id string, roi_name string, vertices array<array<double>>, n_cells_selected int, created_at string, "
              "method string, bbox struct<x_min: double, x_max: double, y_min: double, y_max: double>")


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """Base panel: four required columns, the first row of a repeated gene wins."""
    raw = spark.read.csv(path, header=True)
    missing = [c for c in PANEL_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    named = raw.select(*[F.col(a).alias(b) for a, b in PANEL_COLUMNS.items()], F.monotonically_increasing_id().alias("_n"))
    first = F.row_number().over(W.partitionBy("gene").orderBy("_n"))
    return named.withColumn("_r", first).filter("_r = 1").select(
        "gene", "ensembl_id", F.col("n_probesets").cast("int").alias("n_probesets"), "annotation")


def _usable():
    """At least three vertices, every one a pair of finite numbers."""
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return F.coalesce((F.size("vertices") >= 3) & F.forall("vertices", lambda p: (F.size(p) == 2) & number(p[0]) & number(p[1])), F.lit(False))


def _as_points(df: DataFrame) -> DataFrame:
    return df.withColumn("vertices", F.transform("vertices", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))


def read_rois(spark: SparkSession, path: str) -> DataFrame:
    """Every ``*_roi.json`` of a folder, one polygon per file."""
    raw = spark.read.schema(ROI_SCHEMA).option("multiLine", True).option("pathGlobFilter", "*_roi.json").json(path)
    return _as_points(raw.filter(_usable()))


def list_rois(rois: DataFrame) -> DataFrame:
    return rois.select("slide_id", "roi_name", F.size("vertices").alias("n_vertices"), F.col("n_cells_selected").alias("n_cells"), "created_at")


def roi_file_stem(slide_id):
    """File-name-safe slide id: slashes and spaces become underscores."""
    return F.translate(slide_id, "/ ", "__")


def roi_records(rois: DataFrame, selected: DataFrame | None = None, method: str = "import") -> DataFrame:
    """Region rows in their stored form: vertex pairs, bounds, cell count and creation time."""
    from ..operators.roi import with_bounds

    base = with_bounds(rois)
    base = base.join(selected, "slide_id", "left") if selected is not None else base.withColumn("n_cells_selected", F.lit(None).cast("int"))
    return base.select(
        "slide_id", "roi_name", F.transform("vertices", lambda p: F.array(p["x"], p["y"])).alias("vertices"), "n_cells_selected",
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), F.lit(method).alias("method"),
        F.struct("x_min", "x_max", "y_min", "y_max").alias("bbox"))


def write_rois(rois: DataFrame, path: str, selected: DataFrame | None = None) -> None:
    """One JSON object per slide under ``path/slide=<safe id>``."""
    roi_records(rois, selected).withColumn("slide", roi_file_stem(F.col("slide_id"))).write.mode("append").partitionBy("slide").json(path)


def read_stored_rois(spark: SparkSession, path: str) -> DataFrame:
    return _as_points(spark.read.schema(ROI_SCHEMA).json(path).filter(_usable()).select(
        "slide_id", "roi_name", "vertices", "n_cells_selected", "created_at", "method", "bbox"))


def import_rois(df: DataFrame, column: str = "json") -> tuple[DataFrame, DataFrame]:
    """Bulk export text (slide_id -> region) to (accepted, rejected); fewer than three or malformed vertices reject."""
    entry = "map<string, struct<vertices: array<array<double>>, roi_name: string, n_cells_selected: int, exported_at: string>>"
    rows = df.select(F.explode(F.from_json(column, entry)).alias("slide_id", "r")).select(
        "slide_id", F.coalesce("r.roi_name", F.lit("imported")).alias("roi_name"), F.col("r.vertices").alias("vertices"))
    return _as_points(rows.filter(_usable())), rows.filter(~_usable()).select("slide_id", "roi_name")


def export_rois(rois: DataFrame) -> DataFrame:
    """The bulk text form of all regions as one JSON object; regions are a few per study."""
    entry = F.struct(F.transform("vertices", lambda p: F.array(p["x"], p["y"])).alias("vertices"), "roi_name")
    return rois.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("slide_id", entry)))).alias("json"))


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """Reference profile CSV (first column gene, one column per cell type) in long form."""
    raw = spark.read.csv(path, header=True)
    gene, types = raw.columns[0], raw.columns[1:]
    typed = raw.select(F.col(f"`{gene}`").alias("gene"), *[F.col(f"`{t}`").cast("double").alias(t) for t in types])
    return typed.unpivot("gene", types, "cell_type", "value")


def shared_genes(profile: DataFrame, genes: DataFrame, least: int = 20) -> DataFrame:
    """Number of profile genes on the panel and whether that is too few to trust."""
    shared = profile.select("gene").distinct().join(genes.select("gene").distinct(), "gene", "left_semi")
    return shared.agg(F.count(F.lit(1)).alias("n_shared")).withColumn("too_few", F.col("n_shared") < least)


# ---- stage tables and sinks --------------------------------------------------------------------------------

def stage(spark: SparkSession, path: str, build, partition_by: str | None = None, rebuild: bool = False) -> DataFrame:
    """Read a finished, non-empty stage table or build and write it; an empty result is an error."""
    if not rebuild and path_exists(spark, f"{path}/_SUCCESS"):
        cached = spark.read.parquet(path)
        if not cached.isEmpty():
            return cached
    writer = build().write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    written = spark.read.parquet(path)
    if written.isEmpty():
        raise ValueError(f"{path}: no rows; check the regions and the quality thresholds")
    return written


def land_study(spark: SparkSession, slides: DataFrame, root: str, rois: DataFrame | None = None, rebuild: bool = False, min_share: float = 0.0):
    """Slide directories to Parquet partitioned by slide: (cells, counts, features), regions applied to the cells.

    A slide whose cell table matches fewer than ``min_share`` of its barcodes is an error.
    """
    from ..operators.roi import apply_rois
    from ..schemas import CELL_KEY
    from .slides import read_study

    cells, counts, features = read_study(spark, slides, min_share=min_share)
    features = stage(spark, f"{root}/features", lambda: features, "slide_id", rebuild)
    kept = stage(spark, f"{root}/cells", lambda: apply_rois(cells, rois) if rois is not None else cells, "slide_id", rebuild)
    inside = counts.join(kept.select(*CELL_KEY), CELL_KEY, "left_semi") if rois is not None else counts
    return kept, stage(spark, f"{root}/counts", lambda: inside, "slide_id", rebuild), features


def land_panel(spark: SparkSession, slides: DataFrame, counts: DataFrame, features: DataFrame, panel: DataFrame, root: str, config,
               expected: dict[str, int] | None = None, rebuild: bool = False):
    """Panel stage of a study: (harmonised counts, gene annotation, panel validation), the first two as stage tables.

    ``expected`` holds the number of slides per condition; another number is an error.
    """
    from ..operators.panel import harmonise, validate_panel
    from .manifest import check_replicates

    if expected:
        check_replicates(slides, expected)
    aligned, meta = harmonise(counts, features, panel, slides, config.harmonise_mode, config.min_slides)
    return (stage(spark, f"{root}/counts_harmonised", lambda: aligned, "slide_id", rebuild),
            stage(spark, f"{root}/gene_meta", lambda: meta, None, rebuild), validate_panel(features, panel, slides))


def write_results(tables: dict[str, DataFrame], root: str, fmt: str = "csv") -> dict[str, int]:
    """Each result table under ``root/<name>``; rows are counted while they are written."""
    from pyspark.sql import Observation

    rows = {}
    for name, table in tables.items():
        seen = Observation(name)
        flat = table
        if fmt == "csv":
            nested = [f.name for f in table.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
            for c in nested:
                flat = flat.withColumn(c, F.to_json(c))
        observed = flat.observe(seen, F.count(F.lit(1)).alias("rows"))
        writer = observed.write.mode("overwrite")
        (writer.option("header", True).csv if fmt == "csv" else writer.parquet)(f"{root}/{name}")
        rows[name] = seen.get["rows"]
    return rows


def run_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts per result table, as one table."""
    parts = [t.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("result"), "n_rows") for n, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
