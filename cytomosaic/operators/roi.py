"""Regions of interest: polygon and rectangle filters as native expressions over vertex arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def point_in_polygon(x: Column, y: Column, vertices: Column) -> Column:
    """Even-odd rule with half-open edges: an edge counts when exactly one end lies above the point."""
    n = F.size(vertices)
    shifted = F.concat(F.slice(vertices, F.lit(2), n - 1), F.slice(vertices, 1, 1))
    crosses = F.zip_with(vertices, shifted, lambda a, b: (
        ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])))
    return F.aggregate(crosses, F.lit(False), lambda acc, hit: acc != F.coalesce(hit, F.lit(False)))


def with_bounds(rois: DataFrame) -> DataFrame:
    xs, ys = F.col("vertices.x"), F.col("vertices.y")
    return rois.select("*", F.array_min(xs).alias("x_min"), F.array_max(xs).alias("x_max"),
                       F.array_min(ys).alias("y_min"), F.array_max(ys).alias("y_max"))


def tag_inside(cells: DataFrame, rois: DataFrame) -> DataFrame:
    """Left join of each slide's region; ``inside`` is NULL for slides without one. Bounds short-circuit the ray cast."""
    region = with_bounds(rois).select("slide_id", "roi_name", "vertices", "x_min", "x_max", "y_min", "y_max")
    joined = cells.join(region, "slide_id", "left")
    box = F.col("x").between(F.col("x_min"), F.col("x_max")) & F.col("y").between(F.col("y_min"), F.col("y_max"))
    inside = F.when(F.col("vertices").isNull(), F.lit(None).cast("boolean")).when(~box, False).otherwise(
        point_in_polygon(F.col("x"), F.col("y"), F.col("vertices")))
    return joined.withColumn("inside", inside).drop("vertices", "x_min", "x_max", "y_min", "y_max")


def apply_rois(cells: DataFrame, rois: DataFrame, invert: bool = False) -> DataFrame:
    """Cells inside (or outside) their slide's region; slides without a region pass whole."""
    tagged = tag_inside(cells, rois)
    keep = F.col("inside") != F.lit(invert)
    return tagged.filter(F.col("inside").isNull() | keep).drop("inside")


def bounding_box(cells: DataFrame, x_min: float, x_max: float, y_min: float, y_max: float) -> DataFrame:
    return cells.filter(F.col("x").between(x_min, x_max) & F.col("y").between(y_min, y_max))


def region_dge(expr: DataFrame, cells: DataFrame, box: tuple[float, float, float, float], reference: str, test: str,
               method: str = "stringent_wilcoxon", **options) -> DataFrame:
    """Differential expression inside a rectangle."""
    from ..schemas import CELL_KEY
    from .dge import run_dge

    inside = bounding_box(cells, *box)
    return run_dge(expr.join(inside.select(*CELL_KEY), CELL_KEY, "left_semi"), inside, reference, test, method, **options)


def yield_summary(cells: DataFrame, rois: DataFrame) -> DataFrame:
    """Cells inside / total / percent per slide, with flags for empty and for oversized regions."""
    pct = F.round(100.0 * F.col("n_inside") / F.col("n_total"), 2)
    return tag_inside(cells, rois).groupBy("slide_id").agg(
        F.count_if(F.coalesce("inside", F.lit(True))).alias("n_inside"), F.count(F.lit(1)).alias("n_total"),
    ).withColumn("pct", pct).withColumn(
        "flag", F.when(F.col("n_inside") == 0, "empty").when(F.col("pct") > 60, "large").otherwise("ok"))


def default_rectangles(cells: DataFrame, fx=(0.35, 0.65), fy=(0.55, 0.80)) -> DataFrame:
    """Rectangle polygons at fixed fractions of each slide's extent."""
    ext = cells.groupBy("slide_id").agg(
        F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))
    at = lambda lo, hi, f: F.col(lo) + (F.col(hi) - F.col(lo)) * f
    box = ext.select("slide_id", at("_x0", "_x1", fx[0]).alias("x_min"), at("_x0", "_x1", fx[1]).alias("x_max"),
                     at("_y0", "_y1", fy[0]).alias("y_min"), at("_y0", "_y1", fy[1]).alias("y_max"))
    return rectangle_polygons(box)


def rectangle_polygons(boxes: DataFrame) -> DataFrame:
    corner = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    ring = F.array(corner("x_min", "y_min"), corner("x_max", "y_min"), corner("x_max", "y_max"), corner("x_min", "y_max"))
    return boxes.withColumn("vertices", ring).withColumn("roi_name", F.lit("rectangle"))
