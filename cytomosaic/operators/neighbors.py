"""Exact nearest-neighbour joins.

Spatial: points collapse to distinct locations, and each slide is cut into tiles of bounded load, once. Every location meets its
own tile first; only if the circle of its k-th distance leaves the tile does it also ask the other tiles that the circle reaches,
which it finds through an index of the tiles at every grid level. Nothing is capped. Embedding: vectors are cut into bounded
blocks around pivots, block pairs that the triangle inequality rules out are never compared, and only top-k rows leave a block pair.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from . import pairs
from .pairs import numbers

FINEST = 26  # bits per axis of the finest grid
#: Targets of a tile, and locations that meet them in one task.
TILE, ASKING = 512, 8192
_LEAF = ["slide_id", "level", "gx", "gy"]
_NEAR = "array<struct<d2:double,dst:string>>"


def _locations(points: DataFrame, keep: int) -> DataFrame:
    """Rows that can be somebody's neighbour: the ``keep`` smallest ids of each location (window limit runs map-side)."""
    rank = F.row_number().over(W.partitionBy("slide_id", "x", "y").orderBy("cell_id"))
    return points.select("slide_id", "cell_id", "x", "y").withColumn("_rn", rank).filter(F.col("_rn") <= keep)


def _tile(level: str, axis: str):
    return F.expr(f"shiftright({axis}, {FINEST} - {level})")


def spatial_knn(points: DataFrame, k: int, targets: DataFrame | None = None, pool_slides: bool = False,
                exclude_self: bool = True) -> DataFrame:
    """k nearest points (same slide unless pooled) as rows (slide_id, src, dst, dist, rank); ties go to the smaller id.

    ``targets`` restricts the build side (nearest-of-class); ids must be unique across slides when pooling.
    """
    located = ~F.isnan("x") & ~F.isnan("y")  # NULL coordinates fail the test as well
    home = points.select("slide_id", "cell_id", "x", "y").filter(located)
    scope = (lambda df: df.withColumn("slide_id", F.lit("all"))) if pool_slides else (lambda df: df)
    sources, build = scope(home), scope((targets if targets is not None else home).select(
        "slide_id", "cell_id", "x", "y").filter(located))
    want = k + 1 if exclude_self else k
    per_location = _nearest(sources, build, want)
    asked = sources.join(per_location, ["slide_id", "x", "y"])
    near = F.filter("near", lambda n: n["dst"] != F.col("cell_id")) if exclude_self else F.col("near")
    rows = asked.select("slide_id", F.col("cell_id").alias("src"), F.posexplode(F.slice(near, 1, k)).alias("_p", "n")).select(
        "slide_id", "src", F.col("n.dst").alias("dst"), F.sqrt("n.d2").alias("dist"), (F.col("_p") + 1).alias("rank"))
    if pool_slides:
        rows = rows.drop("slide_id").join(home.select("slide_id", F.col("cell_id").alias("src")), "src")
        rows = rows.select("slide_id", "src", "dst", "dist", "rank")
    return rows


def _nearest(sources: DataFrame, build: DataFrame, want: int) -> DataFrame:
    """(slide_id, x, y, near): the ``want`` nearest targets of every distinct source location, by distance and id."""
    extent = sources.select("slide_id", "x", "y").unionByName(build.select("slide_id", "x", "y")).groupBy("slide_id").agg(
        F.min("x").alias("_x0"), F.min("y").alias("_y0"), F.max("x").alias("_x1"), F.max("y").alias("_y1"))
    size = build.groupBy("slide_id").agg(F.count(F.lit(1)).alias("_m"))
    span = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"))
    start = F.floor(F.log2(F.greatest(F.col("_m") * 4.0 / TILE, F.lit(1.0))) / 2.0).cast("int")
    frame = cut(extent.join(size, "slide_id").select(  # one row per slide
        "slide_id", "_x0", "_y0", F.when(span > 0, span).otherwise(F.lit(1.0)).alias("_ext"), F.least(start, F.lit(FINEST)).alias("level")))
    side = F.lit(float(2**FINEST))
    at = lambda c, lo: F.least(F.floor((F.col(c) - F.col(lo)) / F.col("_ext") * side), side - 1).cast("bigint")
    place = lambda df: df.join(frame, "slide_id").withColumn("ix", at("x", "_x0")).withColumn("iy", at("y", "_y0")).drop("_x0", "_y0", "_ext")
    both = _locations(build, want).select("slide_id", "x", "y", F.col("cell_id").alias("dst"), F.lit(0).alias("kind")).unionByName(
        sources.select("slide_id", "x", "y").distinct().select("slide_id", "x", "y", F.lit(None).cast("string").alias("dst"), F.lit(1).alias("kind")))
    work = _tiled(cut(place(both)))
    target = F.col("kind") == 0
    edge = lambda f, c, name: f(F.when(target, F.col(c))).alias(name)
    leaves = cut(work.groupBy(*_LEAF).agg(F.count_if(target).alias("n"), F.count_if(~target).alias("s"), edge(F.min, "x", "x0"), edge(F.max, "x", "x1"),
                                          edge(F.min, "y", "y0"), edge(F.max, "y", "y1")))
    first = cut(_met(work.withColumn("ub", F.lit(None).cast("double")), leaves.select(*_LEAF, "s"), want).join(frame.drop("level"), "slide_id"))
    # the circle of the k-th distance stays inside the tile, whose sides on the rim of the grid have nothing beyond
    width, last = F.col("_ext") / F.pow(F.lit(2.0), F.col("level").cast("double")), F.pow(F.lit(2.0), F.col("level").cast("double")) - 1
    free = lambda c, lo, g: F.least(F.when(F.col(g) > 0, F.col(c) - (F.col(lo) + F.col(g) * width)).otherwise(F.lit(float("inf"))),
                                    F.when(F.col(g) < last, F.col(lo) + (F.col(g) + 1) * width - F.col(c)).otherwise(F.lit(float("inf"))))
    reach = F.when(F.size("near") >= want, F.sqrt(F.element_at("near", -1)["d2"]))
    held = F.coalesce(reach < F.least(free("x", "_x0", "gx"), free("y", "_y0", "gy")) * (1.0 - 1e-9), F.lit(False))
    first = first.withColumn("reach", reach * (1.0 + 1e-9)).withColumn("held", held)
    asks = cut(_asks(first.filter("NOT held"), leaves, want))
    load = asks.groupBy(*_LEAF).agg(F.count(F.lit(1)).alias("s"))
    shelf = work.filter(target).join(load.drop("s"), _LEAF, "left_semi").select(*_LEAF, "x", "y", "dst", "kind", F.lit(None).cast("double").alias("ub"))
    second = _met(shelf.unionByName(asks.select(*_LEAF, "x", "y", F.lit(None).cast("string").alias("dst"), F.lit(1).alias("kind"), "ub")), load, want)
    open_ = first.filter("NOT held").select("slide_id", "x", "y", "near").unionByName(second.select("slide_id", "x", "y", "near"))
    merged = open_.groupBy("slide_id", "x", "y").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, want).alias("near"))
    return first.filter("held").select("slide_id", "x", "y", "near").unionByName(merged)


def _tiled(work: DataFrame) -> DataFrame:
    """``work`` with the tile of each row (level, gx, gy): crowded tiles are split until none holds more than TILE targets.

    Tiles of a single location at the finest grid stay; a location is never more than the wanted number of rows.
    """
    while True:
        placed = work.withColumn("gx", _tile("level", "ix")).withColumn("gy", _tile("level", "iy"))
        crowded = placed.filter("kind = 0").groupBy(*_LEAF).agg(
            F.count(F.lit(1)).alias("_n"), F.greatest(F.max("ix") - F.min("ix"), F.max("iy") - F.min("iy")).alias("_w")).filter(
            (F.col("_n") > TILE) & (F.col("level") < FINEST))
        # go straight to tiles of the clump's own extent, split further by its load
        fit = FINEST - F.ceil(F.log2(F.col("_w") + 1.0)) + F.floor(F.log2(F.col("_n") * 4.0 / TILE) / 2.0)
        crowded = cut(crowded.withColumn("_to", F.least(F.greatest(fit, F.col("level") + 1), F.lit(FINEST)).cast("int")).drop("_n", "_w"))
        if crowded.isEmpty():
            return placed
        work = cut(placed.join(crowded, _LEAF, "left").withColumn("level", F.coalesce("_to", "level")).drop("_to", "gx", "gy"))


def _met(rows: DataFrame, load: DataFrame, want: int) -> DataFrame:
    """(slide_id, level, gx, gy, x, y, near): every asking row (kind 1) with the nearest targets (kind 0) of its tile, up to its ``ub``.

    Tiles from which more than ASKING rows ask (``load``: s per tile) are dealt to several tasks, each with all the tile's targets.
    """
    split = load.filter(F.col("s") > ASKING).select(*_LEAF, F.ceil(F.col("s") / ASKING).cast("int").alias("_c"))
    own = F.array(F.pmod(F.xxhash64("x", "y"), F.col("_c")).cast("int"))
    rows = rows.join(split, _LEAF, "left").withColumn("salt", F.explode(F.when(F.col("_c").isNull(), F.array(F.lit(0))).when(
        F.col("kind") == 0, F.sequence(F.lit(0), F.col("_c") - 1)).otherwise(own))).drop("_c")

    def meet(table: pa.Table) -> pa.Table:
        kind, x, y = (table[c].to_numpy() for c in ("kind", "x", "y"))
        ask, hold = np.flatnonzero(kind == 1), np.flatnonzero(kind == 0)
        ids = np.array(table["dst"].take(pa.array(hold)).to_pylist(), object)
        order = np.argsort(ids, kind="stable")
        ids, tx, ty = ids[order], x[hold][order], y[hold][order]
        limit = table["ub"].to_numpy()[ask].astype(float)
        limit = np.where(np.isnan(limit), np.inf, limit * limit * (1.0 + 1e-9))
        found = [np.zeros((3, 0))]
        for at in range(0, len(ask) if len(ids) else 0, 256):
            sx, sy = x[ask[at:at + 256], None], y[ask[at:at + 256], None]
            d2 = (sx - tx) * (sx - tx) + (sy - ty) * (sy - ty)
            top = limit[at:at + 256]
            if len(ids) > want:
                top = np.minimum(top, np.partition(d2, want - 1, axis=1)[:, want - 1])
            row, column = np.nonzero(d2 <= top[:, None])
            dist = d2[row, column]
            by = np.lexsort((column, dist, row))  # ties go to the smaller id
            row, column, dist = row[by], column[by], dist[by]
            starts = np.searchsorted(row, np.arange(len(sx)))
            keep = np.arange(len(row)) - starts[row] < want
            found.append(np.stack((row[keep] + at, column[keep], dist[keep])))
        row, column, dist = np.concatenate(found, axis=1)
        offsets = np.concatenate(([0], np.cumsum(np.bincount(row.astype(np.int64), minlength=len(ask))))).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(dist), pa.array(ids[column.astype(np.int64)].tolist(), pa.string())], ["d2", "dst"])
        out = table.select([*_LEAF, "x", "y"]).take(pa.array(ask))
        return out.append_column("near", pa.ListArray.from_arrays(pa.array(offsets), pairs))

    kind = rows.schema["slide_id"].dataType.simpleString()
    return rows.select(*_LEAF, "salt", "x", "y", "dst", "kind", "ub").groupBy(*_LEAF, "salt").applyInArrow(
        meet, f"slide_id {kind}, level int, gx bigint, gy bigint, x double, y double, near {_NEAR}")


def _asks(pending: DataFrame, leaves: DataFrame, want: int) -> DataFrame:
    """(slide_id, level, gx, gy, x, y, ub): the other tiles that the circle around each pending location may reach.

    The radius is the k-th distance in the own tile or, with fewer than k targets there, the farthest corner of the smallest block
    of tiles around it that holds k (all of the slide, if it has fewer). The circle covers at most 3 x 3 tiles of the grid level at
    which tiles are as wide as the radius; there it finds the tiles of that level and below, and on coarser levels those of
    exactly that level.
    """
    full = leaves.filter("n > 0")
    blocks = full.withColumn("l", F.explode(F.sequence(F.lit(0), F.col("level")))).withColumn(
        "bx", F.expr("shiftright(gx, level - l)")).withColumn("by", F.expr("shiftright(gy, level - l)"))
    blocks = blocks.select("slide_id", "l", "bx", "by", "n", "x0", "x1", "y0", "y1", F.col("level").alias("leaf_level"), F.col("gx").alias("leaf_x"),
                           F.col("gy").alias("leaf_y"))
    short = pending.filter("reach IS NULL")
    sums = blocks.groupBy("slide_id", "l", "bx", "by").agg(F.sum("n").alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"),
                                                           F.max("y1").alias("y1")).filter(F.col("n") >= want)
    far = lambda c: F.greatest(F.abs(F.col(c) - F.col(f"{c}0")), F.abs(F.col(f"{c}1") - F.col(c)))
    up = short.withColumn("l", F.explode(F.sequence(F.lit(0), F.col("level")))).withColumn("bx", F.expr("shiftright(gx, level - l)")).withColumn(
        "by", F.expr("shiftright(gy, level - l)"))
    radius = up.join(sums, ["slide_id", "l", "bx", "by"], "left").groupBy("slide_id", "x", "y").agg(
        (F.min(F.sqrt(far("x") * far("x") + far("y") * far("y"))) * (1.0 + 1e-9)).alias("reach"))
    asking = pending.filter("reach IS NOT NULL").drop("near", "held").unionByName(
        short.drop("near", "held", "reach").join(radius, ["slide_id", "x", "y"]))
    span = full.groupBy("slide_id").agg(F.min("level").alias("_low"), F.max("level").alias("_high"))
    ext, ub = F.col("_ext"), F.coalesce("reach", F.col("_ext") * 4.0)
    level = F.greatest(F.least(F.floor(F.log2(ext / F.greatest(ub, ext * 1e-9))).cast("int"), F.col("_high")), F.lit(0))
    asking = asking.join(span, "slide_id").withColumn("ub", ub).withColumn("_to", level).withColumn(
        "l", F.explode(F.sequence(F.least("_low", "_to"), F.col("_to"))))
    tiles = F.pow(F.lit(2.0), F.col("l").cast("double"))
    number = lambda c, lo, sign: F.least(F.greatest(F.floor((F.col(c) + sign * F.col("ub") - F.col(lo)) / ext * tiles * (1.0 + sign * 1e-9)), F.lit(0.0)), tiles - 1).cast("bigint")
    spread = asking.withColumn("bx", F.explode(F.sequence(number("x", "_x0", -1), number("x", "_x0", 1)))).withColumn(
        "by", F.explode(F.sequence(number("y", "_y0", -1), number("y", "_y0", 1))))
    gap = lambda c: F.greatest(F.col(f"{c}0") - F.col(c), F.col(c) - F.col(f"{c}1"), F.lit(0.0))
    near = F.col("reach").isNull() | (gap("x") * gap("x") + gap("y") * gap("y") <= F.col("ub") * F.col("ub"))
    other = (F.col("leaf_level") != F.col("level")) | (F.col("leaf_x") != F.col("gx")) | (F.col("leaf_y") != F.col("gy"))
    found = spread.join(blocks.drop("n"), ["slide_id", "l", "bx", "by"]).filter(((F.col("l") == F.col("_to")) | (F.col("leaf_level") == F.col("l"))) & near & other)
    return found.select("slide_id", F.col("leaf_level").alias("level"), F.col("leaf_x").alias("gx"), F.col("leaf_y").alias("gy"), "x", "y", F.col("reach").alias("ub"))


def nearest_of_class(points: DataFrame, targets: DataFrame, pool_slides: bool = False) -> DataFrame:
    """Distance from each point to the closest target (itself included when it is one); NULL when there is none."""
    hit = spatial_knn(points, 1, targets, pool_slides, exclude_self=False)
    return points.join(hit.select("slide_id", F.col("src").alias("cell_id"), F.col("dst").alias("nearest_id"), "dist"),
                       ["slide_id", "cell_id"], "left")


# ---- graph shapes ------------------------------------------------------------------------------------------

def symmetrise(knn: DataFrame) -> DataFrame:
    """Union of both directions with weight 1 and the larger stored distance."""
    both = knn.select("src", "dst", "dist").unionByName(
        knn.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist"))
    return both.groupBy("src", "dst").agg(F.max("dist").alias("dist")).withColumn("weight", F.lit(1.0))


def row_normalise(edges: DataFrame) -> DataFrame:
    """weight / row sum. Rows are summed by aggregation, so a hub's edges are never one task's window."""
    sums = edges.groupBy("src").agg(F.sum("weight").alias("_s"))
    return edges.join(sums, "src").withColumn(
        "weight", F.when(F.col("_s") > 0, F.col("weight") / F.col("_s")).otherwise(F.lit(0.0))).drop("_s")


def blend_graphs(expression: DataFrame, spatial: DataFrame, lam: float) -> DataFrame:
    """(1 - lambda) x row-normalised expression graph + lambda x row-normalised spatial graph, then symmetric average."""
    if not 0.0 <= lam <= 1.0:
        raise ValueError("lambda must lie in [0, 1]")
    part = lambda edges, w: row_normalise(edges).select("src", "dst", (F.col("weight") * w).alias("weight"))
    mixed = part(expression, 1.0 - lam).unionByName(part(spatial, lam))
    flipped = mixed.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return mixed.unionByName(flipped).groupBy("src", "dst").agg((F.sum("weight") / 2.0).alias("weight")).filter("weight > 0")


# ---- embedding neighbours ----------------------------------------------------------------------------------

MAX_BLOCKS = 4096


def embedding_knn(vectors: DataFrame, k: int, block_rows: int = 2048) -> DataFrame:
    """Exact Euclidean k-NN of ``vectors(cell_id, vec)`` as (src, dst, dist, rank); self excluded, ties by id.

    Pivots (at most MAX_BLOCKS vectors) and block summaries are the only data sent to every task.
    """
    base = cut(vectors.select("cell_id", "vec"))
    n = base.count()
    k = min(k, n - 1)
    if k < 1:
        return base.sparkSession.createDataFrame([], "src string, dst string, dist double, rank int")
    n_pivots = int(min(MAX_BLOCKS // 2, max(1, math.ceil(n / block_rows))))
    pivots = np.array([r.vec for r in base.orderBy(F.xxhash64("cell_id"), "cell_id").limit(n_pivots).collect()], dtype=float)
    half = (pivots**2).sum(1) / 2.0

    def assign(batches):
        for pdf in batches:
            x = np.stack(pdf["vec"].to_numpy()).astype(float)
            yield pd.DataFrame({"cell_id": pdf["cell_id"], "vec": pdf["vec"], "pivot": (x @ pivots.T - half).argmax(1)})

    placed = base.mapInPandas(assign, "cell_id string, vec array<double>, pivot int")
    loads = {r.pivot: r.n for r in placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).collect()}
    # a crowded pivot is split by id hash; the split keeps the number of blocks bounded
    limit = max(block_rows, math.ceil(2.0 * n / MAX_BLOCKS))
    parts = {p: math.ceil(c / limit) for p, c in loads.items()}
    offset = dict(zip(parts, np.concatenate([[0], np.cumsum(list(parts.values()))[:-1]]).astype(int).tolist()))
    spark = base.sparkSession
    plan = spark.createDataFrame([(p, parts[p], offset[p]) for p in parts], "pivot int, parts int, first int")
    blocks = cut(placed.join(F.broadcast(plan), "pivot").select(
        (F.col("first") + F.pmod(F.xxhash64("cell_id"), F.col("parts"))).cast("int").alias("block"), "cell_id", "vec"))

    def frame_of(src_ids, picked, dist, dst_ids):
        table = pd.DataFrame({"src": np.repeat(src_ids, picked.shape[1]), "dst": dst_ids[picked.ravel()], "dist": dist.ravel()})
        return table[np.isfinite(table["dist"])]

    def topk(src_ids, src, dst_ids, dst, limit_k):
        """Best ``limit_k`` targets per source, computed in strips so that memory stays bounded."""
        out = []
        order = np.argsort(dst_ids, kind="stable")
        dst_ids, dst = dst_ids[order], dst[order]
        take = min(limit_k, len(dst_ids))
        strip = max(1, 4_000_000 // max(1, len(dst_ids)))
        for at in range(0, len(src_ids), strip):
            x = src[at:at + strip]
            d2 = np.maximum((x**2).sum(1)[:, None] + (dst**2).sum(1)[None, :] - 2.0 * x @ dst.T, 0.0)
            d2[src_ids[at:at + strip][:, None] == dst_ids[None, :]] = np.inf
            width = min(take + 8, len(dst_ids))
            near = np.sort(np.argpartition(d2, width - 1, axis=1)[:, :width], axis=1)  # column order is id order
            kth = np.partition(np.take_along_axis(d2, near, 1), take - 1, axis=1)[:, take - 1]
            exact = np.sqrt(((dst[near] - x[:, None, :]) ** 2).sum(2))
            exact[~np.isfinite(np.take_along_axis(d2, near, 1))] = np.inf
            best = np.argsort(np.round(exact, 12), axis=1, kind="stable")[:, :take]
            picked, dist = np.take_along_axis(near, best, 1), np.take_along_axis(exact, best, 1)
            out.append(frame_of(src_ids[at:at + strip], picked, dist, dst_ids))
            # ties that may reach beyond the shortlist are settled on the full row
            slack = kth + 1e-9 * (kth + (x**2).sum(1) + (dst**2).sum(1).max())
            for i in np.flatnonzero(((d2 <= slack[:, None]).sum(1) > width)):
                cand = np.flatnonzero((d2[i] <= slack[i]) & np.isfinite(d2[i]))
                full = np.sqrt(((dst[cand] - x[i]) ** 2).sum(1))
                row = np.argsort(np.round(full, 12), kind="stable")[:limit_k]
                out[-1] = out[-1][out[-1]["src"] != src_ids[at + i]]
                out.append(frame_of(src_ids[at + i:at + i + 1], cand[row][None, :], full[row][None, :], dst_ids))
                out[-2:] = [pd.concat(out[-2:])]
        return pd.concat(out) if out else _no_edges()

    def unpack(pdf, side=""):
        return pdf[f"cell_id{side}"].to_numpy().astype(str), np.stack(pdf[f"vec{side}"].to_numpy()).astype(float)

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x = unpack(pdf)
        return topk(ids, x, ids, x, k)

    edge = "src string, dst string, dist double"
    own = cut(blocks.groupBy("block").applyInPandas(within, edge))
    if len(offset) == 1 and sum(parts.values()) == 1:
        return _rank_neighbours(own, k)

    # per block: centre, radius and the largest k-th distance found so far
    bound = own.groupBy("src").agg(F.max("dist").alias("kth"), F.count(F.lit(1)).alias("m"))
    reach = blocks.join(bound, blocks.cell_id == bound.src, "left").select(
        "block", F.when(F.col("m") >= k, F.col("kth")).otherwise(F.lit(float("inf"))).alias("reach"))
    radius = {r.block: r.reach for r in reach.groupBy("block").agg(F.max(F.coalesce("reach", F.lit(float("inf")))).alias("reach")).collect()}
    centre_rows = blocks.select("block", F.posexplode("vec").alias("i", "v")).groupBy("block", "i").agg(F.avg("v").alias("c")).groupBy(
        "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("centre"))
    centres = {r.block: np.array(r.centre) for r in centre_rows.collect()}  # <= MAX_BLOCKS x d numbers
    ids = np.array(sorted(centres))
    c = np.stack([centres[b] for b in ids])
    row_of = {b: i for i, b in enumerate(ids.tolist())}

    def block_radius(batches):
        for pdf in batches:
            x = np.stack(pdf["vec"].to_numpy()).astype(float)
            mid = c[[row_of[b] for b in pdf["block"]]]
            yield pd.DataFrame({"block": pdf["block"], "r": np.sqrt(((x - mid) ** 2).sum(1))})

    sized = blocks.mapInPandas(block_radius, "block int, r double").groupBy("block").agg(F.max("r").alias("r"), F.count(F.lit(1)).alias("n")).collect()
    size, filled = {r.block: r.r for r in sized}, {r.block: r.n for r in sized}
    r = np.array([size[b] for b in ids])
    need = np.array([radius[b] for b in ids])

    # blocks side by side make packs, which meet without a shuffle; a pair of blocks beyond the reach is left out
    home, held = {}, 0
    for b in ids.tolist():
        home[b], held = held // pairs.pack_rows(n), held + filled[b]
    where = F.broadcast(spark.createDataFrame(list(home.items()), "block int, pack int"))
    rows = blocks.join(where, "block").join(bound.withColumnRenamed("src", "cell_id"), "cell_id", "left").select(
        "pack", "block", F.col("cell_id").cast("string").alias("cell_id"), F.when(F.col("m") >= k, F.col("kth")).otherwise(F.lit(float("inf"))).alias("kth"), "vec")
    packs = pairs.packed(rows, "block", "cell_id", "kth")

    def begin(batch, i):
        block = numbers(batch, "l_block", i)
        at = np.searchsorted(ids, block)
        starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        x, names, kth = pairs.vectors_of(batch, "l", i), pairs.text(batch, "l_cell_id", i), numbers(batch, "l_kth", i)
        return [(int(at[lo]), pairs.Nearest(names[lo:hi], x[lo:hi], kth[lo:hi], k)) for lo, hi in zip(starts, [*starts[1:], len(block)])]

    def meet(state, batch, i):
        at = np.searchsorted(ids, numbers(batch, "r_block", i))
        held = np.unique(at)
        targets = None
        for own_block, nearest in state:
            gap = np.sqrt(((c[held] - c[own_block]) ** 2).sum(1)) - r[held] - r[own_block]
            hit = held[(gap <= need[own_block] * (1 + 1e-9) + 1e-9) & (held != own_block)]
            if len(hit):
                targets = targets or pairs.Targets(pairs.text(batch, "r_cell_id", i), pairs.vectors_of(batch, "r", i))
                mask = None if len(hit) == len(held) else np.isin(at, hit)
                nearest.meet(targets, lambda lo, hi, mask=mask: mask)

    def end(state):
        for _, nearest in state:
            yield from nearest.edges()

    cross = cut(pairs.crossed(packs, packs).mapInArrow(lambda batches: pairs.met(batches, begin, meet, end), edge))
    return _rank_neighbours(own.unionByName(cross), k)


def _no_edges() -> pd.DataFrame:
    """No rows, of the right types: Spark's Arrow writer fails on empty columns of another type."""
    return pd.DataFrame({"src": np.array([], object), "dst": np.array([], object), "dist": np.array([], float)})


def _rank_neighbours(edges: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("src").orderBy(F.round("dist", 12), "dst"))
    return edges.withColumn("rank", rank).filter(F.col("rank") <= k)


def exact_neighbours(queries: DataFrame, vectors: DataFrame, k: int, query_rows: int = 512, block_rows: int = 4096) -> DataFrame:
    """Exact k-NN of some cells among all ``vectors(cell_id, vec)``, tile by tile: (src, dst, dist, rank)."""
    n, n_queries = vectors.count(), queries.count()
    tiles = {"q": max(1, math.ceil(n_queries / query_rows)), "v": max(1, math.ceil(n / block_rows))}
    place = lambda c: F.pmod(F.xxhash64("cell_id"), F.lit(tiles[c]).cast("bigint")).alias(c)
    every = lambda c: F.explode(F.sequence(F.lit(0), F.lit(tiles[c] - 1)).cast("array<bigint>")).alias(c)
    asked = queries.select("cell_id", "vec", place("q")).select("*", every("v"))
    stored = vectors.select("cell_id", "vec", place("v")).select("*", every("q"))

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return _no_edges()
        right = right.sort_values("cell_id", kind="stable")
        ids, y = right["cell_id"].to_numpy().astype(str), np.stack(right["vec"].to_numpy()).astype(float)
        rows = []
        for src, x in zip(left["cell_id"], left["vec"]):
            dist = np.round(np.sqrt(((y - x) ** 2).sum(1)), 12)
            dist[ids == src] = np.inf
            best = np.argsort(dist, kind="stable")[:k]
            best = best[np.isfinite(dist[best])]
            rows.append(pd.DataFrame({"src": src, "dst": ids[best], "dist": dist[best]}))
        return pd.concat(rows)

    return _rank_neighbours(asked.groupBy("q", "v").cogroup(stored.groupBy("q", "v")).applyInPandas(nearest, "src string, dst string, dist double"), k)


def approximate_embedding_knn(vectors: DataFrame, k: int, bucket_length: float, radius: float, n_tables: int = 4) -> DataFrame:
    """Random-projection hashing for very large embeddings: k neighbours of every cell.

    Neighbours within ``radius`` that share a bucket come first; cells with fewer than k of them are settled exactly.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    base = cut(vectors.select("cell_id", "vec"))
    rows = base.select("cell_id", array_to_vector("vec").alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket_length,
                                        numHashTables=n_tables, seed=42).fit(rows)
    hashed = model.transform(rows).select("cell_id", vector_to_array("features").alias("vec"),
                                          F.transform("hashes", lambda h: vector_to_array(h)[0].cast("long")).alias("buckets")).distinct()
    place = F.row_number().over(W.partitionBy(F.spark_partition_id()).orderBy("buckets"))
    size = pairs.pack_rows(base.count())
    packs = pairs.packed(cut(hashed.repartitionByRange("buckets", "cell_id").select(
        "*", F.concat_ws("-", F.spark_partition_id(), F.floor(place / size)).alias("pack"))), "cell_id", "buckets")

    def buckets(batch, side, i):
        return pairs.grid(batch, f"{side}_buckets", i, n_tables)

    def begin(batch, i):
        x = pairs.vectors_of(batch, "l", i)
        return buckets(batch, "l", i), pairs.Nearest(pairs.text(batch, "l_cell_id", i), x, np.full(len(x), radius), k)

    def meet(state, batch, i):
        mine, theirs = state[0], buckets(batch, "r", i)
        if any(np.intersect1d(mine[:, t], theirs[:, t]).size for t in range(n_tables)):
            shared = lambda lo, hi: (mine[lo:hi, None] == theirs[None]).any(2)
            state[1].meet(pairs.Targets(pairs.text(batch, "r_cell_id", i), pairs.vectors_of(batch, "r", i)), shared)

    joined = pairs.crossed(packs, packs).mapInArrow(lambda batches: pairs.met(batches, begin, meet, lambda state: state[1].edges()),
                                                    "src string, dst string, dist double").filter(F.col("dist") < radius)
    near = cut(_rank_neighbours(joined, k))
    full = near.filter(F.col("rank") == k).select(F.col("src").alias("cell_id"))
    short = cut(base.join(full, "cell_id", "left_anti"))
    return near.join(full, near.src == full.cell_id, "left_semi").unionByName(exact_neighbours(short, base, k))
