"""Spatial statistics on one edge table: autocorrelation, lag and local co-expression, neighbourhood enrichment."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import bh_adjust, pearson
from ..functions.tails import normal_two_sided
from ..session import cut
from .matrix import distinct_values
from .neighbors import row_normalise, spatial_knn, symmetrise
from .permutations import permuted, ranked


def gene_index(expr: DataFrame) -> DataFrame:
    """gene -> position in the sorted panel."""
    genes = distinct_values(expr, "gene")
    one = expr.sparkSession.range(1)
    return one.select(F.posexplode(genes).alias("gene_idx", "gene"))


def packed_cells(expr: DataFrame, index: DataFrame) -> DataFrame:
    """One row per cell: ascending gene positions and their values (bounded by the panel)."""
    entries = expr.join(index, "gene").groupBy("cell_id").agg(
        F.array_sort(F.collect_list(F.struct("gene_idx", F.col("lognorm").cast("double").alias("v")))).alias("e"))
    return entries.select("cell_id", F.col("e.gene_idx").alias("gi"), F.col("e.v").alias("gv"))


#: Cells of a tile, and edges and genes that are multiplied at a time.
TILE_CELLS, EDGES_AT_ONCE, GENES_AT_ONCE = 512, 8192, 256


def _interleaved(x: Column, y: Column) -> Column:
    """Bits of two whole numbers (up to 26 bits) in turn: near places get near keys."""

    def spread(v: Column) -> Column:
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def cell_tiles(cells: DataFrame) -> DataFrame:
    """(cell_id, tile): up to TILE_CELLS cells that follow each other on a slide's interleaved grid.

    Crowded places get more tiles, equal locations follow cell_id. Cells without coordinates, or a table without them, are tiled
    by cell_id. The table is written, so that a cell has one tile whatever is computed again.
    """
    slide = F.col("slide_id") if "slide_id" in cells.columns else F.lit("")
    if not {"x", "y"} <= set(cells.columns):
        placed = cells.select("cell_id", slide.alias("slide_id"), F.lit(-1).cast("long").alias("_z"))
    else:
        side = float(2**26 - 1)
        known = cells.select("cell_id", slide.alias("slide_id"), *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in "xy"])
        frame = known.groupBy(F.col("slide_id").alias("_s")).agg(F.min("x").alias("_x"), F.min("y").alias("_y"), F.greatest(
            F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("_w"))
        grid = [F.when(F.col("_w") > 0, F.floor((F.col(c) - F.col(f"_{c}")) / F.col("_w") * side)).otherwise(F.lit(0)).cast("long") for c in "xy"]
        joined = known.join(frame, F.col("slide_id").eqNullSafe(F.col("_s")), "left")
        placed = joined.select("cell_id", "slide_id", F.coalesce(_interleaved(*grid), F.lit(-1)).alias("_z"))
    order = ["slide_id", "_z", "cell_id"]
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(ordered.select("cell_id", F.floor(F.monotonically_increasing_id() / TILE_CELLS).alias("tile")))


def tiled_edges(edges: DataFrame, tiles: DataFrame) -> DataFrame:
    """(tile, src, dst, weight): every edge in the tile of that end which has fewer edges, so no tile holds a hub's edges."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("cell_id")).groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))
    home = ends.join(tiles, "cell_id", "left").select("cell_id", "n", F.coalesce("tile", F.xxhash64("cell_id")).alias("tile"))
    a = home.select(F.col("cell_id").alias("src"), F.col("n").alias("na"), F.col("tile").alias("ta"))
    b = home.select(F.col("cell_id").alias("dst"), F.col("n").alias("nb"), F.col("tile").alias("tb"))
    return edges.select("src", "dst", "weight").join(a, "src").join(b, "dst").select(
        F.when(F.col("na") <= F.col("nb"), F.col("ta")).otherwise(F.col("tb")).alias("tile"), "src", "dst", "weight")


def _tile_products(edges: pa.Table, cells: pa.Table) -> pa.Table:
    """Sum of weight x value(src) x value(dst) per gene of one tile; cells without a row of values are all zero."""
    ids = cells["cell_id"].combine_chunks()
    ends = [pc.index_in(edges[c].combine_chunks(), value_set=ids).fill_null(-1).to_numpy(zero_copy_only=False) for c in ("src", "dst")]
    live = (ends[0] >= 0) & (ends[1] >= 0)
    src, dst = ends[0][live], ends[1][live]
    weight = edges["weight"].to_numpy()[live]
    lists = cells["gi"].combine_chunks()
    row = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy(zero_copy_only=False))
    genes, column = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    value = cells["gv"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    by = np.argsort(column, kind="stable")
    row, column, value = row[by], column[by], value[by]
    total = np.zeros(len(genes))
    for lo in range(0, len(genes), GENES_AT_ONCE):
        hi = min(lo + GENES_AT_ONCE, len(genes))
        a, b = np.searchsorted(column, (lo, hi))
        dense = np.zeros((len(ids), hi - lo))
        dense[row[a:b], column[a:b] - lo] = value[a:b]
        for at in range(0, len(src), EDGES_AT_ONCE):
            part = slice(at, at + EDGES_AT_ONCE)
            total[lo:hi] += weight[part] @ (dense[src[part]] * dense[dst[part]])
    seen = np.flatnonzero(total)
    return pa.table({"gene_idx": pa.array(genes[seen], pa.int32()), "s": pa.array(total[seen], pa.float64())})


def edge_products(edges: DataFrame, packed: DataFrame, tiles: DataFrame) -> DataFrame:
    """Sum over edges of weight x value(src) x value(dst) per gene (gene_idx, cross).

    An edge moves as two ids. A cell's values move once to each tile that has one of its edges: its own, and those of which it
    lies on the rim. A tile gives one row per gene.
    """
    work = cut(tiled_edges(edges, tiles))
    asked = work.select(F.col("tile").alias("at"), F.explode(F.array("src", "dst")).alias("cell_id")).distinct()
    values = asked.join(packed, "cell_id").select("at", "cell_id", "gi", "gv")
    parts = work.groupBy("tile").cogroup(values.groupBy("at")).applyInArrow(_tile_products, "gene_idx int, s double")
    return parts.groupBy("gene_idx").agg(F.sum("s").alias("cross"))


def spatial_graph(points: DataFrame, k: int, pool_slides: bool = False) -> DataFrame:
    """Symmetric binary k-NN graph with distances."""
    return symmetrise(spatial_knn(points, k, pool_slides=pool_slides))


def morans_scan(graph: DataFrame, expr: DataFrame, cells: DataFrame) -> DataFrame:
    """Moran's I per gene on the row-normalised graph, its normal-approximation z from the binary graph, p and BH."""
    work = cut(graph.select("src", "dst", "weight"))
    n = cells.select(F.count(F.lit(1)).cast("double")).scalar()
    degree = work.groupBy("src").agg(F.sum("weight").alias("out"))
    inward = work.groupBy("dst").agg(F.sum("weight").alias("in"))
    node = degree.join(inward, degree.src == inward.dst, "full").select(
        F.coalesce("src", "dst").alias("cell_id"), F.coalesce("out", F.lit(0.0)).alias("out"), F.coalesce("in", F.lit(0.0)).alias("in"))
    norm = row_normalise(work)
    share = norm.groupBy("dst").agg(F.sum("weight").alias("c")).select(F.col("dst").alias("cell_id"), "c")
    reverse = work.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("wr"))
    # S1 needs w_ij + w_ji per unordered direction; a symmetric graph makes it 2 x sum of (w + w)^2 / 2
    both = work.select("src", "dst", "weight", F.lit(0.0).alias("wr")).unionByName(reverse.withColumn("weight", F.lit(0.0))).groupBy(
        "src", "dst").agg(F.sum("weight").alias("w"), F.sum("wr").alias("wr"))
    s1 = both.agg((F.sum((F.col("w") + F.col("wr")) * (F.col("w") + F.col("wr"))) / 2.0).alias("s1"))
    s0s2 = node.agg(F.sum("out").alias("s0"), F.sum((F.col("out") + F.col("in")) * (F.col("out") + F.col("in"))).alias("s2"),
                    F.sum((F.col("out") > 0).cast("double")).alias("wsum"))
    index = cut(gene_index(expr))
    cross = edge_products(norm, packed_cells(expr, index), cell_tiles(cells)).join(index, "gene_idx").select("gene", "cross")
    loads = share.join(degree.select(F.col("src").alias("cell_id"), F.lit(1.0).alias("r")), "cell_id", "full").fillna(0.0)
    v = F.col("lognorm").cast("double")
    sums = expr.join(loads, "cell_id", "left").groupBy("gene").agg(
        F.sum(v).alias("s1x"), F.sum(v * v).alias("s2x"), F.sum(v * (F.coalesce("r", F.lit(0.0)) + F.coalesce("c", F.lit(0.0)))).alias("mix"))
    table = (sums.join(cross, "gene", "left").fillna(0.0, subset=["cross"]).withColumn("n", n)
             .withColumn("w0", s0s2.select("s0").scalar()).withColumn("w1", s1.scalar())
             .withColumn("w2", s0s2.select("s2").scalar()).withColumn("wn", s0s2.select("wsum").scalar())
             .withColumn("m", F.col("s1x") / F.col("n")))
    ss = F.col("s2x") - F.col("n") * F.col("m") * F.col("m")
    zwz = F.col("cross") - F.col("m") * F.col("mix") + F.col("m") * F.col("m") * F.col("wn")
    e = -1.0 / (F.col("n") - 1.0)
    s0 = F.col("w0")
    var = (F.col("n") * F.col("n") * F.col("w1") - F.col("n") * F.col("w2") + 3.0 * s0 * s0) / (
        (F.col("n") * F.col("n") - 1.0) * s0 * s0) - e * e
    live = ss > 1e-12 * F.greatest(F.col("s2x"), F.lit(1e-300))
    scored = (table.withColumn("morans_i", F.when(live, F.col("n") / F.col("wn") * zwz / ss))
              .withColumn("expected_i", e).withColumn("_var", var)
              .withColumn("z_score", F.when(live & (F.col("_var") > 0), (F.col("morans_i") - F.col("expected_i")) / F.sqrt("_var")))
              .withColumn("p_value", F.coalesce(normal_two_sided(F.col("z_score")), F.lit(1.0))))
    return bh_adjust(scored, "p_value", [], "p_adj").select("gene", "morans_i", "expected_i", "z_score", "p_value", "p_adj")


def neighbour_lag(edges: DataFrame, expr: DataFrame) -> DataFrame:
    """Weighted neighbour sum per (cell, gene): W x in sparse form, absent rows are 0."""
    return edges.join(expr.select(F.col("cell_id").alias("dst"), "gene", "lognorm"), "dst").groupBy(
        F.col("src").alias("cell_id"), "gene").agg(F.sum(F.col("weight") * F.col("lognorm")).alias("lag"))


def dense_vectors(expr: DataFrame, cells: DataFrame, genes: list[str], value: str, out: str) -> DataFrame:
    """A short gene list as one fixed-order array per cell, zeros filled in."""
    slot = [F.coalesce(F.sum(F.when(F.col("gene") == g, F.col(value))), F.lit(0.0)) for g in genes]
    packed = expr.filter(F.col("gene").isin(genes)).groupBy("cell_id").agg(F.array(*slot).alias(out))
    zeros = F.array(*[F.lit(0.0) for _ in genes])
    return cells.select("cell_id").join(packed, "cell_id", "left").withColumn(out, F.coalesce(out, zeros))


def gram(rows: DataFrame, vec: str) -> DataFrame:
    """Second moments sum(v_i v_j), first moments as (i, -1) and the row count as (-1, -1); one partial per task."""

    def partial(batches):
        total, first, n = None, None, 0
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[vec].to_numpy()).astype(float)
                total = x.T @ x if total is None else total + x.T @ x
                first = x.sum(0) if first is None else first + x.sum(0)
                n += len(x)
        if total is not None:
            d = len(first)
            i, j = np.divmod(np.arange(d * d), d)
            yield pd.DataFrame({"i": i, "j": j, "s": total.ravel()})
            yield pd.DataFrame({"i": np.append(np.arange(d), -1), "j": -1, "s": np.append(first, float(n))})

    return rows.select(vec).mapInPandas(partial, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))


def lag_coexpression(edges: DataFrame, expr: DataFrame, cells: DataFrame, genes: list[str]) -> DataFrame:
    """Mean of r(a, lag b) and r(b, lag a) for a gene list, diagonal 1, constant vectors 0."""
    if len(genes) < 2:
        raise ValueError("at least two genes are needed")
    short = expr.filter(F.col("gene").isin(genes))
    lags = neighbour_lag(row_normalise(edges), short)
    x = dense_vectors(short, cells, genes, "lognorm", "x")
    lag = dense_vectors(lags, cells, genes, "lag", "l")
    g = len(genes)
    moments = cut(gram(x.join(lag, "cell_id").select(F.concat("x", "l").alias("v")), "v"))  # (2g)^2 rows
    first = moments.filter("j = -1 AND i >= 0").select("i", F.col("s").alias("s"))
    square = moments.filter("i = j AND i >= 0").select("i", F.col("s").alias("q"))
    single = first.join(square, "i")
    n = moments.filter("i = -1").select("s").scalar()
    pair = moments.filter(f"i >= 0 AND i < {g} AND j >= {g}")
    r = pearson(F.col("n"), F.col("sa"), F.col("sb"), F.col("qa"), F.col("qb"), F.col("s"))
    scored = (pair.join(single.select("i", F.col("s").alias("sa"), F.col("q").alias("qa")), "i")
              .join(single.select(F.col("i").alias("j"), F.col("s").alias("sb"), F.col("q").alias("qb")), "j")
              .withColumn("n", n).select("i", (F.col("j") - g).alias("j"), r.alias("r")))
    lo, hi = F.least("i", "j"), F.greatest("i", "j")
    # both directions of a pair meet in one group; either being undefined makes the pair 0
    value = F.when(F.count("r") == 2, F.avg("r")).otherwise(F.lit(0.0))
    upper = scored.filter("i <> j").groupBy(lo.alias("i"), hi.alias("j")).agg(value.alias("value"))
    full = upper.unionByName(upper.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")).unionByName(
        scored.filter("i = j").select("i", "j", F.lit(1.0).alias("value")))
    name = F.array(*[F.lit(x) for x in genes])
    return full.select(name[F.col("i")].alias("gene_a"), name[F.col("j")].alias("gene_b"), "value")


def local_coexpression(knn: DataFrame, expr: DataFrame, cells: DataFrame, genes: list[str]) -> DataFrame:
    """Mean over cells of the Pearson r among each cell's k neighbours; constant neighbourhoods are skipped."""
    if len(genes) < 2:
        raise ValueError("at least two genes are needed")
    vec = dense_vectors(expr, cells, genes, "lognorm", "x").withColumnRenamed("cell_id", "dst")
    per_cell = knn.select("src", "dst").join(vec, "dst").groupBy("src").agg(F.collect_list("x").alias("xs"))  # k rows each
    g = len(genes)

    def partial(batches):
        total, seen = np.zeros((g, g)), np.zeros((g, g))
        for batch in batches:
            lists = batch.column("xs")
            length, flat = lists.value_lengths().to_numpy(), lists.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, g)
            first = np.cumsum(length) - length
            for k in np.unique(length):  # cells of as many neighbours make one array
                cells_of = np.flatnonzero(length == k)
                for at in range(0, len(cells_of) if k else 0, 1024):
                    x = flat[first[cells_of[at:at + 1024], None] + np.arange(k)]
                    sd = x.std(1)
                    live = sd >= 1e-9
                    z = np.where(live[:, None], (x - x.mean(1, keepdims=True)) / np.where(live, sd, 1.0)[:, None], 0.0)
                    total += np.einsum("nkg,nkh->gh", z, z, optimize=True) / k
                    seen += live.T.astype(float) @ live
        i, j = np.triu_indices(g, 1)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "t": total[i, j], "n": seen[i, j]})

    sums = per_cell.select("xs").mapInArrow(partial, "i int, j int, t double, n double").groupBy("i", "j").agg(
        F.sum("t").alias("t"), F.sum("n").alias("n"))
    value = F.when(F.col("n") > 0, F.col("t") / F.col("n")).otherwise(F.lit(0.0))
    upper = sums.select("i", "j", value.alias("value"))
    full = upper.unionByName(upper.select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    name = F.array(*[F.lit(x) for x in genes])
    return full.select(name[F.col("i")].alias("gene_a"), name[F.col("j")].alias("gene_b"), "value")


# ---- neighbourhood enrichment ------------------------------------------------------------------------------

def _pair_counts(knn: DataFrame, labels: DataFrame, extra: list[str]) -> DataFrame:
    a = labels.select(*extra, F.col("cell_id").alias("src"), F.col("label").alias("type_a"))
    b = labels.select(*extra, F.col("cell_id").alias("dst"), F.col("label").alias("type_b"))
    return knn.select("src", "dst").join(a, "src").join(b, ["dst", *extra]).groupBy(*extra, "type_a", "type_b").agg(
        F.count(F.lit(1)).alias("n"))


def _shares(counts: DataFrame, extra: list[str]) -> DataFrame:
    total = F.sum("n").over(W.partitionBy(*extra, "type_a"))
    return counts.withColumn("share", F.col("n") / total)


def observed_enrichment(knn: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of type A's neighbour slots that hold type B, zero-filled over all label pairs."""
    names = distinct_values(labels, "label")
    grid = labels.select(F.col("label").alias("type_a")).distinct().withColumn("type_b", F.explode(names))
    shares = _shares(_pair_counts(knn, labels, []), []).select("type_a", "type_b", F.col("share").alias("observed"))
    return grid.join(shares, ["type_a", "type_b"], "left").fillna(0.0, subset=["observed"])


class LabelPlaces:
    """Which label lies at which position of a slide: labels in order, as many positions each as the slide has cells of it.

    One row per slide and label reaches the driver and goes to the tasks.
    """

    def __init__(self, labels: DataFrame):
        rows = labels.groupBy("slide_id", "label").agg(F.count(F.lit(1)).alias("n")).collect()
        self.names = sorted({r.label for r in rows})
        code = {x: i for i, x in enumerate(self.names)}
        counts: dict[str, np.ndarray] = {}
        for r in rows:
            counts.setdefault(r.slide_id, np.zeros(len(code), np.int64))[code[r.label]] = r.n
        self.ends = {slide: np.cumsum(c) for slide, c in counts.items()}

    def codes(self, slide: np.ndarray, rank: np.ndarray, size: np.ndarray, key: np.ndarray, perms: np.ndarray, seed: int) -> np.ndarray:
        """The label codes of some cells in each permutation: cells x perms."""
        out = np.zeros((len(rank), len(perms)), np.int32)
        order = np.argsort(slide, kind="stable")
        for rows in np.split(order, np.flatnonzero(slide[order][1:] != slide[order][:-1]) + 1):
            if len(rows):
                out[rows] = np.searchsorted(self.ends[slide[rows[0]]], permuted(rank[rows], size[rows], key[rows], perms, seed), side="right")
        return out


def shuffled_labels(labels: DataFrame, permutations: Column, seed: int, per_bucket: int = 50_000) -> DataFrame:
    """(perm, slide_id, cell_id, label): uniform relabelling within slides that keeps each slide's label counts.

    Every cell computes its labels from its rank, its slide's size and the seed (see ``permutations``).
    """
    places = LabelPlaces(labels)
    rows = ranked(labels, per_bucket).withColumn("perms", permutations.cast("array<bigint>"))

    def relabel(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf[at:at + 256]
                perms = np.array(part["perms"].iloc[0], np.int64)
                code = places.codes(*(part[c].to_numpy() for c in ("slide_id", "rank", "size", "key")), perms, seed)
                yield pd.DataFrame({"perm": np.tile(perms, len(part)), "slide_id": np.repeat(part["slide_id"].to_numpy(), len(perms)),
                                    "cell_id": np.repeat(part["cell_id"].to_numpy(), len(perms)), "label": np.array(places.names, object)[code.ravel()]})

    return rows.mapInPandas(relabel, "perm long, slide_id string, cell_id string, label string")


def permuted_pairs(edges: DataFrame, places: LabelPlaces, cells: DataFrame, n_permutations: int, seed: int) -> DataFrame:
    """(perm, a, b, n): label pairs on the edges in each permutation, labels as codes.

    ``cells`` is what ``ranked`` returns. An edge carries the ranks of its two cells only and passes once for all permutations;
    pairs are counted per task, so permutations x labels x labels rows leave it.
    """
    n_types = max(1, len(places.names))
    end = lambda side: cells.select(F.col("cell_id").alias(side), F.struct("slide_id", "rank", "size", "key").alias(f"{side}_at"))

    def count(batches):
        perms = np.arange(n_permutations)
        total, place = np.zeros(n_permutations * n_types * n_types, np.int64), perms * n_types * n_types
        for batch in batches:
            ends = pa.concat_arrays([batch.column(0), batch.column(1)])
            slide, rank, size, key = (ends.field(c).to_numpy(zero_copy_only=False) for c in ("slide_id", "rank", "size", "key"))
            number = {x: i for i, x in enumerate(dict.fromkeys(slide))}
            _, first, at = np.unique(np.array([number[x] for x in slide], np.int64) * (1 << 40) + rank, return_index=True, return_inverse=True)
            for start in range(0, n_permutations, 128):  # strips of permutations and edges bound the memory
                some = perms[start:start + 128]
                code = places.codes(slide[first], rank[first], size[first], key[first], some, seed)
                for edge in range(0, batch.num_rows, 4096):
                    x, y = (code[at[side:side + batch.num_rows][edge:edge + 4096]] for side in (0, batch.num_rows))
                    total += np.bincount((place[some] + x * n_types + y).ravel(), minlength=len(total))
        hit = np.flatnonzero(total)
        perm, pair = np.divmod(hit, n_types * n_types)
        yield pa.RecordBatch.from_pydict({"perm": pa.array(perm.astype(np.int32)), "a": pa.array((pair // n_types).astype(np.int32)),
                                          "b": pa.array((pair % n_types).astype(np.int32)), "n": pa.array(total[hit])})

    joined = edges.join(end("src"), "src").join(end("dst"), "dst").select("src_at", "dst_at")
    return joined.mapInArrow(count, "perm int, a int, b int, n long").groupBy("perm", "a", "b").agg(F.sum("n").alias("n"))


def enrichment_test(knn: DataFrame, labels: DataFrame, n_permutations: int = 500, seed: int = 42) -> DataFrame:
    """Observed shares against the permutation null: z, two-tailed p and BH over all pairs; no rows for fewer than 4 cells."""
    edges, named = cut(knn.select("src", "dst")), cut(labels.select("slide_id", "cell_id", "label"))
    if named.limit(4).count() < 4:
        edges, named = edges.limit(0), named.limit(0)
    places = LabelPlaces(named)
    pairs = permuted_pairs(edges, places, cut(ranked(named)), n_permutations, seed)
    shares = _shares(pairs.withColumnsRenamed({"a": "type_a", "b": "type_b"}), ["perm"])
    name = F.array(*[F.lit(x) for x in places.names]) if places.names else F.array().cast("array<string>")
    null = shares.select("perm", name[F.col("type_a")].alias("type_a"), name[F.col("type_b")].alias("type_b"), "share")
    b = float(n_permutations)
    observed = observed_enrichment(edges, named)
    stat = observed.join(null, ["type_a", "type_b"], "left").groupBy("type_a", "type_b", "observed").agg(
        F.coalesce(F.sum("share"), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.col("share") * F.col("share")), F.lit(0.0)).alias("q"),
        F.count_if(F.col("share") >= F.col("observed")).alias("ge"), F.count_if(F.col("share") > F.col("observed")).alias("gt"))
    mean = F.col("s") / b
    sd = F.sqrt(F.greatest(F.col("q") / b - mean * mean, F.lit(0.0))) + 1e-12
    upper = F.when(F.col("observed") <= 0, F.lit(b)).otherwise(F.col("ge"))
    lower = F.lit(b) - F.col("gt")
    p = F.least(F.lit(1.0), F.least(upper, lower) * 2.0 / (b + 1.0) + 2.0 / (b + 1.0))
    scored = stat.select("type_a", "type_b", "observed", mean.alias("null_mean"),
                         ((F.col("observed") - mean) / sd).alias("z_score"), p.alias("p_value"))
    return bh_adjust(scored, "p_value", [], "p_adj")


def label_coherence(edges: DataFrame, labels: DataFrame, all_cells: bool = True) -> DataFrame:
    """Per cell: share of its neighbours with its own label. Cells without neighbours count as 0 when ``all_cells``."""
    a = labels.select(F.col("cell_id").alias("src"), F.col("label").alias("la"))
    b = labels.select(F.col("cell_id").alias("dst"), F.col("label").alias("lb"))
    share = edges.select("src", "dst").join(a, "src").join(b, "dst").groupBy(F.col("src").alias("cell_id")).agg(
        F.avg((F.col("la") == F.col("lb")).cast("double")).alias("coherence"))
    how = "left" if all_cells else "inner"
    return labels.select("cell_id", "label").join(share, "cell_id", how).fillna(0.0, subset=["coherence"])
