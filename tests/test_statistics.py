"""Worked numbers and closed-form cases."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cytomosaic.functions import quantiles, stats, tails
from cytomosaic.operators import annotate, composition, dge, ligand_receptor, normalize, panel, pseudobulk, ranks, spatial, summaries


def expression(spark, groups):
    """Sparse rows and cells from {condition: values} of one gene."""
    cells, rows = [], []
    for cond, values in groups.items():
        for i, v in enumerate(values):
            cells.append(("s", f"{cond}{i}", cond, "t", f"{cond}-r"))
            if v:
                rows.append(("s", f"{cond}{i}", "g", float(v)))
    return (spark.createDataFrame(rows, "slide_id string, cell_id string, gene string, lognorm double"),
            spark.createDataFrame(cells, "slide_id string, cell_id string, condition string, cell_type string, replicate_id string"))


def test_rank_sum_without_tie_correction(spark):
    expr, cells = expression(spark, {"A": [0, 0, 1], "B": [0, 2, 2]})
    row = dge.two_condition_dge(expr, cells, "A", "B").first()
    assert row.score == pytest.approx(1.0910895, abs=1e-7) and row.pval == pytest.approx(0.2752335, abs=1e-7)


def test_mann_whitney_with_ties_and_continuity(spark):
    expr, cells = expression(spark, {"A": [0, 0, 1], "B": [0, 2, 2]})
    row = annotate.gene_by_type_tests(expr, cells, "g", "A", "B").first()
    assert row.u_stat == 7 and row.z == pytest.approx(0.9428090, abs=1e-7) and row.pval == pytest.approx(0.3457786, abs=1e-7)


def test_too_few_cells_give_p_one(spark):
    expr, cells = expression(spark, {"A": [0, 1], "B": [0, 2, 2]})
    assert annotate.gene_by_type_tests(expr, cells, "g", "A", "B").first().pval == 1.0


def test_rank_sums_match_brute_force_over_buckets(spark):
    rng = np.random.default_rng(3)
    values = np.round(rng.exponential(size=400), 2) * rng.integers(0, 2, 400)
    labels = rng.choice(["a", "b", "c"], 400)
    rows = spark.createDataFrame([(str(l), float(v)) for l, v in zip(labels, values) if v > 0], "lab string, v double").withColumn("gene", F.lit("g"))
    sizes = spark.createDataFrame([("g", l, int((labels == l).sum())) for l in "abc"], "gene string, lab string, n_cells bigint")
    got = {r.lab: r.rank_sum for r in ranks.rank_sums(rows, ["gene"], "lab", "v", sizes).collect()}
    want = pd.Series(values).rank().groupby(labels).sum()
    assert got == pytest.approx(want.to_dict())


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.20])] + [(9, None)], "i int, p double")
    got = [r.q for r in stats.bh_adjust(df, "p", [], "q").orderBy("i").collect()]
    assert got[:4] == pytest.approx([0.04, 0.0533333, 0.0533333, 0.20], abs=1e-7) and got[4] is None


def test_normal_tail_matches_erfc(spark):
    zs = [0.0, 0.1, -1.0, 1.96, 2.9, 3.1, -4.2, 4.3, 6.0, 12.0]
    rows = spark.createDataFrame([(z,) for z in zs], "z double").select("z", tails.normal_two_sided(F.col("z")).alias("p")).collect()
    for r in rows:
        assert r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), rel=1e-9, abs=1e-300)


def test_student_and_chi_squared_tails():
    assert tails.t_sf_two_sided_np(np.array([2.0, 2.0]), np.array([1.0, 2.0])) == pytest.approx([1 - 2 * math.atan(2) / math.pi, 1 - 2 / math.sqrt(6)])
    assert tails.t_quantile_np(0.975, np.array([1.0, 10.0])) == pytest.approx([12.7062047, 2.2281389], abs=1e-6)
    assert tails._gammaincc(1.0, 2.7) == pytest.approx(math.exp(-2.7))
    assert tails._gammaincc(0.5, 5.4 / 2) == pytest.approx(0.0201368, abs=1e-7)


def test_moran_on_a_chain(spark):
    xs, values = [0.0, 1.0, 3.0, 6.0], [1.0, 2.0, 3.0, 4.0]
    points = spark.createDataFrame([("s", str(i), x, 0.0) for i, x in enumerate(xs)], "slide_id string, cell_id string, x double, y double")
    expr = spark.createDataFrame([("s", str(i), g, v) for i, v in enumerate(values) for g, v in (("up", v), ("flat", 1.0))],
                                 "slide_id string, cell_id string, gene string, lognorm double")
    out = {r.gene: r for r in spatial.morans_scan(spatial.spatial_graph(points, 1), expr, points).collect()}
    assert out["up"].morans_i == pytest.approx(0.4) and out["up"].expected_i == pytest.approx(-1 / 3)
    assert out["up"].z_score == pytest.approx(1.9052559, abs=1e-7) and out["up"].p_value == pytest.approx(0.0567468, abs=1e-7)
    assert out["flat"].morans_i is None and out["flat"].p_value == 1.0


def test_edge_products_by_tiles(spark, monkeypatch):
    """Small tiles, a crowded place, a hub, cells without values, without coordinates and outside the cell table."""
    monkeypatch.setattr(spatial, "TILE_CELLS", 4)
    rng = np.random.default_rng(3)
    cells = [("s%d" % (i % 2), "c%03d" % i, float(rng.random()), float(rng.random())) for i in range(40)]
    cells += [("s0", "c%03d" % i, 0.5, 0.5) for i in range(40, 60)] + [("s1", "c060", float("nan"), 1.0), (None, "c061", None, None)]
    values = {(c[1], g): float(rng.random()) for c in cells[:-10] for g in range(7) if rng.random() < 0.5}
    names = [c[1] for c in cells]
    pairs = {(a, b) for a in names for b in rng.choice(names, 3)} | {("c000", b) for b in names} | {("c001", "zzz")}
    edges = [(a, b, float(rng.random())) for a, b in sorted(pairs)]
    want = np.zeros(7)
    for a, b, w in edges:
        for g in range(7):
            want[g] += w * values.get((a, g), 0.0) * values.get((b, g), 0.0)
    points = spark.createDataFrame(cells, "slide_id string, cell_id string, x double, y double")
    expr = spark.createDataFrame([(c, g, v) for (c, g), v in values.items()], "cell_id string, gene int, lognorm double")
    packed = expr.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct(F.col("gene").alias("gene_idx"), F.col("lognorm").alias("v")))).alias("e")).select(
        "cell_id", F.col("e.gene_idx").alias("gi"), F.col("e.v").alias("gv"))
    graph = spark.createDataFrame(edges, "src string, dst string, weight double")
    for known in (points, points.select("cell_id")):
        tiles = spatial.cell_tiles(known)
        assert tiles.groupBy("tile").count().agg(F.max("count")).first()[0] <= 4 and tiles.count() == len(cells)
        got = {r.gene_idx: r.cross for r in spatial.edge_products(graph, packed, tiles).collect()}
        assert [got[g] for g in range(7)] == pytest.approx(want)
    assert spatial.edge_products(graph.limit(0), packed, tiles).count() == 0


def test_composition_worked_example(spark):
    data = {"a1": ("a", (10, 20, 30)), "a2": ("a", (12, 18, 30)), "b1": ("b", (25, 15, 20)), "b2": ("b", (24, 16, 20))}
    rows = [(rep, cond, t, rep + t + str(i)) for rep, (cond, ns) in data.items() for t, n in zip("xyz", ns) for i in range(n)]
    cells = spark.createDataFrame(rows, "replicate_id string, condition string, cell_type string, cell_id string")
    out = {r.cell_type: r for r in composition.composition_analysis(cells).collect()}
    assert [out[t].log2fc for t in "xyz"] == pytest.approx([1.0361181, -0.3735701, -0.6625480], abs=1e-6)
    assert [out[t].t_stat for t in "xyz"] == pytest.approx([9.1037742, -3.7528805, -36.6655332], abs=1e-5)
    assert [out[t].dof for t in "xyz"] == pytest.approx([1.1974712, 1.3649279, 1.1953184], abs=1e-6)
    assert all(out[t].credible_interval_lo < out[t].log2fc < out[t].credible_interval_hi for t in "xyz")
    assert out["x"].reference_cell_type == "z"


def test_yates_chi_squared(spark):
    rows = [("A", i < 10) for i in range(30)] + [("B", i < 20) for i in range(30)]
    table = spark.createDataFrame(rows, "condition string, r1_pos boolean").withColumn("lig_pos", F.lit(True))
    row = ligand_receptor.receptor_chi_squared(table, "A", "B", "r1_pos").first()
    assert row.chi2 == pytest.approx(5.4) and row.pval == pytest.approx(0.0201368, abs=1e-7)
    counts = table.groupBy("condition", "r1_pos").agg(F.count(F.lit(1)).alias("n")).withColumn("s", F.col("r1_pos").cast("string"))
    assert ligand_receptor.contingency_chi_squared(counts, "condition", "s").first().chi2 == pytest.approx(5.4)


def test_ratio_index_and_status(spark):
    expr = spark.createDataFrame([("s", "c", "L", 2.0), ("s", "c", "R1", 0.5), ("s", "c", "R2", 0.5)], "slide_id string, cell_id string, gene string, lognorm double")
    cells = spark.createDataFrame([("s", "c"), ("s", "d")], "slide_id string, cell_id string")
    rows = {r.cell_id: r for r in ligand_receptor.axis_table(expr, cells, ligand_receptor.Axis("L", "R1", "R2")).collect()}
    assert rows["c"]["index"] == 1.0 and rows["c"].status == "L+R1+" and rows["d"].status == "Negative"


def test_lognorm_value_and_specificity(spark):
    counts = spark.createDataFrame([("s", "c", "g", 3), ("s", "c", "h", 57)], "slide_id string, cell_id string, gene string, count int")
    assert normalize.lognorm(counts).filter("gene = 'g'").first().lognorm == pytest.approx(1.7917595, abs=1e-7)
    sig = annotate.signature_table(spark, {"x": ["g", "h"], "y": ["g"]})
    assert {r.gene: r.weight for r in annotate.specificity_weights(sig).collect()} == {"g": 0.5, "h": 1.0}


def test_area_scaling_before_total_is_a_no_op(spark):
    counts = spark.createDataFrame([("s", "c", "g", 3), ("s", "c", "h", 57), ("s", "d", "g", 1)], "slide_id string, cell_id string, gene string, count int")
    cells = spark.createDataFrame([("s", "c", 10.0), ("s", "d", 40.0)], "slide_id string, cell_id string, cell_area double")
    value = lambda df: {(r.cell_id, r.gene): r.lognorm for r in df.collect()}
    assert value(normalize.normalise(counts, cells, by_area=True)) == pytest.approx(value(normalize.lognorm(counts)))


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=300), rng.exponential(size=300) * 1e4, np.zeros(100)])
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 5.0), ("c", None)], "k string, v double")
    points = [0.0, 0.1, 0.5, 0.77, 0.99, 1.0]
    got = {r.k: r for r in quantiles.exact_quantiles(df, ["k"], "v", points).collect()}
    assert got["a"].q == pytest.approx(np.quantile(values, points).tolist()) and got["b"].q == [5.0] * 6 and "c" not in got


def test_pseudobulk_effect_is_the_log_ratio(spark):
    rows, cells = [], []
    for cond, level in (("A", 40), ("B", 80)):
        for rep in range(4):
            cid = f"{cond}{rep}"
            cells.append(("s", cid, cond, cid))
            rows += [("s", cid, "moves", level + rep), ("s", cid, "same1", 100), ("s", cid, "same2", 60), ("s", cid, "same3", 30)]
    counts = spark.createDataFrame(rows, "slide_id string, cell_id string, gene string, count int")
    frame = spark.createDataFrame(cells, "slide_id string, cell_id string, condition string, replicate_id string")
    out = {r.gene: r for r in pseudobulk.pseudobulk_dge(counts, frame, "A", "B", min_cells=1).collect()}
    assert out["moves"].log2fc == pytest.approx(math.log2(81.5 / 41.5), abs=2e-3)
    assert out["same1"].log2fc == pytest.approx(0.0, abs=1e-6) and out["moves"].pval_adj < 0.01 < out["same2"].pval_adj


def test_recommended_threshold(spark):
    table = spark.createDataFrame([(1, 9), (2, 6), (3, 2)], "min_slides int, n_kept int")
    assert panel.recommend_min_slides(table, 6) == 2 and panel.recommend_min_slides(table, 20) == 1


def test_sample_is_layout_independent(spark):
    cells = spark.range(500).select(F.lit("s").alias("slide_id"), F.col("id").cast("string").alias("cell_id"))
    picks = [{r.cell_id for r in summaries.seeded_sample(cells.repartition(n), 50).collect()} for n in (1, 7, 40)]
    assert len(picks[0]) == 50 and picks[0] == picks[1] == picks[2]


def test_named_conditions_must_be_two(spark):
    _, cells = expression(spark, {"A": [1], "B": [1], "C": [1]})
    with pytest.raises(ValueError, match="exactly two"):
        dge.pick_conditions(cells)


def test_one_far_value_leaves_the_buckets_alone(spark):
    from cytomosaic.functions.quantiles import bucketed, exact_quantiles

    values = spark.range(200_000).select((F.col("id") / 1000.0).alias("v")).union(spark.createDataFrame([(1e12,), (-1e300,), (float("inf"),)], "v double"))
    largest = bucketed(values, [], "v", "b").groupBy("b").count().agg(F.max("count")).first()[0]
    assert largest < 1000
    order = bucketed(values, [], "v", "b").groupBy("b").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect()
    assert all(a.hi < b.lo for a, b in zip(order, order[1:]))
    finite = values.filter("v < 1e13 AND v > -1")
    q = exact_quantiles(finite, [], "v", [0.0, 0.25, 0.5, 1.0]).first()
    assert q.n == 200_001 and q.q[0] == 0.0 and abs(q.q[1] - 50.0) < 1e-9 and abs(q.q[2] - 100.0) < 1e-9 and q.q[3] == 1e12


def test_gene_filter_reaches_a_lazy_expression(spark, tmp_path):
    """No stage is written for a query that reads one gene."""
    import os

    from cytomosaic.session import checkpoint_dir
    from cytomosaic.sources import demo

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("sample tables are not here")
    root = checkpoint_dir(spark)
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    demo.expression(spark, "/root/testdata/sf0.001").filter("gene = 'G1'").count()
    assert (set(os.listdir(root)) if os.path.isdir(root) else set()) == before
