"""Neighbour joins against brute force, and invariants of the iterative operators."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cytomosaic.operators import community, embedding, neighbors, quality, spatial


def points_frame(spark, xy, slides=None):
    slides = slides or ["s"] * len(xy)
    return spark.createDataFrame([(s, f"p{i:04d}", float(x), float(y)) for i, ((x, y), s) in enumerate(zip(xy, slides))],
                                 "slide_id string, cell_id string, x double, y double")


def brute(xy, k, slides=None):
    slides = slides or ["s"] * len(xy)
    out = {}
    for i, (x, y) in enumerate(xy):
        near = sorted(((x - a) * (x - a) + (y - b) * (y - b), f"p{j:04d}") for j, (a, b) in enumerate(xy) if j != i and slides[j] == slides[i])
        out[f"p{i:04d}"] = [n for _, n in near[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.src, r["rank"])):
        out.setdefault(r.src, []).append(r.dst)
    return out


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=3, max_size=40), st.integers(1, 6))
def test_spatial_knn_equals_brute_force_with_duplicates(spark, xy, k):
    got, want = found(neighbors.spatial_knn(points_frame(spark, xy), k)), brute(xy, k)
    assert {s: n for s, n in want.items() if n} == got


def test_spatial_knn_with_a_hot_spot_and_outliers(spark):
    rng = np.random.default_rng(0)
    hot = [(5.0, 5.0)] * 120  # one location holds a third of the points
    dense = (rng.normal(size=(200, 2)) * 1e-3 + 5).tolist()
    far = [(1e6, 1e6), (-1e6, 3.0), (0.0, -5e5)]
    xy = [tuple(p) for p in hot + dense + far]
    assert found(neighbors.spatial_knn(points_frame(spark, xy), 5)) == brute(xy, 5)


@pytest.mark.parametrize("seed", [3, 4])
def test_spatial_knn_in_small_tiles(spark, monkeypatch, seed):
    monkeypatch.setattr(neighbors, "TILE", 8)
    monkeypatch.setattr(neighbors, "ASKING", 5)
    rng = np.random.default_rng(seed)
    clump = rng.normal(size=(60, 2)) * 1e-5 + 40
    xy = [tuple(p) for p in np.round(np.concatenate([rng.random((150, 2)) * 100, clump, [[40.0, 40.0]] * 25, [[1e5, -3e4], [-2e5, 0.0]]]), 7)]
    slides = ["a" if i % 7 else "b" for i in range(len(xy))]
    frame = points_frame(spark, xy, slides)
    assert found(neighbors.spatial_knn(frame, 6)) == brute(xy, 6, slides)
    few = frame.filter("cast(substring(cell_id, 2) AS int) % 20 = 3")
    near = {r.cell_id: (r.nearest_id, r.dist) for r in neighbors.nearest_of_class(frame, few).collect()}
    for i, (p, s) in enumerate(zip(xy, slides)):
        d = sorted((((p[0] - a) * (p[0] - a) + (p[1] - b) * (p[1] - b)) ** 0.5, f"p{j:04d}") for j, ((a, b), t) in enumerate(zip(xy, slides)) if j % 20 == 3 and t == s)
        assert near[f"p{i:04d}"] == ((d[0][1], d[0][0]) if d else (None, None))


def test_spatial_knn_layout_and_slides(spark):
    rng = np.random.default_rng(1)
    xy, slides = rng.normal(size=(150, 2)).tolist(), [f"s{i % 3}" for i in range(150)]
    frame = points_frame(spark, xy, slides)
    want = brute(xy, 4, slides)
    for parts in (1, 7, 30):
        assert found(neighbors.spatial_knn(frame.repartition(parts), 4)) == want
    assert found(neighbors.spatial_knn(frame, 4, pool_slides=True)) == brute(xy, 4)


def test_nearest_of_class_includes_self_and_null(spark):
    frame = points_frame(spark, [(0, 0), (3, 0), (9, 0)], ["a", "a", "b"])
    rows = {r.cell_id: r.dist for r in neighbors.nearest_of_class(frame, frame.filter("cell_id = 'p0001'")).collect()}
    assert rows == {"p0000": 3.0, "p0001": 0.0, "p0002": None}


def test_embedding_knn_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(150, 5)), rng.normal(size=(60, 5)) + 9, np.ones((20, 5))])
    frame = spark.createDataFrame([(f"v{i:03d}", row.tolist()) for i, row in enumerate(x)], "cell_id string, vec array<double>")
    got = found(neighbors.embedding_knn(frame, 6, block_rows=32))
    for i in range(len(x)):
        d = np.round(np.sqrt(((x - x[i]) ** 2).sum(1)), 12)
        order = sorted((d[j], f"v{j:03d}") for j in range(len(x)) if j != i)[:6]
        assert got[f"v{i:03d}"] == [n for _, n in order]


def test_blend_checks_lambda(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, weight double")
    with pytest.raises(ValueError, match="lambda"):
        neighbors.blend_graphs(edges, edges, 1.2)
    assert {r.weight for r in neighbors.blend_graphs(edges, edges, 0.3).collect()} == {1.0}


def cliques(spark, n, size):
    rows = []
    for c in range(n):
        ids = [f"c{c}_{i}" for i in range(size)]
        rows += [(a, b, 1.0) for a in ids for b in ids if a != b]
        nxt = f"c{(c + 1) % n}_0"
        rows += [(ids[0], nxt, 0.1), (nxt, ids[0], 0.1)]
    return spark.createDataFrame(rows, "src string, dst string, weight double")


def test_communities_recover_cliques(spark):
    edges = cliques(spark, 4, 5)
    labels = community.detect_communities(edges, 1.0)
    groups = {}
    for r in labels.collect():
        groups.setdefault(r.label, set()).add(r.cell_id.split("_")[0])
    assert sorted(groups) == ["0", "1", "2", "3"] and all(len(g) == 1 for g in groups.values())
    q = community.modularity(edges, labels).first().modularity
    single = labels.select("cell_id", F.col("cell_id").alias("label"))
    assert q > 0.7 and q > community.modularity(edges, single).first().modularity
    assert community.modularity(edges, labels.select("cell_id", F.lit("x").alias("label"))).first().modularity == 0.0


def test_connected_components_on_a_long_path(spark):
    ids = [f"n{i:03d}" for i in range(60)]
    rows = [(a, b) for a, b in zip(ids, ids[1:]) if b != "n030"]
    edges = spark.createDataFrame(rows + [(b, a) for a, b in rows], "src string, dst string")
    out = community.connected_components(edges, spark.createDataFrame([(i,) for i in ids], "cell_id string"))
    assert {r.component for r in out.collect()} == {"n000", "n030"}


def test_refinement_moves_fragments_only(spark):
    ids = [f"n{i}" for i in range(7)]
    pairs = [(a, b) for a, b in zip(ids, ids[1:])]
    graph = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "src string, dst string")
    labels = spark.createDataFrame(list(zip(ids, ["a", "a", "b", "a", "a", "b", "b"])), "cell_id string, label string")
    out = {r.cell_id: r.label for r in community.refine_domains(labels, graph, 2).collect()}
    assert [out[i] for i in ids] == ["a", "a", "a", "a", "a", "b", "b"]


def test_pca_matches_numpy_and_scores_are_uncorrelated(spark):
    rng = np.random.default_rng(5)
    x = np.maximum(rng.normal(size=(80, 6)) @ rng.normal(size=(6, 6)), 0)
    expr = spark.createDataFrame([("s", str(i), f"g{j}", float(x[i, j])) for i in range(80) for j in range(6) if x[i, j] > 0],
                                 "slide_id string, cell_id string, gene string, lognorm double")
    cells = spark.createDataFrame([("s", str(i)) for i in range(80)], "slide_id string, cell_id string")
    scores, _, variance = embedding.pca(expr, cells, 3)
    want = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:3]
    assert [r.variance for r in variance.orderBy("pc").collect()] == pytest.approx(want.tolist())
    s = np.array([r.vec for r in scores.collect()])
    assert np.abs(s.mean(0)).max() < 1e-9 and np.abs(np.cov(s.T) - np.diag(want)).max() < 1e-9
    with pytest.raises(ValueError, match="at least 2"):
        embedding.pca(expr.filter("gene in ('g0', 'g1')"), cells, 3)


def test_subspace_iteration_on_a_flat_spectrum():
    rng = np.random.default_rng(9)
    q = np.linalg.qr(rng.normal(size=(400, 400)))[0]
    matrix = (q * np.concatenate([np.linspace(3, 2, 20), np.linspace(1.9, 0.5, 380)])) @ q.T
    passes = []
    value, vector = embedding.leading_vectors(lambda v: passes.append(v.shape[1]) or matrix @ v, 400, 12)
    assert np.abs(value - np.linalg.eigvalsh(matrix)[::-1][:12]).max() < 1e-9 and np.abs(matrix @ vector - vector * value).max() < 1e-7
    assert len(passes) < 60 and max(passes) <= 22


def test_pca_keeps_all_distances_with_all_components(spark):
    rng = np.random.default_rng(10)
    x = np.maximum(rng.normal(size=(70, 30)), 0)
    expr = spark.createDataFrame([("s", str(i), f"g{j:02d}", float(x[i, j])) for i in range(69) for j in range(30) if x[i, j] > 0],
                                 "slide_id string, cell_id string, gene string, lognorm double")
    x[69] = 0.0  # a cell without any entry
    cells = spark.createDataFrame([("s", str(i)) for i in range(70)], "slide_id string, cell_id string")
    scores, loadings, variance = embedding.pca(expr, cells, 29)
    got = {r.cell_id: np.array(r.vec) for r in scores.collect()}
    s = np.stack([got[str(i)] for i in range(70)])
    flat = x - x.mean(0)
    rest = flat - s @ np.linalg.pinv(s) @ flat  # all but the last component
    assert np.linalg.norm(rest, 2) ** 2 == pytest.approx(np.sort(np.linalg.eigvalsh(flat.T @ flat))[0], rel=1e-6)
    assert variance.agg({"ratio": "sum"}).first()[0] < 1 and loadings.count() == 30 * 29


def test_harmony_identity_and_mixing(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(120, 3)) + np.repeat([[4, 0, 0], [0, 4, 0]], 60, axis=0)
    batch = np.arange(120) % 2
    x = base + np.where(batch[:, None] == 1, 1.5, 0.0)
    frame = spark.createDataFrame([(f"s{b}", str(i), row.tolist()) for i, (row, b) in enumerate(zip(x, batch))], "slide_id string, cell_id string, vec array<double>")
    one = frame.withColumn("slide_id", F.lit("only"))
    assert embedding.harmony(one, one.select("slide_id", "cell_id")) is one
    out = embedding.harmony(frame, frame.select("slide_id", "cell_id"), max_iter=5, n_clusters=4)
    rows = {int(r.cell_id): np.array(r.vec) for r in out.collect()}
    z = np.stack([rows[i] for i in range(120)])
    gap = lambda v: np.linalg.norm(v[batch == 1].mean(0) - v[batch == 0].mean(0))
    assert gap(z) < 0.5 * gap(x)


def test_fuzzy_weights_are_symmetric_and_bounded(spark):
    rng = np.random.default_rng(7)
    frame = spark.createDataFrame([(str(i), r.tolist()) for i, r in enumerate(rng.normal(size=(40, 3)))], "cell_id string, vec array<double>")
    w = {(r.src, r.dst): r.weight for r in embedding.fuzzy_weights(neighbors.embedding_knn(frame, 5), 5).collect()}
    assert all(w[(b, a)] == pytest.approx(v) and 0 < v <= 1 + 1e-12 for (a, b), v in w.items())


def test_enrichment_rows_and_null(spark):
    rng = np.random.default_rng(8)
    frame = points_frame(spark, rng.normal(size=(90, 2)).tolist())
    labels = frame.select("slide_id", "cell_id", F.when(F.col("x") > 0.4, "r").otherwise("l").alias("label"))
    out = spatial.enrichment_test(neighbors.spatial_knn(frame, 5), labels, n_permutations=40).collect()
    for a in "lr":
        assert sum(r.observed for r in out if r.type_a == a) == pytest.approx(1.0)
        assert sum(r.null_mean for r in out if r.type_a == a) == pytest.approx(1.0)
    same = next(r for r in out if r.type_a == r.type_b == "r")
    share = labels.filter("label = 'r'").count() / 90
    assert same.z_score > 3 and abs(same.null_mean - share) < 0.05
    shuffled = spatial.shuffled_labels(labels, F.sequence(F.lit(0), F.lit(2)), 1, per_bucket=10)
    assert shuffled.filter("label = 'r'").groupBy("perm").count().select("count").distinct().count() == 1


def test_silhouette_edge_cases(spark):
    frame = spark.createDataFrame([("a", [0.0]), ("b", [1.0]), ("c", [10.0])], "cell_id string, vec array<double>")
    labels = spark.createDataFrame([("two", "a", "x"), ("two", "b", "x"), ("two", "c", "y"), ("one", "a", "x"), ("one", "b", "x"), ("one", "c", "x")],
                                   "variant string, cell_id string, label string")
    out = {r.variant: r.silhouette for r in quality.silhouette(frame, labels).collect()}
    assert out["one"] == -1.0 and out["two"] == pytest.approx((0.9 + 8 / 9) / 3)


def ring_of_cliques(spark, variant, n=6, size=5):
    rows = []
    for c in range(n):
        nodes = [f"{c:02d}_{i}" for i in range(size)]
        rows += [(variant, a, b, 1.0) for a in nodes for b in nodes if a != b]
        other = f"{(c + 1) % n:02d}_0"
        rows += [(variant, nodes[1], other, 0.5), (variant, other, nodes[1], 0.5)]
    return spark.createDataFrame(rows, "variant string, src string, dst string, weight double")


def test_a_variant_is_the_same_alone_and_in_company(spark):
    mine = ring_of_cliques(spark, "a")
    resting = spark.createDataFrame([("b", f"p{i}", f"p{j}", 1.0) for k in range(300) for i, j in ((2 * k, 2 * k + 1), (2 * k + 1, 2 * k))],
                                    "variant string, src string, dst string, weight double")
    variants = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "variant string, gamma double")
    alone = {(r.cell_id, r.label) for r in community.communities(mine, variants.filter("variant = 'a'")).collect()}
    both = {(r.cell_id, r.label) for r in community.communities(mine.unionByName(resting), variants).filter("variant = 'a'").collect()}
    assert alone == both and len({label for _, label in alone}) == 6


def test_components_of_a_long_chain(spark):
    n = 150
    edges = spark.createDataFrame([(f"{i:04d}", f"{i + d:04d}") for i in range(n) for d in (-1, 1) if 0 <= i + d < n], "src string, dst string")
    nodes = spark.createDataFrame([(f"{i:04d}",) for i in range(n)], "cell_id string")
    assert {r.component for r in community.connected_components(edges, nodes).collect()} == {"0000"}


def test_silhouette_is_of_all_rows_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(quality, "TILE", 7)
    rng = np.random.default_rng(4)
    points, codes = rng.normal(0, 1, (60, 3)), rng.integers(0, 3, 60)
    frame = spark.createDataFrame([(f"c{i}", [float(x) for x in p]) for i, p in enumerate(points)], "cell_id string, vec array<double>")
    labels = spark.createDataFrame([("v", f"c{i}", str(c)) for i, c in enumerate(codes)], "variant string, cell_id string, label string")
    dist = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    want = []
    for i, c in enumerate(codes):
        a = dist[i, codes == c].sum() / ((codes == c).sum() - 1)
        b = min(dist[i, codes == o].mean() for o in set(codes) - {c})
        want.append((b - a) / max(a, b))
    assert abs(quality.silhouette(frame, labels).first().silhouette - np.mean(want)) < 1e-9
