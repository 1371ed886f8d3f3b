"""All rows against all rows without a shuffle of vectors: neighbours, hashed neighbours and silhouettes against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytomosaic.operators import community, descent, moving, neighbors, pairs, quality


def frame(spark, x):
    return spark.createDataFrame([(f"v{i:04d}", row.tolist()) for i, row in enumerate(x)], "cell_id string, vec array<double>")


def plan_of(df):
    return df._jdf.queryExecution().toString()


def brute(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), np.round(d, 12)), axis=1)[:, :k]
    return {(f"v{i:04d}", f"v{j:04d}") for i, row in enumerate(order) for j in row}


@pytest.mark.parametrize("scale", [1.0, 1e-3, 1e18])
def test_packs_give_the_exact_neighbours(spark, monkeypatch, scale):
    monkeypatch.setattr(pairs, "LEAST", 40)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(250, 8)), np.full((30, 8), 0.25), rng.normal(size=(40, 8)) * 1e-4 + 5]) * scale
    got = neighbors.embedding_knn(frame(spark, x), 7, block_rows=32)
    assert {(r.src, r.dst) for r in got.collect()} == brute(x, 7)
    assert "CoGroup" not in plan_of(got)  # before, both sides of every pair of blocks were shuffled


def test_hashed_neighbours_meet_without_a_join_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(pairs, "LEAST", 32)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6))
    seen = []
    monkeypatch.setattr(neighbors, "_rank_neighbours", lambda df, k, rank=neighbors._rank_neighbours: (seen.append(plan_of(df)), rank(df, k))[1])
    got = neighbors.approximate_embedding_knn(frame(spark, x), 5, bucket_length=4.0, radius=3.0).collect()
    hit = {(r.src, r.dst) for r in got}
    assert len(hit) == 1500 and len(hit & brute(x, 5)) >= 1350
    assert "CartesianProduct" in seen[0] and "BroadcastNestedLoop" not in seen[0]


def test_exact_neighbours_of_several_cells(spark):
    x = np.random.default_rng(7).normal(size=(120, 4))
    got = neighbors.exact_neighbours(frame(spark, x[:50]), frame(spark, x), 5, query_rows=20, block_rows=50)
    assert {(r.src, r.dst) for r in got.collect()} == {e for e in brute(x, 5) if e[0] < "v0050"}
    assert neighbors.exact_neighbours(frame(spark, x).limit(0), frame(spark, x), 5).count() == 0  # before: Expected Array, got ChunkedArray


def test_descent_compares_all_pairs_up_to_a_size(spark, monkeypatch):
    monkeypatch.setattr(descent, "BLOCK_ROWS", 64)
    x = np.random.default_rng(5).normal(size=(400, 20))
    assert {(r.src, r.dst) for r in descent.descent_knn(frame(spark, x), 6).collect()} == brute(x, 6)


def test_silhouette_in_packs_equals_the_one_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(pairs, "LEAST", 16)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 4)) + 3 * (np.arange(150) % 3)[:, None]
    rows = [("a", f"v{i:04d}", str(i % 3)) for i in range(150)] + [("b", f"v{i:04d}", "only") for i in range(40)]
    rows += [("c", f"v{i:04d}", str(min(i, 2))) for i in range(90)] + [("c", "v0100", None)]
    labels = spark.createDataFrame(rows, "variant string, cell_id string, label string")
    got = {r.variant: r.silhouette for r in quality.silhouette(frame(spark, x), labels).collect()}
    assert "CoGroup" not in plan_of(quality.silhouette(frame(spark, x), labels))
    monkeypatch.setattr(quality, "WIDE", 0)
    assert got == pytest.approx({r.variant: r.silhouette for r in quality.silhouette(frame(spark, x), labels).collect()}, abs=1e-9)
    assert got["b"] == -1.0 and quality.silhouette(frame(spark, x), labels.filter("label = 'none'")).count() == 0


def test_a_part_of_two_million_edges_runs_in_a_task():
    assert community.LOCAL_EDGES >= 2_000_000  # before, the graph of 100,000 cells went through rounds of joins


def test_best_options_by_gain_then_marks():
    src, dst = np.array([0, 0, 1, 2, 1, 3]), np.array([1, 2, 0, 0, 3, 1])
    weight, mark = np.array([5, 5, 5, 5, 1, 1]), np.array([1, 7, 9, 3])
    degree = np.array([10, 6, 5, 1])
    label = moving.move(src, dst, weight, degree, np.arange(4), mark, 1e-6, 22, 42, 0, 0)
    assert len(set(label.tolist())) == 1


def test_names_are_numbered_in_order(spark):
    edges = [("one", a, b, 1.0) for a, b in [("b", "a"), ("a", "b"), ("c", "a"), ("a", "c"), ("z", "y"), ("y", "z")]]
    df = spark.createDataFrame(edges, "variant string, src string, dst string, weight double")
    got = community.communities(df, spark.createDataFrame([("one", 0.5)], "variant string, gamma double")).filter(F.col("label") == "0")
    assert {r.cell_id for r in got.collect()} == {"a", "b", "c"}


def test_silhouette_of_more_labels_than_a_pass_takes_leaves_sums_in_their_tasks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 3))
    codes = {"a": rng.integers(0, 280, 300), "b": rng.integers(0, 40, 300), "c": rng.integers(0, 3, 300)}
    labels = spark.createDataFrame([(v, f"v{i:04d}", str(c)) for v, code in codes.items() for i, c in enumerate(code)], "variant string, cell_id string, label string")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))

    def want(code):
        mean = np.array([[d[i, code == c].sum() / max((code == c).sum() - (code[i] == c), 1) for c in np.unique(code)] for i in range(300)])
        own = np.searchsorted(np.unique(code), code)
        a, many = mean[np.arange(300), own].copy(), np.bincount(own)[own] > 1
        mean[np.arange(300), own] = np.inf
        return np.where(many, (mean.min(1) - a) / np.maximum(np.maximum(mean.min(1), a), 1e-300), 0.0).mean()

    for wide, past in ((1024, 1 << 28), (50, 1 << 28), (1024, 2000)):  # before, more than 1,024 labels met as one row per cell and label
        monkeypatch.setattr(quality, "WIDE", wide)
        monkeypatch.setattr(quality, "PAST", past)
        got = quality.silhouette(frame(spark, x), labels)
        assert {r.variant: r.silhouette for r in got.collect()} == pytest.approx({v: want(c) for v, c in codes.items()}, abs=1e-9)
        assert "CoGroup" not in plan_of(got) and ("FlatMapGroupsInArrow" in plan_of(got)) == (past == 2000)


def test_ids_decide_among_equal_distances_only():
    rng = np.random.default_rng(9)
    row, dist, dst = rng.integers(0, 20, 600), np.round(rng.integers(0, 6, 600) / 3.0, 12), np.array([f"v{i}" for i in rng.permutation(600)])
    assert (pairs._ordered(row, dist, dst) == np.lexsort((dst, dist, row))).all()


def test_targets_are_prepared_once_for_several_sources():
    x = np.concatenate([np.random.default_rng(10).normal(size=(90, 5)), np.zeros((10, 5))])
    ids = np.array([f"v{i:04d}" for i in range(100)])
    targets, found = pairs.Targets(ids, x), set()
    for lo in (0, 40):
        nearest = pairs.Nearest(ids[lo:lo + 60], x[lo:lo + 60], np.full(60, np.inf), 4)
        nearest.meet(targets, lambda a, b: None)
        found |= {e for batch in nearest.edges() for e in zip(batch.column("src").to_pylist(), batch.column("dst").to_pylist())}
    assert found == brute(x, 4) and len(targets.made) == 1
