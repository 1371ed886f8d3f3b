"""Community detection: rounds in a task and by joins agree, parts rest by themselves, results are connected and at rest."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytomosaic.operators import community, moving


def weighted(rng, n, prefix="n", k=4):
    """Edges (src, dst, weight) of points on a plane to their nearest neighbours, both directions."""
    x = rng.normal(size=(n, 2)) + 3 * rng.integers(0, 3, (n, 1))
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    near = np.argsort(d, axis=1)[:, 1:k + 1]
    pairs = {(min(i, j), max(i, j)) for i in range(n) for j in near[i]}
    name = lambda i: f"{prefix}{i:03d}"
    rows = [(name(i), name(j), float(np.exp(-d[i, j]))) for i, j in pairs]
    return rows + [(b, a, w) for a, b, w in rows]


def frame(spark, rows, variant="v"):
    return spark.createDataFrame([(variant, *r) for r in rows], "variant string, src string, dst string, weight double")


def labels_of(spark, edges, gamma, variant="v"):
    out = community.communities(edges, spark.createDataFrame([(variant, gamma)], "variant string, gamma double"))
    return {r.cell_id: r.label for r in out.collect()}


def groups(labels):
    by = {}
    for cell, label in labels.items():
        by.setdefault(label, set()).add(cell)
    return {frozenset(x) for x in by.values()}


def test_rounds_by_joins_give_the_labels_of_rounds_in_a_task(spark, monkeypatch):
    rows = weighted(np.random.default_rng(1), 24) + weighted(np.random.default_rng(2), 9, "q", 2)
    whole = labels_of(spark, frame(spark, rows), 1.0)
    monkeypatch.setattr(community, "LOCAL_EDGES", 20)
    monkeypatch.setattr(community, "STEPS", 1)
    joined = labels_of(spark, frame(spark, rows), 1.0)
    monkeypatch.setattr(community, "LOCAL_EDGES", 1 << 20)
    assert labels_of(spark, frame(spark, rows), 1.0) == joined
    assert set(joined) == set(whole)


def test_a_slide_alone_is_the_same_in_a_graph_of_128(spark):
    mine = weighted(np.random.default_rng(3), 60, "mine")
    others = [(f"{i}{a}", f"{i}{b}", w) for i in range(127) for a, b, w in mine]
    alone = labels_of(spark, frame(spark, mine), 0.5)
    # the same null model: resolution over total weight is equal
    company = labels_of(spark, frame(spark, mine + others), 0.5 * 128)
    assert groups(alone) == groups({c: x for c, x in company.items() if c.startswith("mine")}) and len(groups(alone)) > 2


def arrays(rows):
    ids = sorted({r[0] for r in rows})
    code = {x: i for i, x in enumerate(ids)}
    src, dst = (np.array([code[r[i]] for r in rows]) for i in (0, 1))
    return src, dst, np.array([round(r[2] * (1 << 24)) for r in rows], np.int64), np.random.default_rng(0).integers(-(1 << 62), 1 << 62, len(ids))


@pytest.mark.parametrize("seed, gamma", [(1, 0.5), (2, 1.0), (3, 2.0)])
def test_communities_are_connected_and_at_rest(seed, gamma):
    src, dst, w, mark = arrays(weighted(np.random.default_rng(seed), 300))
    n, m2 = len(mark), int(w.sum())
    degree = np.bincount(src, weights=w).astype(np.int64)
    label = moving.move(src, dst, w, degree, np.arange(n), mark, gamma, m2, seed, 0, 0)
    total = np.bincount(label, weights=degree, minlength=n)
    for v in range(n):
        mine = src == v
        inside = np.bincount(label[dst[mine]], weights=w[mine], minlength=n)
        gain = inside - gamma * degree[v] * (total - np.where(np.arange(n) == label[v], degree[v], 0)) / m2
        assert gain[np.unique(label[dst[mine]])].max() <= gain[label[v]] + 1e-6 * degree[v]
    done = moving.settle(src, dst, w, mark, gamma, m2, seed, range(2))
    assert (moving.pieces(src, dst, done) == done).all()

    def quality(c):
        t = np.bincount(c, weights=degree, minlength=n)
        return (w * (c[src] == c[dst])).sum() / m2 - gamma * (t / m2 * t / m2).sum()

    assert quality(done) >= quality(moving.settle(src, dst, w, mark, gamma, m2, seed, range(1))) - 1e-12
    assert quality(done) > quality(moving.pieces(src, dst, label)) - 1e-12


def test_pieces_name_parts_by_their_smallest_node():
    src, dst = np.array([0, 1, 2, 3, 5, 4]), np.array([1, 0, 3, 2, 4, 5])
    assert moving.pieces(src, dst, np.array([9, 9, 9, 9, 7, 7])).tolist() == [0, 0, 2, 2, 4, 4]


def test_no_edges(spark):
    assert labels_of(spark, frame(spark, []), 1.0) == {}


def test_variants_have_their_own_resolution(spark):
    rows = weighted(np.random.default_rng(5), 80)
    both = frame(spark, rows, "low").unionByName(frame(spark, rows, "high"))
    variants = spark.createDataFrame([("low", 0.2), ("high", 3.0)], "variant string, gamma double")
    n = {r.variant: r.n for r in community.communities(both, variants).groupBy("variant").agg(F.countDistinct("label").alias("n")).collect()}
    assert n["low"] < n["high"]


@pytest.mark.parametrize("stars", [0, 1 << 20])
def test_parts_of_a_graph_by_stars(spark, monkeypatch, stars):
    from cytomosaic.operators import community

    monkeypatch.setattr(community, "STARS", stars)
    monkeypatch.setattr(community, "HELD_NODES", 7)
    links = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40) if i % 10 != 9] + [("x", "x")]
    rows = [("v", *e, 1) for a, b in links for e in {(a, b), (b, a)}]
    found = community._parts(spark.createDataFrame(rows, "variant string, src string, dst string, w long").repartition(5))
    assert found.columns == ["variant", "src", "dst", "w", "part"] and found.count() == len(rows)
    for r in found.collect():
        assert r.part.split("\u0001")[-1] == ("x" if r.src == "x" else f"n{int(r.src[1:]) // 10 * 10:03d}")
    calls = []
    real = community.connected_components
    monkeypatch.setattr(community, "connected_components", lambda *a: calls.append(1) or real(*a))
    community._parts(spark.createDataFrame(rows, "variant string, src string, dst string, w long"))
    assert bool(calls) == (stars == 0)


def test_variants_share_a_graph(spark):
    rows = weighted(np.random.default_rng(6), 70) + weighted(np.random.default_rng(7), 9, "q", 2)
    both = frame(spark, rows, "low").unionByName(frame(spark, rows, "high"))
    variants = spark.createDataFrame([("low", 0.2), ("high", 3.0)], "variant string, gamma double")
    shared = community.communities(frame(spark, rows).drop("variant"), variants)
    assert sorted(shared.collect()) == sorted(community.communities(both, variants).collect())


def test_large_parts_of_a_shared_graph_by_joins(spark, monkeypatch):
    rows = weighted(np.random.default_rng(1), 20) + weighted(np.random.default_rng(2), 5, "q", 2)
    variants = spark.createDataFrame([("low", 0.2), ("high", 3.0)], "variant string, gamma double")
    monkeypatch.setattr(community, "STEPS", 1)
    whole = sorted(community.communities(frame(spark, rows).drop("variant"), variants).collect())
    monkeypatch.setattr(community, "LOCAL_EDGES", 20)
    assert sorted(community.communities(frame(spark, rows).drop("variant"), variants).collect()) == whole


def test_a_part_of_thirty_million_edges_runs_in_a_task():
    assert community.LOCAL_EDGES >= 30_000_000  # before, a graph of 600,000 cells went through rounds of joins


@pytest.mark.parametrize("strip", [30, 1 << 18])
def test_rounds_pass_over_strips(monkeypatch, strip):
    src, dst, w, mark = arrays(weighted(np.random.default_rng(4), 200))
    monkeypatch.setattr(moving, "STRIP", 1 << 18)
    whole = moving.settle(src, dst, w, mark, 1.0, int(w.sum()), 1, range(2))
    monkeypatch.setattr(moving, "STRIP", strip)
    assert (moving.settle(src, dst, w, mark, 1.0, int(w.sum()), 1, range(2)) == whole).all()
    a, b = (np.random.default_rng(s).integers(-(1 << 62), 1 << 62, 100) for s in (1, 2))
    assert moving.dot(a, b) == sum(int(x) * int(y) for x, y in zip(a, b))


def test_stars_of_many_chunks_meet(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(community, "LINKS", 3)
    links = [(i, i + 1) for i in range(40) if i % 10 != 9]
    batches = [pa.RecordBatch.from_pydict({"src": [a], "dst": [b]}) for a, b in links[::-1]]
    out = pa.Table.from_batches(community._stars(iter(batches), None)).to_pydict()
    assert dict(zip(out["src"], out["dst"])) == {i: i // 10 * 10 for i in range(40) if i % 10}
