"""SuperMinHash groups, vector codes and hard negatives against plain versions, on odd tables and with small tiles."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cytomosaic.llm import codebooks, negatives, superminhash
from cytomosaic.session import cut

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASH = ["n", "node", "mark", "cluster", "keys", "component_id", "_row", "state", "code", "was", "key", "summary"]


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# ---- near-duplicates -------------------------------------------------------------------------------------------------------

def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset(map(tuple, [words] if words else []))


def groups(docs):
    """[(doc_id, text)] -> [(doc_id, n, component, kept)] over all pairs."""
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    out = [(d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets))]
    return sorted(((d, n, c, d is not None and d == c) for d, n, c in out), key=str)


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6))) for _ in range(n)]


def changed(rng, text, n):
    text = list(text)
    for at in rng.sample(range(len(text)), n):
        text[at] = "".join(rng.choice("xyz") for _ in range(8))
    return text


def sample(rng):
    base, other = words(rng, 90), words(rng, 300)
    texts = [" ".join(base), " ".join(base).upper(), "\t".join(base) + "\n", None, "", "  \n\x0b ", "one", "ONE", "one two", "two one", "one two three"]
    texts += [" ".join(changed(rng, base, k)) for k in (1, 2, 3, 4, 6, 9, 14)]
    texts += [" ".join(other[: 300 - k]) for k in (0, 20, 40, 59, 60, 61, 80, 120)]
    # 4 of 5 shingles: exactly at the bound; 3 of 5: below
    texts += ["a b c d e", "a b c d e f", "p q r s", "p q r s t u", "Ünïcode wört ünïcode", "ÜNÏCODE wört ünïcode"]
    texts += [" ".join(words(rng, 30_000)), " ".join(words(rng, 12)), "x" * 2_000_000]
    return list(enumerate(texts))


def near(spark, table):
    df = spark.createDataFrame([(*r, *["clash"] * len(CLASH)) for r in table], "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASH))
    return rows_of(superminhash.near_duplicates(df), "doc_id", "n_shingles", "component_id", "kept")


def test_near_duplicates_match_all_pairs(spark):
    docs = sample(random.Random(3))
    assert near(spark, docs) == groups(docs)
    odd = docs + docs[:4] + docs[10:12] + [(None, docs[0][1]), (None, "said once"), (None, None), (None, docs[0][1])]
    assert near(spark, odd) == groups(odd)
    assert near(spark, []) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_of_many_tiles_and_crowded_buckets(spark, monkeypatch, seed):
    monkeypatch.setattr(superminhash, "TILE", 8)
    monkeypatch.setattr(superminhash, "PIVOTS", 2)
    monkeypatch.setattr(superminhash, "CROWD", 6)
    rng = random.Random(seed)
    base = words(rng, 120)
    texts = [changed(rng, base, rng.choice((2, 4, 8, 16))) for _ in range(40)]
    chain = [base]  # every text is near the one before only
    for _ in range(30):
        chain.append(changed(rng, chain[-1], 5))
    docs = [(i, " ".join(t)) for i, t in enumerate(texts + chain + [words(rng, 50) for _ in range(10)])]
    rng.shuffle(docs)
    assert near(spark, docs) == groups(docs)


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(5)
    for size, shared in ((3, 2), (40, 30), (400, 350), (70_000, 60_000)):
        errors = []
        for _ in range(20 if size < 1000 else 2):
            code = rng.integers(0, 1 << 63, 2 * size - shared, dtype=np.uint64)
            a, b = superminhash.signatures([code[:size], code[size - shared:]])
            assert a.max() < np.uint64(superminhash.M) << np.uint64(48)
            errors.append((a == b).mean() - shared / (2 * size - shared))
        assert abs(np.mean(errors)) < 0.03 and np.abs(errors).max() < 0.16
    assert (superminhash.signatures([np.zeros(0, np.uint64)]) == np.iinfo(np.uint64).max).all()


def test_walk_looks_at_a_dense_group_about_once():
    sets = [np.arange(i % 3, 200, dtype=np.uint64) for i in range(300)]
    found = list(superminhash.linked(np.arange(300), sets))
    assert len(found) == 1 and len(found[0][0]) == 299


# ---- vector codes ----------------------------------------------------------------------------------------------------------

def plain_codes(table):
    """[(vec_id, label, vector)] -> [(vec_id, code, error, label_error, digest)] by plain integer k-means."""
    finite = [r for r in table if r[2] and len(r[2]) % 8 == 0 and all(x is not None and math.isfinite(x) for x in r[2])]
    out, top = [], 2**63 - 1
    for length in {len(r[2]) for r in finite}:
        rows = [(i, l, [math.floor(float(np.float32(x)) * 4096) for x in v]) for i, l, v in finite if len(v) == length]
        first = {}
        for i, _, v in rows:
            if i is not None:
                first[i] = min(v, first.get(i, v))
        start = [first[i] for i in sorted(first)][:16]
        w = length // 8
        books = [[v[p * w:(p + 1) * w] for v in start] for p in range(8)]
        parts = [[v[p * w:(p + 1) * w] for p in range(8)] for *_, v in rows]

        def assign():
            return [[min((sum((x - c) ** 2 for x, c in zip(part, e)), k) for k, e in enumerate(book)) for part, book in zip(row, books)] for row in parts]

        for _ in range(6):
            near_ = assign()
            for p in range(8):
                for k in range(len(books[p])):
                    mine = [row[p] for row, n in zip(parts, near_) if n[p][1] == k]
                    if mine:
                        books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
        digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
        out += [(i, "".join(f"{k:02x}" for _, k in n), min(sum(d for d, _ in n), top), l, digest) for (i, l, _), n in zip(rows, assign())]
    total = Counter()
    for _, _, e, l, _ in out:
        total[l] += e
    return sorted(((i, c, e, min(total[l], top), s) for i, c, e, l, s in out), key=str)


def vectors(rng, n, length=16, spread=1.0):
    centres = rng.normal(size=(5, length))
    return [(int(i), int(rng.integers(0, 4)) if rng.random() < 0.9 else None, (centres[i % 5] + spread * rng.normal(size=length)).astype(np.float32).tolist()) for i in range(n)]


def embedded(spark, table):
    return spark.createDataFrame([(*r, *["clash"] * len(CLASH)) for r in table], "vec_id long, label int, embedding array<float>, " + ", ".join(f"{c} string" for c in CLASH))


ODD = [(900, 1, None), (901, 1, []), (902, 1, [1.0] * 15 + [None]), (903, 1, [float("nan")] + [0.0] * 15), (904, 1, [float("inf")] + [0.0] * 15),
       (905, 2, [0.5] * 15), (None, 1, [0.25] * 16), (None, None, [-0.25] * 16)]


def codes(spark, table):
    return rows_of(codebooks.compress(embedded(spark, table)), "vec_id", "code", "error", "label_error", "codebooks_sha256")


def test_codes_match_plain_k_means(spark):
    rng = np.random.default_rng(1)
    table = vectors(rng, 150)
    table += table[3:6] + ODD + [(3, 1, [0.125] * 16), (700, 3, [0.5] * 8), (701, 3, [0.25] * 8), (702, None, [0.25] * 8)]
    table += [(i, 0, [0.0] * 16) for i in range(800, 820)]  # ties between equal entries and equal rows
    assert codes(spark, table) == plain_codes(table)
    assert codes(spark, table[:3]) == plain_codes(table[:3])
    assert codes(spark, []) == [] and codes(spark, ODD[:6]) == []


def test_codes_of_huge_components(spark):
    rng = np.random.default_rng(2)
    table = [(i, l, [x * (3e37 if i % 9 == 0 else 1e6 if i % 2 else 1) for x in v]) for i, l, v in vectors(rng, 40)]
    table = [(i, l, np.array(v, np.float32).tolist()) for i, l, v in table]
    assert codes(spark, table) == plain_codes(table)


@pytest.mark.parametrize("b", [0, 1, 2, 4])
def test_bounds_give_the_nearest_entry_with_fewer_distances(b):
    rng = np.random.default_rng(b)
    x = rng.integers(-60, 60, (3000, 3))
    entries = x[: max(1, b + 1) if b < 4 else 16].copy()
    state, drift, total = codebooks.Bounds.unknown(len(x), b), np.zeros(len(entries)), 0
    for _ in range(12):
        used = np.zeros(b + 2, np.int64)
        total += codebooks.reassign(x, entries, state, drift, used)
        exact = ((x[:, None] - entries[None]) ** 2).sum(2)
        assert (state.code == exact.argmin(1)).all() and used.sum() == len(x)
        own = np.sqrt(exact[np.arange(len(x)), state.code])
        assert (own <= state.upper).all()
        rest = np.where(np.arange(len(entries)) == state.code[:, None], np.inf, exact).min(1) if len(entries) > 1 else np.full(len(x), np.inf)
        assert (state.lower[:, 0] <= np.sqrt(rest)).all()
        state = codebooks.Bounds.unpack(state.code.astype(np.uint8), state.pack(), b)
        new = np.array([x[state.code == k].sum(0) // max(1, (state.code == k).sum()) if (state.code == k).any() else entries[k] for k in range(len(entries))])
        drift, entries = np.nextafter(np.sqrt(((new - entries) ** 2).sum(1).astype(float)), np.inf), new
    assert total < 12 * len(x) * len(entries) or len(entries) < 4


def test_work_falls_as_entries_rest(spark):
    _, books, work = codebooks.fit(cut(codebooks.usable(embedded(spark, vectors(np.random.default_rng(4), 400, spread=0.05)))))
    spent = [w[16]["distances"] for w in work]
    assert len(books) == 1 and len(work) == 7 and spent[0] == 400 * 8 * 16
    assert all(sum(w[16]["settled"]) == 400 * 8 for w in work) and spent[-1] < spent[0] / 2


# ---- hard negatives --------------------------------------------------------------------------------------------------------

def plain_negatives(table, every=5):
    top = 2**63 - 1
    rows = [(i, l, [math.floor(256 * float(np.float32(x))) for x in v]) for i, l, v in table
            if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, l, v in rows:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (len(v), v, l)), (len(v), v, l))
    out = []
    for a, (n, q, label) in anchors.items():
        scored = [(max(min(sum(x * y for x, y in zip(q, v)), top), -top - 1), i, l) for i, l, v in rows if i != a and len(v) == n]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for p, (score, i, _) in enumerate([s for s in scored if s[2] == label][:5]):
            kept = [s for s in scored if s[2] != label and 30 * score <= 100 * s[0] <= 90 * score][:10]
            out += [(a, i, rank + 1, s[1], score, s[0]) for rank, s in enumerate(kept)]
    return sorted(out, key=str)


def negatives_of(spark, table):
    from pyspark.sql import functions as F

    rows = negatives.usable(embedded(spark, table), F.col("label"))
    return rows_of(negatives.mine(rows, F.col("vec_id") % 5 == 0), "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("chunk, sample_rows", [(8192, 16384), (3, 20)])
def test_negatives_match_brute_force(spark, monkeypatch, chunk, sample_rows):
    monkeypatch.setattr(negatives, "CHUNK", chunk)
    monkeypatch.setattr(negatives, "SAMPLE", sample_rows)
    rng = np.random.default_rng(6)
    table = vectors(rng, 120, 20, 0.7)
    table += table[5:8] + ODD + [(10, 2, [0.5] * 20), (300, 1, [0.5] * 7), (301, 1, [0.25] * 7), (302, 2, [0.125] * 7), (303, 2, [0.2] * 7)]
    table += [(i, i % 2, [0.0] * 20) for i in range(400, 412)]  # scores of 0, and ties
    assert negatives_of(spark, table) == plain_negatives(table)
    assert negatives_of(spark, []) == [] and negatives_of(spark, ODD) == plain_negatives(ODD)


def test_negatives_beyond_double_integers(spark):
    rng = np.random.default_rng(7)
    table = [(i, l, [float(np.float32(x * (1e9 if i % 3 else 1))) for x in v]) for i, l, v in vectors(rng, 60, 8)]
    assert negatives_of(spark, table) == plain_negatives(table)


def test_summaries_bound_scores_and_spare_exact_products():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 32)).repeat(4, axis=1)  # segments that are nearly flat: the coarse levels tell rows apart
    x = np.floor(256 * (centres[rng.integers(0, 12, 600)] + 0.05 * rng.normal(size=(600, 128))))
    s, exact = negatives.summary(x), x @ x.T
    for level in range(3):
        low, high = negatives.bounds(s, s, 128, level)
        assert (low <= exact + 1e-3).all() and (exact <= high + 1e-3).all()
    q, done = slice(0, 40), [0] * 4
    floor = np.sort(exact[q], axis=1)[:, -20]
    i, j, score = negatives.scores(x[q], s[q], x, s, np.ones((40, 600), bool), floor, np.full(40, np.inf), done)
    want = defaultdict(set)
    for a, b, c in zip(i, j, score):
        assert exact[a, b] == c
        want[a].add(b)
    assert all(set(np.flatnonzero(exact[a] >= floor[a])) <= want[a] for a in range(40))
    assert done[0] == 40 * 600 and done[0] > done[1] > done[2] >= done[3] and done[3] < 40 * 600 / 4
