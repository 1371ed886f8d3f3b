"""The near-dedup stage of the pipeline against all pairs of exact Jaccard similarities of five-word shingles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cytomosaic.llm import neardup


def corpus():
    """Texts with copies that have a few words changed, down to similarities around 0.8, and odd rows."""
    rng = random.Random(8)
    texts = []
    for size in (60, 90, 150, 300, 600):
        for _ in range(6):
            base = [rng.choice("abcdefghij") + str(rng.randint(0, 400)) for _ in range(size)]
            texts.append(" ".join(base))
            for share in (0.005, 0.01, 0.015, 0.02, 0.025, 0.03, 0.05):
                near = list(base)
                for i in rng.sample(range(size), max(1, round(share * size))):
                    near[i] = "new" + str(rng.randint(0, 10**6))
                texts.append(" ".join(near))
    odd = [None, "", " \n", "two words", "Two  WORDS", "two other", texts[0].upper(), texts[0].replace(" ", "\n")]
    return list(enumerate(texts + odd)) + [(None, texts[1]), (0, texts[0])]


def groups(rows):
    """Smallest doc_id of every group, by all pairs."""
    def held(text):
        words = (text or "").lower().split()
        return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else None

    sets = [held(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (a is None and b is None) or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return least


@pytest.mark.parametrize("tile", [2048, 3])
def test_stage_keeps_one_of_all_that_are_alike(spark, monkeypatch, tile):
    monkeypatch.setattr(neardup, "TILE", tile)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash"))
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(groups(rows).values()) and kept[0].node == "clash"
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_fingerprints_alone_bring_copies_together(spark, monkeypatch):
    """Without bands, what is linked is what fingerprints within 3 bits tie and the exact check confirms."""
    monkeypatch.setattr(neardup, "band_keys", lambda held: np.zeros(0, np.uint64))
    rng = random.Random(11)
    texts = []
    for i in range(6):
        base = [rng.choice("abcdefghij") + str(rng.randint(0, 400)) for _ in range(800)]
        for j in range(5):
            near = list(base)
            near[100 * j + i] = f"new{j}"
            texts.append(" ".join(near))
    prints = [neardup.fingerprint(neardup.shingles(t.encode())) % (1 << 64) for t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if a // 5 == b // 5 and (prints[a] ^ prints[b]).bit_count() <= 3:
                group = [group[b] if g == group[a] else g for g in group]
    assert len(set(group)) < 12
    docs = spark.createDataFrame(list(enumerate(texts)) + [(90, None), (91, "")], "doc_id long, text string")
    kept = corpus_pipeline.near_dedup(spark, docs, "").count()
    assert kept == len(set(group)) + 1


def test_fingerprints_tie_by_stars(spark):
    rows = [(5, 0b111), (3, 0b111), (9, 0), (4, -1), (8, -2), (7, 1 << 40 | 1 << 50 | 1 << 60 | 1)]
    links = {(r.a, r.b) for r in neardup.fingerprint_links(spark.createDataFrame(rows, "node long, fp long")).collect()}
    assert {frozenset(x) for x in links} == {frozenset(x) for x in ((5, 3), (3, 9), (4, 8))}
