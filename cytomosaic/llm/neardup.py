"""Near-duplicate texts for a corpus: Jaccard similarity of five-word shingle sets of at least 0.8, checked exactly.

Candidates are the links of SimHash fingerprints of these sets, found by the pigeonring filter (``simhash``). Three bits reach
few of the pairs near 0.8, of which about ten bits differ; these come from MinHash as well: 128 minima in 32 bands of 4, so a pair at
similarity 0.8 shares no band with probability (1 - 0.8^4)^32 = 5e-8. Texts that are linked or share a band fall into one cluster, by
stars and never by pairs. The shingle sets of a cluster then meet: they are compared exactly, through lists of the texts that hold
a shingle. A cluster of more than TILE texts is compared tile against tile, so no task holds it. Equal shingle sets are one text
from the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import cut_at_space, slices
from .components import components
from .simhash import bit_counts, link_edges, majority, one_of_each

SHINGLE = 5
SIMILARITY = (4, 5)  # a fraction of integers: the comparison is exact
BANDS, ROWS = 32, 4
#: Distinct texts of a cluster that meet in one task at most, twice that many for a pair of tiles.
TILE = 2048
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.random.default_rng(42).integers(1, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_SHIFTS = np.random.default_rng(43).integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles of one whole text; a shorter text is one shingle, a wordless one none."""
    digest, found, tail = xxhash.xxh64_intdigest, [], np.zeros(0, np.uint64)
    for piece in cut_at_space(text.lower()):
        words = np.concatenate((tail, np.array([digest(w) for w in piece.split()], np.uint64)))
        n = len(words) - SHINGLE + 1
        if n > 0:
            code = np.zeros(n, np.uint64)
            for i in range(SHINGLE):
                code = _mixed(code + _MIX + words[i:n + i])
            found.append(np.unique(code))
        tail = words[max(0, n):]
    if found:
        return np.unique(np.concatenate(found)) if len(found) > 1 else found[0]
    code = np.full(min(len(tail), 1), len(tail), np.uint64)
    for w in tail:
        code = _mixed(code + _MIX + w)
    return code


def band_keys(held: np.ndarray) -> np.ndarray:
    """One key per band of the MinHash minima of a shingle set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(held), 2048):
        np.minimum(least, (held[None, at:at + 2048] * _FACTORS + _SHIFTS).min(1), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = _mixed(key + _MIX + column)
    return key


def fingerprint(held: np.ndarray) -> int | None:
    """The SimHash fingerprint of a shingle set, as a signed number; none of an empty set."""
    return int(np.uint64(majority(bit_counts(held), len(held))).view(np.int64)) if len(held) else None


def _sketches(batches):
    for batch in slices(batches):
        node, fp, keys = [], [], []
        for text in batch.column(2).to_pylist():
            held = shingles(text.encode()) if text else np.zeros(0, np.uint64)
            node.append(xxhash.xxh64_intdigest(held.tobytes()) if len(held) else 0)
            fp.append(fingerprint(held))
            keys.append(band_keys(held).view(np.int64) if len(held) else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(node, np.uint64).view(np.int64)),
                                          pa.array(fp, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "mark", "node", "fp", "keys"])


def forest(nodes: list[int], sets: list[np.ndarray], side: np.ndarray | None = None):
    """Links (positions a, b) that span the groups of texts at SIMILARITY or more; with ``side``, only pairs of two sides count.

    A walk takes all unvisited neighbours of a text, so a dense group costs one look at each, and no pair is looked at twice.
    """
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    code, at = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(at, kind="stable")
    owner_of, starts = owner[order], np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(code)))))
    ends = np.concatenate(([0], np.cumsum(size)))
    fresh = np.ones(len(sets), bool)
    top, bottom = SIMILARITY
    for first in range(len(sets)):
        if not fresh[first]:
            continue
        fresh[first], queue = False, [first]
        while queue:
            x = queue.pop()
            lists = at[ends[x]:ends[x + 1]]
            low, n = starts[lists], starts[lists + 1] - starts[lists]
            lists = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            common = np.bincount(owner_of[lists], minlength=len(sets))
            near = fresh & (bottom * common >= top * (size + size[x] - common))
            if side is not None:
                near &= side != side[x]
            for y in np.flatnonzero(near).tolist():
                yield nodes[x], nodes[y]
            fresh &= ~near
            queue += np.flatnonzero(near).tolist()


def _tile_links(batches):
    """Links of the tiles of a task; rows (cluster, i, j, tile, node, text) come sorted by cluster, i and j."""
    now, nodes, sets, tiles = None, [], [], []

    def links():
        if len(nodes) > 1:
            found = list(forest(nodes, sets, None if now[1] == now[2] else np.array(tiles)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f(x) for x in found], pa.int64()) for f in (max, min)], ["a", "b"])

    for batch in slices(batches):
        for cluster, i, j, tile, node, text in zip(*(c.to_pylist() for c in batch.columns)):
            if (cluster, i, j) != now:
                yield from links()
                now, nodes, sets, tiles = (cluster, i, j), [], [], []
            nodes.append(node)
            sets.append(shingles(text.encode()))
            tiles.append(tile)
    yield from links()


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that tie the nodes of ``prints`` (node, fp) whose fingerprints are linked: equal ones by a star, others by their stars' centres."""
    least = cut(prints.groupBy("fp").agg(F.min("node").alias("least")))
    equal = prints.join(least, "fp").filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    end = lambda c: least.select(F.col("fp").alias(c), F.col("least").alias(f"n{c}"))
    near = link_edges(least.select("fp")).join(end("a"), "a").join(end("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    return equal.unionByName(near)


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, node, component) of every row: component is the same for all rows that are linked, over any number of texts.

    mark is a hash of the text, node one of its shingle set. Null, empty and wordless texts are one group.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    sketch = cut(rows.mapInArrow(_sketches, "doc_id long, mark long, node long, fp long, keys array<long>"))
    keys = cut(sketch.groupBy("node").agg(F.first("keys").alias("keys")).select("node", F.explode("keys").alias("key")))
    met = keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most").select("key", "least")
    shared = keys.join(met, "key").select(F.col("node").alias("a"), F.col("least").alias("b"))
    links = fingerprint_links(sketch.filter("fp IS NOT NULL").select("node", "fp").distinct())
    clusters = cut(components(shared.unionByName(links)).select("node", F.col("component").alias("cluster")))
    size = clusters.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("g"))
    # one text of each node: its smallest mark, and of rows with that mark any
    one = sketch.groupBy("node").agg(F.min("mark").alias("mark")).join(clusters, "node").join(size, "cluster")
    texts = rows.select("mark", "text").join(one, "mark").dropDuplicates(["node"])
    tile = F.pmod(F.xxhash64("node"), F.col("g")).cast("int")
    dealt = texts.withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).select(
        "cluster", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "node", "text")
    links = dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(_tile_links, "a long, b long")
    groups = components(links)
    return sketch.select("doc_id", "mark", "node").join(groups, "node", "left").select(
        "doc_id", "mark", "node", F.coalesce("component", "node").alias("component"))


def one_per_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without their near-duplicates: one row of each group stays, chosen as in ``simhash.one_of_each``."""
    return one_of_each(docs, grouped(docs))
