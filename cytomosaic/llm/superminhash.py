"""Near-duplicate texts by SuperMinHash (Ertl 2017): signatures, banding, exact verification and union-find grouping.

Every element of a set draws a random permutation of the M signature slots; its j-th draw offers the slot the value j + r with
a fresh r in [0, 1), and a slot keeps its least offer. Offers of later ranks are larger, so a set stops as soon as every slot
holds an offer of an earlier rank: about M ln M draws for a small set, little more than one draw per element for a large one.
As no element serves a slot twice before it has served all, signatures vary less than those of independent minima.

Texts of equal sets are one node. BANDS bands of ROWS slots bring nodes together: a pair at similarity 0.8 shares no band with
probability (1 - 0.8^5)^40 = 1e-7. Within a bucket, pairs whose sizes or sampled slots rule out 0.8 (six standard deviations
below) fall away; the rest ties nodes to clusters. The whole shingle sets of a cluster then meet in tiles and are compared
exactly; only a spanning forest of the confirmed links leaves a task. A cluster of many tiles is first tied together by a few
pivots that go into every tile; after that only texts outside its largest group still meet the others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut
from .common import cut_at_space, slices
from .components import components

SHINGLE = 2
SIMILARITY = (80, 100)  # a fraction of integers: the comparison is exact
BANDS, ROWS = 40, 5
M = BANDS * ROWS
#: Slots whose low byte estimates the similarity of a pair in a bucket, and matches needed: 0.5, six deviations below 0.8.
SAMPLE, MATCHES = 64, 32
#: A bucket of more nodes is tied together without comparing: verification decides.
CROWD = 4096
#: Texts and shingles of a tile.
TILE, TILE_SHINGLES = 2048, 1 << 21
PIVOTS = 8
#: Elements whose permutations are drawn at a time (M bytes each).
DRAW = 1 << 16
_RANK = np.uint64(48)
_LOW = np.uint64((1 << 48) - 1)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.arange(1, M + 1, dtype=np.uint64) * _GOLDEN


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the two-word shingles of one whole text; a single word is one shingle, no word none."""
    digest, found, tail = xxhash.xxh64_intdigest, [], np.zeros(0, np.uint64)
    for piece in cut_at_space(text.lower()):
        words = np.concatenate((tail, np.array([digest(w) for w in piece.split()], np.uint64)))
        if len(words) > 1:
            found.append(np.unique(_mixed(_mixed(words[:-1] + _GOLDEN) + words[1:])))
        tail = words[-1:]
    if found:
        return np.unique(np.concatenate(found)) if len(found) > 1 else found[0]
    return _mixed(tail)


def _draw(sig: np.ndarray, owner: np.ndarray, code: np.ndarray) -> None:
    """Lower ``sig`` (sets x M) by all offers of the elements ``code``, whose sets are ``owner``."""
    flat = sig.reshape(-1)
    perm = None
    for rank in range(M):
        x = _mixed(code + _STEPS[rank])
        place = rank + ((x >> _RANK) * np.uint64(M - rank) >> np.uint64(16)).astype(np.int64)
        if perm is None:
            slot = place
        else:
            each = np.arange(len(code))
            slot = perm[each, place].astype(np.int64)
            perm[each, place] = perm[:, rank]
        np.minimum.at(flat, owner * M + slot, (np.uint64(rank) << _RANK) | (x & _LOW))
        sets = owner[np.concatenate(([True], owner[1:] != owner[:-1]))]
        unsettled = np.zeros(len(sig), bool)
        unsettled[sets[sig[sets].max(1) >= np.uint64(rank + 1) << _RANK]] = True
        on = unsettled[owner]
        if not on.any():
            return
        owner, code = owner[on], code[on]
        if perm is None:  # permutations are held for the sets that go on only
            perm = np.tile(np.arange(M, dtype=np.uint8), (len(code), 1))
            perm[np.arange(len(code)), place[on]] = 0
        elif not on.all():
            perm = perm[on]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash signatures (sets x M, uint64: rank above 48 random bits) of hashed sets; an empty set keeps all ones."""
    sig = np.full((len(sets), M), np.iinfo(np.uint64).max, np.uint64)
    owner, code, n = [], [], 0

    def flush():
        if n:
            _draw(sig, np.concatenate(owner), np.concatenate(code))

    for i, held in enumerate(sets):
        for at in range(0, len(held), DRAW):
            part = held[at:at + DRAW]
            if n and n + len(part) > DRAW:
                flush()
                owner, code, n = [], [], 0
            owner.append(np.full(len(part), i))
            code.append(part)
            n += len(part)
    flush()
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per set and band."""
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sig), BANDS))
    for column in np.moveaxis(sig.reshape(len(sig), BANDS, ROWS), 2, 0):
        key = _mixed(key + _GOLDEN + column)
    return key


def _sketches(batches):
    for batch in slices(batches):
        sets = [shingles(t.encode()) if t else np.zeros(0, np.uint64) for t in batch.column(2).to_pylist()]
        sig = signatures(sets)
        keys = band_keys(sig).view(np.int64)
        sample = _mixed(sig[:, ::M // SAMPLE][:, :SAMPLE]).astype(np.uint8)
        node = [xxhash.xxh64_intdigest(s.tobytes()) if len(s) else None for s in sets]
        node = pa.array([None if x is None else x - (1 << 64) if x >> 63 else x for x in node], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), node,
             pa.array([k if len(s) else [] for k, s in zip(keys, sets)], pa.list_(pa.int64())), pa.array([s.tobytes() for s in sample], pa.binary())],
            ["doc_id", "mark", "n", "node", "keys", "sample"])


def _runs(batches, columns: int):
    """The runs of equal values in the first ``columns`` columns of a task's rows, which are sorted by them, as Arrow tables."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i).to_numpy() for i in range(columns)]
        change = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            change |= k[1:] != k[:-1]
        starts = np.concatenate(([0], np.flatnonzero(change) + 1, [batch.num_rows])).tolist()
        if held and last != [k[0] for k in keys]:
            yield pa.Table.from_batches(held)
            held = []
        for start, end in zip(starts[:-1], starts[1:]):
            if start:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
        last = [k[-1] for k in keys]
    if held:
        yield pa.Table.from_batches(held)


def _drop_single(batches):
    """Rows (key, node) of keys that two or more rows have; sorted by key."""
    rest = None
    for batch in batches:
        key, node = (batch.column(i).to_numpy() for i in (0, 1))
        if rest is not None:
            key, node = np.concatenate((rest[0], key)), np.concatenate((rest[1], node))
        if len(key) < 2:
            rest = key, node
            continue
        same = key[1:] == key[:-1]
        met = np.concatenate((same, [False])) | np.concatenate(([False], same))
        # the last row waits for the next batch; one that already met a row before it stays known through a copy of that row
        keep = 2 if same[-1] else 1
        out = met.copy()
        out[-keep:] = False
        yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(node[out])], ["key", "node"])
        rest = key[-keep:], node[-keep:]
    if rest is not None and len(rest[0]) == 2:
        yield pa.RecordBatch.from_arrays([pa.array(rest[0]), pa.array(rest[1])], ["key", "node"])


def _edges(pairs):
    a, b = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])


def _bucket_links(batches):
    """Ties of the buckets of a task, rows (key, node, n, sample) sorted by key: a spanning forest of the pairs that may be alike."""
    found, size = [], 0
    for run in _runs(batches, 1):
        node, n = (run.column(c).to_numpy() for c in ("node", "n"))
        if len(node) < 2:
            continue
        if len(node) > CROWD:
            found.append((node[1:], np.full(len(node) - 1, node[0])))
        else:
            slots = np.frombuffer(b"".join(run.column("sample").to_pylist()), np.uint8).reshape(len(node), SAMPLE)
            left = np.arange(len(node))
            while len(left) > 1:
                queue, left = [left[0]], left[1:]
                while queue and len(left):
                    x = queue.pop()
                    small, large = np.minimum(n[left], n[x]), np.maximum(n[left], n[x])
                    near = (SIMILARITY[1] * small >= SIMILARITY[0] * large) & ((slots[left] == slots[x]).sum(1) >= MATCHES)
                    if near.any():
                        hit = left[near]
                        found.append((node[hit], np.full(len(hit), node[x])))
                        queue.extend(hit.tolist())
                        left = left[~near]
        size += len(node)
        if found and size > 1 << 16:
            yield _edges(found)
            found, size = [], 0
    if found:
        yield _edges(found)


def linked(nodes: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None = None):
    """Pairs of nodes that span the groups of sets at SIMILARITY or more; with ``side``, only pairs of two sides count.

    A walk takes all unvisited neighbours of a set and compares with what is left only, so a dense group costs about one pass.
    """
    code, at = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets], np.int64)
    starts = np.concatenate(([0], np.cumsum(size)))
    flag = np.zeros(len(code), np.int32)
    left = np.arange(len(sets))
    flat, first = at, starts[:-1]  # the elements of the sets in ``left`` and where each begins
    while len(left) > 1:
        queue = [left[0]]
        left = left[1:]
        flat, first = flat[first[1]:], first[1:] - first[1]
        while queue and len(left):
            x = queue.pop()
            mine = at[starts[x]:starts[x + 1]]
            flag[mine] = 1
            common = np.add.reduceat(flag[flat], first)
            flag[mine] = 0
            near = SIMILARITY[1] * common >= SIMILARITY[0] * (size[left] + size[x] - common)
            if side is not None:
                near &= side[left] != side[x]
            if near.any():
                hit = left[near]
                yield nodes[hit], np.full(len(hit), nodes[x])
                queue.extend(hit.tolist())
                flat = flat[np.repeat(~near, size[left])]
                left = left[~near]
                first = np.concatenate(([0], np.cumsum(size[left])[:-1])) if len(left) else left


def _tile_links(batches):
    """Confirmed links of the tiles of a task; rows (cluster, i, j, side, node, set) come sorted by cluster, i and j."""
    for run in _runs(batches, 3):
        node, side, held = run.column("node").to_numpy(), run.column("side").to_numpy(), run.column("set").to_pylist()
        if len(node) > 1:
            found = list(linked(node, [np.frombuffer(x, np.uint64) for x in held], side if run["i"][0] != run["j"][0] else None))
            if found:
                yield _edges(found)


def _sets(batches):
    """(cluster, g, m, node, n, set) from (cluster, g, m, node, n, text)."""
    for batch in slices(batches):
        held = pa.array([shingles(t.encode()).tobytes() for t in batch.column(5).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), held], ["cluster", "g", "m", "node", "n", "set"])


def _met(rows: DataFrame) -> DataFrame:
    return rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").select("cluster", "i", "j", "side", "node", "set").mapInArrow(
        _tile_links, "a long, b long")


def confirmed(sets: DataFrame) -> DataFrame:
    """Links (a, b) that span the groups of the clusters in ``sets`` (cluster, g tiles, m nodes, node, n, set), exactly.

    Tiles hold their own texts and the cluster's pivots. Where a cluster has more than one tile, the texts that its largest group
    does not hold by then meet all its other texts, tile by tile; texts of the largest group need not meet each other again.
    """
    own = F.pmod(F.xxhash64("node"), F.col("g")).cast("int")
    pivot = (F.col("g") > 1) & (F.pmod(F.xxhash64("node", F.lit("pivot")), F.col("m")) < PIVOTS)
    tile = F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("g").cast("int") - 1)).otherwise(F.array(own)))
    links = cut(_met(sets.withColumn("i", tile).withColumn("j", F.col("i")).withColumn("side", F.lit(0))))
    split = sets.filter("g > 1")
    if split.isEmpty():
        return links
    parts = split.select("cluster", "node", "n").distinct().join(
        components(links), "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")
    parts = cut(parts)
    groups = parts.groupBy("cluster", "group").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
    tiles = lambda c, w: F.greatest(F.ceil(c / TILE), F.ceil(w / TILE_SHINGLES)).cast("int")
    plan = groups.groupBy("cluster").agg(F.max_by("group", F.struct("c", "group")).alias("main"), F.max(F.struct("c", "group", "w")).alias("top"),
                                         F.sum("c").alias("c"), F.sum("w").alias("w"))
    plan = plan.select("cluster", "main", tiles(F.col("top.c"), F.col("top.w")).alias("gm"),
                       tiles(F.col("c") - F.col("top.c"), F.col("w") - F.col("top.w")).alias("gr")).filter("gr > 0")
    inside = parts.join(broadcast_if_small(cut(plan)), "cluster").select(
        "node", "gm", "gr", (F.col("group") == F.col("main")).alias("home"))
    last = F.col("gm") + F.col("gr") - 1
    number = F.when(F.col("home"), F.pmod(F.xxhash64("node"), F.col("gm"))).otherwise(F.col("gm") + F.pmod(F.xxhash64("node"), F.col("gr"))).cast("int")
    others = F.explode(F.when(F.col("home"), F.sequence("gm", last)).otherwise(F.sequence(F.lit(0), last)))
    dealt = split.drop("g", "m").join(inside, "node").withColumn("side", number).withColumn("other", others).select(
        "cluster", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node", "set")
    return links.unionByName(_met(dealt))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): groups of texts whose distinct two-word shingles are alike to 0.8 or more.

    component_id is the smallest doc_id reached over any number of links, kept is doc_id = component_id. Every row is returned,
    repeated rows too. Texts without words (null, empty, white space) have no shingles and are their own group. Rows without
    doc_id take part; they get their group's smallest id (null if no row of the group has one) and are not kept. Other columns
    are ignored.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    sketch = cut(rows.mapInArrow(_sketches, "doc_id long, mark long, n long, node long, keys array<long>, sample binary"))
    nodes = cut(sketch.filter("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "mark")).alias("one"), F.first("n").alias("n"), F.first("keys").alias("keys"),
        F.first("sample").alias("sample")))
    keys = nodes.select(F.explode("keys").alias("key"), "node").repartition("key").sortWithinPartitions("key")
    met = cut(keys.mapInArrow(_drop_single, "key long, node long"))
    buckets = met.join(nodes.select("node", "n", "sample"), "node").repartition("key").sortWithinPartitions("key").select("key", "node", "n", "sample")
    clusters = cut(components(buckets.mapInArrow(_bucket_links, "a long, b long")).join(nodes.select("node", "n", "one"), "node").select(
        F.col("component").alias("cluster"), "node", "n", "one"))
    size = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), F.greatest(
        F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("n") / TILE_SHINGLES)).alias("g"))
    chosen = cut(clusters.join(size, "cluster").select("cluster", "g", "m", "node", "n", F.col("one.doc_id").alias("_id"), F.col("one.mark").alias("_mark")))
    found = rows.join(broadcast_if_small(chosen), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark").eqNullSafe(F.col("_mark"))))
    found = found.select("cluster", "g", "m", "node", "n", "text").dropDuplicates(["node"])
    sets = cut(found.mapInArrow(_sets, "cluster long, g long, m long, node long, n long, set binary"))
    groups = components(confirmed(sets))
    named = nodes.select("node", "least").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = named.select("node", "component").join(lowest, "component").select("node", "component_id")
    out = sketch.select("doc_id", F.col("n").alias("n_shingles"), "node").join(labels, "node", "left")
    reached = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", reached.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
