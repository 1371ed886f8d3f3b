"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by pigeonring filtering, joined into components.

Pigeonring: cut a fingerprint into ``SEGMENTS`` segments on a ring. If two fingerprints differ in at most ``RADIUS`` bits, some
segment starts a chain in which the first ``l`` segments differ in at most ``l * RADIUS / SEGMENTS`` bits, for every ``l``.
With 4 segments and 3 bits the budgets are 0, 1, 2, 3: one segment is equal and its successor differs in at most one bit.
These two segments are the join key, the third is checked on candidates, and the full Hamming distance on survivors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import cut_at_space, sliced, slices
from .components import components

SEGMENTS = 4
WIDTH = 64 // SEGMENTS
RADIUS = 3
SHINGLE = 3
SEED = 42
#: Buckets up to this size compare their members pairwise by shifted arrays; larger ones walk from member to member.
SMALL = 48


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits += np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return bits


def majority(bits: np.ndarray, total: int) -> int:
    """The fingerprint of ``total`` hashes: the bits that over half of them have."""
    return int(np.packbits(2 * bits > total, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Fingerprint of one whole text; 0 without words."""
    bits, total, tail = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for piece in cut_at_space(text.lower()):
        words = tail + piece.split()
        tail = words[max(0, len(words) - shingle + 1):]
        if len(words) < shingle:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())],
                          np.uint64)
        total += len(hashes)
        bits += bit_counts(hashes)
    if not total:
        return digest(b" ".join(tail), SEED) if tail else 0
    return majority(bits, total)


def _marks(texts):
    return pa.array(np.array([fingerprint(t.encode()) if t is not None else 0 for t in texts], np.uint64).view(np.int64))


def _fingerprints(batches):
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _marks(batch.column(2).to_pylist())], ["doc_id", "mark", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, fp) of every row; mark is a hash of the text; a null or wordless text has fingerprint 0."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("mark"), text.alias("text")).mapInArrow(
        _fingerprints, "doc_id long, mark long, fp long")


def _keys(batches):
    """Bucket rows of each fingerprint: per start segment its own key, and the keys with one more bit in the next segment.

    Of two fingerprints one bit apart in that segment only the one without the bit probes, so a pair meets once per start.
    """
    low = np.uint64((1 << WIDTH) - 1)
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        for start in range(SEGMENTS):
            ring = (fp >> np.uint64(WIDTH * start)) | (fp << np.uint64(64 - WIDTH * start)) if start else fp
            own = (ring & low) << np.uint64(WIDTH) | (ring >> np.uint64(WIDTH)) & low | np.uint64(start << 2 * WIDTH)
            key, who, probe = [own], [fp], [np.zeros(len(fp), bool)]
            for bit in range(WIDTH):
                at = (own >> np.uint64(bit)) & np.uint64(1) == 0
                key.append(own[at] | np.uint64(1 << bit))
                who.append(fp[at])
                probe.append(np.ones(at.sum(), bool))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key).view(np.int64)), pa.array(np.concatenate(who).view(np.int64)),
                                              pa.array(np.concatenate(probe))], ["key", "fp", "probe"])


def chain_holds(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Do the cumulative differences from segment ``start`` stay within budget along the ring?"""
    x = a ^ b
    turn = (start * WIDTH).astype(np.uint64)
    ring = (x >> turn) | np.where(turn > 0, x << ((np.uint64(64) - turn) & np.uint64(63)), np.uint64(0))
    ok = np.ones(len(x), bool)
    for length in range(1, SEGMENTS):
        part = ring & np.uint64((1 << WIDTH * length) - 1)
        ok &= np.bitwise_count(part) <= length * RADIUS // SEGMENTS
    return ok


def _links_of_small(key, fp, probe, size):
    """Pairs of equal key at every distance in sorted order; ``size`` is the largest bucket among the rows."""
    for step in range(1, size):
        at = np.flatnonzero((key[step:] == key[:-step]) & ~(probe[step:] & probe[:-step]))
        if not len(at):
            continue
        a, b = fp[at], fp[at + step]
        good = chain_holds(a, b, key[at] >> np.uint64(2 * WIDTH))
        a, b = a[good], b[good]
        near = np.bitwise_count(a ^ b) <= RADIUS
        yield a[near], b[near]


def _links_of_large(fp, probe):
    """A spanning forest of one large bucket: a walk that takes unvisited neighbours, so dense groups cost one look each."""
    left = np.arange(len(fp))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[at]) <= RADIUS
            if probe[at]:
                near &= ~probe[left]
            if near.any():
                found = left[near]
                yield np.full(len(found), fp[at]), fp[found]
                queue.extend(found.tolist())
                left = left[~near]


def _links(batches):
    """Links of a task's buckets; rows come sorted by key. Holds one bucket (24 bytes a member) and one batch."""
    rest = None

    def columns(batch):
        return batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)

    def links(key, fp, probe):
        if len(key) < 2:
            return
        starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
        sizes = np.diff(np.concatenate((starts, [len(key)])))
        each = np.repeat(sizes, sizes)
        some = (each > 1) & (each <= SMALL)
        found = list(_links_of_small(key[some], fp[some], probe[some], int(each[some].max()))) if some.any() else []
        for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
            found += list(_links_of_large(fp[s:s + n], probe[s:s + n]))
        if found:
            a, b = (np.concatenate([f[i] for f in found]).view(np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    for batch in batches:
        new = columns(batch)
        if not len(new[0]):
            continue
        if rest is None:
            rest = [new]
        elif new[0][-1] == rest[0][0][0]:
            rest.append(new)  # one bucket over several batches: joined once, at its end
        else:
            whole = [np.concatenate(x) for x in zip(*rest, new)]
            last = np.flatnonzero(whole[0] == whole[0][-1])[0]
            yield from links(*(x[:last] for x in whole))
            rest = [tuple(x[last:] for x in whole)]
    if rest:
        yield from links(*(np.concatenate(x) for x in zip(*rest)))


def link_edges(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that join all that are within RADIUS bits into one component.

    Within a large bucket a spanning forest of its links stands for all of them: no group is written out as pairs.
    """
    keys = distinct.select("fp").mapInArrow(_keys, "key long, fp long, probe boolean")
    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that each row reaches over links of at most RADIUS bits.

    Every row is returned, repeated rows too; rows without doc_id take part and get their group's smallest id (null if no row
    of the group has one). Null, empty and wordless texts share fingerprint 0. Other columns are ignored.
    """
    return _grouped(docs).select("doc_id", "fp", "component_id")


def _grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, fp, component, component_id); component is a fingerprint of the group, the same for all its rows."""
    marks = cut(fingerprints(docs))
    distinct = marks.groupBy("fp").agg(F.min("doc_id").alias("least"))
    groups = components(link_edges(distinct))
    named = distinct.join(groups, distinct.fp == groups.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = named.select("fp", "component").join(least, "component").select("fp", "component", "component_id")
    return marks.join(labels, "fp").select("doc_id", "mark", "fp", "component", "component_id")


def one_per_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without their near-duplicates: of each group one row stays (see ``one_of_each``)."""
    return one_of_each(docs, _grouped(docs))


def one_of_each(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """One row of ``docs`` per component of ``grouped`` (doc_id, mark, component): that with the smallest doc_id.

    Rows without doc_id come after those with one, ties go by a hash of the text, and of wholly equal choices one row stays.
    Rows that share a doc_id but belong to different groups are kept apart. All columns are kept.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "mark")
    keep = grouped.groupBy("component").agg(F.min(rank).alias("one")).select(F.col("one.doc_id").alias("_keep"), F.col("one.mark").alias("_mark"))
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_text"))
    named = rows.join(keep, F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_text") == F.col("_mark")))
    first = F.row_number().over(Window.partitionBy("_id", "_text").orderBy(F.lit(1)))
    return named.withColumn("_turn", first).filter("_turn = 1").select("_row.*")
