"""Removal of long exact repeats by interleave refinement of the suffixes of anchored regions.

A string of ``LENGTH`` bytes is removed wherever it starts more than once in the corpus. Two steps:

1. *Anchors.* In every LENGTH-byte window the ``GRAM``-byte string with the smallest hash (leftmost on ties) is its anchor. Equal
   windows have equal anchors at equal offsets, so windows whose anchor occurs once are unique, and all others meet by anchor.
   An anchor's *region* is the text of all its windows; a region that occurs again as a whole is repeated as a whole.
2. *Merging.* Within an anchor bucket each distinct region is a shard; symbols are blocks of ``STEP`` bytes, so a suffix's predecessor
   starts STEP bytes earlier. The interleave of all shards starts sorted by one block. Each round sorts the predecessors of the
   suffixes that remain by (preceding symbol, class), which makes the order reach one block further; symbols stand in by 64-bit
   hashes, transforms are not stored, and no two suffixes are compared beyond that. A class of the interleave after round r shares r blocks (its common prefix),
   a suffix alone in its class is settled and leaves with all its predecessors, and what is left after LENGTH / STEP rounds are the
   repeated windows, whose runs are the repeated intervals.

The interleave holds suffix numbers rather than shard numbers, so a shard needs no order of its own. Regions and windows that occur
again are told by counts of 64-bit hashes, which are not checked on the bytes.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir, cut
from .common import partitions, slices

LENGTH, STEP, GRAM = 200, 25, 32
WINDOW = LENGTH - GRAM + 1
#: Distinct regions of an anchor beyond this number meet window by window instead: counted, never gathered.
CROWD = 8_000
BUCKET_BYTES = 3 << 19
_PIECE = 1 << 19
_INDEX = np.uint64((1 << 24) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def string_hashes(raw: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """Hashes of the strings of each length from every position, by doubling; lengths beyond the text give empty arrays."""
    out = [None] * len(lengths)
    at, h, size = [0] * len(lengths), _BYTE[raw], 1
    while True:
        for i, length in enumerate(lengths):
            if length & size:
                part = h[at[i]:at[i] + max(0, len(raw) - length + 1)]
                out[i] = part.copy() if out[i] is None else _mix(out[i] * np.uint64(0x9E3779B97F4A7C15) + part)
                at[i] += size
        if size * 2 > max(lengths) or len(h) <= size:
            return [_mix(x) if x is not None else np.zeros(0, np.uint64) for x in out]
        h = h[:-size] * np.uint64(0xD1342543DE82EF95 + 2 * size) + (h[size:] ^ (h[size:] >> np.uint64(29)))
        size *= 2


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:len(x) - (width - size)], x[width - size:]) if width > size else x


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, region, place) of each anchor; region names the region's text (its first and last window cover it), place packs the
    first window start and the distance of the last one."""
    found = []
    for at in range(0, len(text) - LENGTH + 1, _PIECE):
        raw = np.frombuffer(text[at:at + _PIECE + LENGTH - 1], np.uint8)
        gram, window = string_hashes(raw, GRAM, LENGTH)
        chosen = (_sliding_min((gram & ~_INDEX) | np.arange(len(gram), dtype=np.uint64), WINDOW) & _INDEX).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(chosen[1:] != chosen[:-1]) + 1))
        last = np.concatenate((first[1:], [len(chosen)])) - 1
        more = last - first
        region = _mix(window[first] * np.uint64(0x9E3779B97F4A7C15) + window[last] + more.astype(np.uint64))
        found.append((gram[chosen[first]].view(np.int64), region.view(np.int64), (first + at) << 8 | more))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def _all_anchors(batches):
    """(cls, region, h, n, places, copies) of (h, n, copies, text): one row per distinct region of a text, with all its places."""
    for batch in slices(batches):
        rows: list[list] = [[] for _ in range(6)]
        for h, n, copies, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            cls, region, place = anchors(text.encode())
            order = np.argsort(region, kind="stable")
            region, place = region[order], place[order]
            start = np.concatenate(([0], np.flatnonzero(region[1:] != region[:-1]) + 1)) if len(region) else np.zeros(0, np.int64)
            times = np.diff(np.concatenate((start, [len(region)])))
            for column, values in zip(rows, (cls[order][start], region[start], np.full(len(start), h), np.full(len(start), n), times, times * copies)):
                column.append(values)
            rows[4][-1] = (times, place)
        if not rows[0]:
            continue
        cls, region, h, n = (pa.array(np.concatenate(x)) for x in rows[:4])
        offsets = np.concatenate(([0], np.cumsum(np.concatenate([t for t, _ in rows[4]])))).astype(np.int32)
        places = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([p for _, p in rows[4]])))
        yield pa.RecordBatch.from_arrays([cls, region, h, n, places, pa.array(np.concatenate(rows[5]))], ["cls", "region", "h", "n", "places", "copies"])


def _regions(batches):
    """(cls, h, n, start, copies, region) of every chosen region; many small batches, as regions repeat much of the text."""
    for batch in slices(batches):
        out, size = [], 0
        for h, n, text, chosen in zip(*(batch.column(i).to_pylist() for i in range(4))):
            raw = text.encode()
            for r in chosen:
                start, more = r["place"] >> 8, r["place"] & 255
                out.append((r["cls"], h, n, start, r["copies"], raw[start:start + more + LENGTH]))
                size += more + LENGTH
                if size > 4 << 20:
                    yield _region_batch(out)
                    out, size = [], 0
        if out:
            yield _region_batch(out)


_REGION = [("cls", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("start", pa.int64()), ("copies", pa.int64()), ("region", pa.binary())]


def _region_batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_REGION)], [c for c, _ in _REGION])


def repeated_starts(regions: list[bytes]) -> np.ndarray:
    """Which positions of the joined regions start LENGTH bytes (inside their region) that start elsewhere in them too."""
    sizes = np.array([len(r) for r in regions], np.int64)
    ends = np.cumsum(sizes)
    raw = np.frombuffer(b"".join(regions), np.uint8)
    begin = np.repeat((ends - sizes).astype(np.int32), sizes)
    room = np.repeat(ends.astype(np.int32), sizes) - np.arange(len(raw), dtype=np.int32)
    hit = np.zeros(len(raw), bool)
    if len(raw) < STEP:
        return hit
    symbol = np.unique(string_hashes(raw, STEP)[0], return_inverse=True)[1].astype(np.uint64)
    at = np.flatnonzero(room >= STEP)
    del room
    order = at[np.argsort(symbol[at], kind="stable")]  # the first interleave: sorted by one block
    key = symbol[order]
    for _ in range(LENGTH // STEP - 1):
        head = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
        shared = ~(head & np.concatenate((head[1:], [True]))) if len(key) else head
        label = np.cumsum(head)[shared].astype(np.uint64)
        before = order[shared] - STEP
        inside = before >= begin[order[shared]]
        before, label = before[inside], label[inside]
        if not len(before):
            return hit
        key = symbol[before] << np.uint64(32) | label
        deal = np.argsort(key)
        order, key = before[deal], key[deal]
    head = np.concatenate(([True], key[1:] != key[:-1]))
    hit[order[~(head & np.concatenate((head[1:], [True])))]] = True
    return hit


def _merged_buckets(batches):
    """(h, n, begin, end) of the repeated intervals; rows come sorted by class, and a bucket holds whole classes."""
    rows, size, last = [], 0, None
    for batch in slices(batches):
        for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if size > BUCKET_BYTES and row[0] != last:
                yield _intervals(rows)
                rows, size = [], 0
            last = row[0]
            rows.append(row)
            size += len(row[5])
    if rows:
        yield _intervals(rows)


def _intervals(rows):
    """Repeated intervals of the regions that occur once; those that occur again are known to be repeated as a whole."""
    hit = repeated_starts([r[5] for r in rows])
    out, at = [], 0
    for _, h, n, start, copies, region in rows:
        if copies == 1:
            windows = hit[at:at + len(region) - LENGTH + 1]
            edge = np.flatnonzero(np.diff(np.concatenate(([0], windows.view(np.int8), [0])))).tolist()
            out += [(h, n, start + a, start + b - 1 + LENGTH) for a, b in zip(edge[::2], edge[1::2])]
        at += len(region)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], ["h", "n", "begin", "end"])


def _windows(batches):
    """(m1, m2, h, n, begin, copies) of every single window of crowded anchors, named by two hashes."""
    for batch in slices(batches):
        for _, h, n, start, copies, region in zip(*(batch.column(i).to_pylist() for i in range(6))):
            raw = np.frombuffer(region, np.uint8)
            one, two = (string_hashes(x, LENGTH)[0].view(np.int64) for x in (raw, raw ^ np.uint8(0x5A)))
            k = len(one)
            yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(np.full(k, h)), pa.array(np.full(k, n)),
                                              pa.array(start + np.arange(k)), pa.array(np.full(k, copies))], ["m1", "m2", "h", "n", "begin", "copies"])


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(h, n, copies, text) of every distinct text of LENGTH bytes or more, named by XXH64 and byte length.

    Copies collapse here, before anything is taken apart. The table is written once, bucketed by name, so that later joins by name
    move the other side only; its entry in the catalogue is dropped again, the files stay in the shared checkpoint folder.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    long_ = docs.select(text.alias("text")).filter(F.octet_length("text") >= LENGTH)
    named = long_.groupBy(F.xxhash64("text").alias("h"), F.octet_length("text").cast("long").alias("n")).agg(
        F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
    name = f"texts_{uuid.uuid4().hex}"
    named.write.bucketBy(partitions(spark), "h", "n").option("path", f"{checkpoint_dir(spark).rstrip('/')}/{name}").option("compression", "zstd").saveAsTable(name)
    table = spark.table(name)
    table.schema  # resolved before the name goes
    spark.sql(f"DROP TABLE {name}")
    return table


def intervals(texts: DataFrame) -> DataFrame:
    """(h, n, spans): the repeated intervals [begin, end) of each of ``distinct_texts``; spans may overlap.

    Equal regions are counted first, so only one region of each kind is merged with the others of its anchor.
    """
    found = cut(texts.mapInArrow(_all_anchors, "cls long, region long, h long, n long, places array<long>, copies long"))
    kinds = cut(found.groupBy("cls", "region").agg(F.sum("copies").alias("copies"), F.min(F.struct("h", "n", F.col("places")[0].alias("place"))).alias("one")))
    again = kinds.filter("copies > 1").select("cls", "region")
    whole = found.join(again, ["cls", "region"]).select("h", "n", F.explode("places").alias("place")).select(
        "h", "n", F.shiftright("place", 8).alias("begin"), (F.shiftright("place", 8) + F.col("place").bitwiseAND(255) + LENGTH).alias("end"))

    crowds = kinds.groupBy("cls").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    mixed = kinds.join(crowds, "cls").select("one.h", "one.n", (F.col("m") > CROWD).alias("crowded"), F.struct("cls", "one.place", "copies").alias("r"))
    lists = cut(mixed.groupBy("h", "n", "crowded").agg(F.collect_list("r").alias("chosen")))

    def of(flag: bool) -> DataFrame:
        near = texts.join(lists.filter(F.col("crowded") == flag), ["h", "n"]).select("h", "n", "text", "chosen")
        return near.mapInArrow(_regions, "cls long, h long, n long, start long, copies long, region binary")

    spans = whole.union(of(False).repartition("cls").sortWithinPartitions("cls").mapInArrow(_merged_buckets, "h long, n long, begin long, end long"))
    if lists.filter("crowded").limit(1).count():
        windows = of(True).mapInArrow(_windows, "m1 long, m2 long, h long, n long, begin long, copies long")
        repeated = windows.groupBy("m1", "m2").agg(F.sum("copies").alias("c")).filter("c > 1").select("m1", "m2")
        spans = spans.union(windows.join(repeated, ["m1", "m2"]).select("h", "n", "begin", (F.col("begin") + LENGTH).alias("end")))
    return spans.groupBy("h", "n").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))


_OUT = pa.struct([("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _without(text: pa.Array, spans: pa.Array) -> pa.Array:
    """What is left of each text outside its spans; null where there are none."""
    out, starts = [], spans.offsets.to_numpy()
    begins, ends = (spans.values.field(i).to_numpy() for i in (0, 1))
    for i in range(len(text)):
        if not spans[i].is_valid or starts[i] == starts[i + 1]:
            out.append(None)
            continue
        raw, at = text[i].as_py().encode(), slice(starts[i], starts[i + 1])
        order = np.argsort(begins[at], kind="stable")
        begin, reach = begins[at][order], np.maximum.accumulate(ends[at][order])
        first = np.concatenate(([0], np.flatnonzero(begin[1:] > reach[:-1]) + 1))
        runs = list(zip(begin[first].tolist(), reach[np.concatenate((first[1:], [len(begin)])) - 1].tolist()))
        edges = [0, *(x for run in runs for x in run), len(raw)]
        out.append({"n_removed": sum(b - a for a, b in runs), "n_spans": len(runs), "kept": b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))})
    return pa.array(out, _OUT)


def cleaned_texts(docs: DataFrame) -> DataFrame:
    """(h, n, n_removed, n_spans, kept) of every distinct text of LENGTH bytes or more; kept is binary, as cuts may split characters."""
    texts = distinct_texts(docs)
    cut_out = F.arrow_udf(_without, "struct<n_removed: long, n_spans: long, kept: binary>")
    rows = texts.join(intervals(texts), ["h", "n"], "left").withColumn("_out", cut_out(F.col("text"), F.col("spans")))
    none = F.lit(0).cast("long")
    return rows.select("h", "n", F.coalesce("_out.n_removed", none).alias("n_removed"), F.coalesce("_out.n_spans", none).alias("n_spans"),
                       F.coalesce("_out.kept", F.col("text").cast("binary")).alias("kept"))


def _named(docs: DataFrame, *columns) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(*columns, F.xxhash64(text).alias("h"), F.octet_length(text).cast("long").alias("n"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and kept (binary): every whole text without its repeated strings of LENGTH bytes.

    A byte goes if a LENGTH-byte string over it also starts anywhere else in the corpus, the same text included; strings are judged
    on the input. Null and empty texts have no bytes; repeated rows are copies of each other. Columns with these names are replaced.
    """
    rows = _named(docs, F.struct("*").alias("_row"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("_raw"))
    joined = rows.join(cleaned_texts(docs), ["h", "n"], "left")
    none = F.lit(0).cast("long")
    added = {"n_bytes": F.coalesce("n", none), "n_removed": F.coalesce("n_removed", none), "n_spans": F.coalesce("n_spans", none), "kept": F.coalesce("kept", "_raw")}
    return joined.select(*[F.col(f"_row.`{c}`") for c in docs.columns if c.lower() not in added], *[v.alias(k) for k, v in added.items()])


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): ``remove_repeats`` with a digest instead of the bytes, so that no text moves again."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = _named(docs, "doc_id", F.when(F.octet_length(raw) < LENGTH, F.sha2(raw, 256)).alias("_sha"))
    digests = cleaned_texts(docs).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
    none = F.lit(0).cast("long")
    return rows.join(digests, ["h", "n"], "left").select("doc_id", F.coalesce("n", none).alias("n_bytes"), F.coalesce("n_removed", none).alias("n_removed"),
                                                         F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "_sha").alias("kept_sha256"))
