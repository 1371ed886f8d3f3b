"""Hard-negative mining by segment summaries.

A vector is cut into 1, 4 and 16 segments; each segment stores its mean and its deviation (scaled by the root of its length, so
that the product of two means is the inner product of the flattened segments, and the product of two deviations bounds the rest
from both sides). Means' product plus or minus deviation products, summed over the segments, bound a score from above and below.
Pairs of an anchor and a row fall away as soon as a level shows that the row can be no wanted positive or negative; finer levels
and exact scores are computed for what is left only.

Anchors go in chunks of bounded size past the rows, which stay where they are: nothing but each task's best rows is shuffled.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir, cut
from .topk import EXACT, INT64

LEVELS = (1, 4, 16)
SCALE = 256.0
POSITIVES, NEGATIVES = 5, 10
#: Score window of a negative in hundredths of the positive's score.
LOW, HIGH = 30, 90
#: Anchors of a chunk, and numbers of a chunk's vectors or of a block of scores.
CHUNK, NUMBERS = 8192, 1 << 22
#: Rows that are scored first, to raise the floors below which pairs fall away; all rows are scored afterwards.
SAMPLE = 16384


def segments(dim: int) -> list[np.ndarray]:
    """The component positions of each segment, level after level."""
    return [part for level in LEVELS for part in np.array_split(np.arange(dim), min(level, dim))]


def level_ends(dim: int) -> list[int]:
    return np.cumsum([min(level, dim) for level in LEVELS]).tolist()


def summary(x: np.ndarray) -> np.ndarray:
    """Scaled means, then deviations, of all segments of each row."""
    means, deviations = [], []
    for part in segments(x.shape[1]):
        mean = x[:, part].mean(axis=1)
        means.append(mean * np.sqrt(len(part)))
        deviations.append(np.sqrt(((x[:, part] - mean[:, None]) ** 2).sum(axis=1)))
    return np.stack(means + deviations, axis=1)


def bounds(a: np.ndarray, b: np.ndarray, dim: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row of ``a`` with each row of ``b``, by their summaries at one level."""
    ends = level_ends(dim)
    at, n = slice(ends[level - 1] if level else 0, ends[level]), ends[-1]
    middle = a[:, :n][:, at] @ b[:, :n][:, at].T
    spread = a[:, n:][:, at] @ b[:, n:][:, at].T
    return middle - spread, middle + spread


def scores(q: np.ndarray, qs: np.ndarray, v: np.ndarray, vs: np.ndarray, open_: np.ndarray, low: np.ndarray, high: np.ndarray, done: list):
    """(i, j, score) of the open pairs whose score can lie in low[i] .. high[i]; ``done`` counts pairs per level and exact ones."""
    dim = q.shape[1]
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * dim
    i, j = np.arange(len(q)), np.arange(len(v))
    if largest < EXACT:
        slack = 1e-9 * (largest + 1)
        for level in range(len(LEVELS)):
            done[level] += int(open_.sum())
            least, greatest = bounds(qs[i], vs[j], dim, level)
            open_ = open_ & (greatest + slack >= low[i, None]) & (least - slack <= high[i, None])
            rows, columns = open_.any(1), open_.any(0)
            i, j, open_ = i[rows], j[columns], open_[rows][:, columns]
            if not len(i):
                return i, i, np.zeros(0, np.int64)
    a, b = np.nonzero(open_)
    done[-1] += len(a)
    if largest >= EXACT:  # beyond the integers of a double: Python's own, clipped to a long
        whole = lambda m: np.array([int(x) for x in m.ravel()], object).reshape(m.shape)
        found = (whole(q[i[a]]) * whole(v[j[b]])).sum(1) if len(a) else np.zeros(0, object)
        return i[a], j[b], np.array([min(max(x, INT64[0]), INT64[1]) for x in found], np.int64)
    if 4 * len(a) > open_.size:
        return i[a], j[b], (q[i] @ v[j].T)[a, b].astype(np.int64)
    found = [np.einsum("nd,nd->n", q[i[a[s:s + 65536]]], v[j[b[s:s + 65536]]]) for s in range(0, len(a), 65536)]
    return i[a], j[b], np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)


class Best:
    """The k best (score, smaller id first) of each key, and the k-th best score as the key's floor."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor = k, floor
        self.key = self.score = self.id = np.zeros(0, np.int64)

    def add(self, key, score, id_):
        wanted = score >= self.floor[key]
        if not wanted.any():
            return
        key, score, id_ = (np.concatenate((old, new[wanted])) for old, new in ((self.key, key), (self.score, score), (self.id, id_)))
        order = np.lexsort((id_, ~score, key))  # ~ turns the order of integers round without overflow
        key, score, id_ = key[order], score[order], id_[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        rank = np.arange(len(key)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(key)]))))
        last = rank == self.k - 1
        self.floor[key[last]] = np.maximum(self.floor[key[last]], score[last])
        keep = rank < self.k
        self.key, self.score, self.id = key[keep], score[keep], id_[keep]


def usable(rows: DataFrame, label) -> DataFrame:
    """(vec_id, label, dim, vec, summary): integer vectors with their segment summaries; rows with any null or non-finite part are left out."""
    good = F.col("vec_id").isNotNull() & F.col("_label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    picked = rows.select("vec_id", label.cast("long").alias("_label"), "embedding").filter(F.coalesce(good, F.lit(False)))
    vec = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("double"))

    def summarise(batches):
        for batch in batches:
            parts = np.full(batch.num_rows, None, object)
            for at, x in by_length(batch):
                parts[at] = list(summary(x))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts.tolist(), pa.list_(pa.float64()))], ["vec_id", "label", "vec", "summary"])

    flat = picked.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("_label").alias("label"), vec.alias("vec"))
    return flat.mapInArrow(summarise, "vec_id long, label long, vec array<double>, summary array<double>")


def matrix(column, at: np.ndarray) -> np.ndarray:
    return column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)


def by_length(batch):
    """(rows, vectors) of a batch, for each vector length in it."""
    lengths = batch.column("vec").value_lengths().to_numpy()
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        yield at, matrix(batch.column("vec"), at)


def blocks(batches, anchors: dict):
    """(anchors, ids, labels, vectors, summaries) of the rows of a task, in blocks that bound the scores held at a time."""
    for batch in batches:
        ids, labels = (batch.column(c).to_numpy() for c in ("vec_id", "label"))
        for rows, x in by_length(batch):
            own = anchors.get(x.shape[1])
            if own is None:
                continue
            s, step = matrix(batch.column("summary"), rows), max(1, NUMBERS // len(own["id"]))
            for at in range(0, len(rows), step):
                part = slice(at, at + step)
                yield own, ids[rows[part]], labels[rows[part]], x[part], s[part]


def _mapped(rows: DataFrame, anchors, k: int, pairs, floor: np.ndarray) -> DataFrame:
    """(key, score, id): each task's best rows of every key that reach its floor; keys are numbered through the chunk."""
    def run(batches):
        best, done = Best(floor.copy(), k), [0] * (len(LEVELS) + 1)
        for own, ids, labels, x, s in blocks(batches, anchors.value):
            pairs(best, own, ids, labels, x, s, done)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (best.key, best.score, best.id)], ["key", "score", "id"])

    return rows.mapInArrow(run, "key long, score long, id long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("key").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def positive_pairs(best: Best, own, ids, labels, x, s, done: list) -> None:
    """Offer the rows of an anchor's own label."""
    open_ = (own["label"][:, None] == labels[None, :]) & (own["id"][:, None] != ids[None, :])
    if open_.any():
        floor = best.floor[own["key"]].astype(np.float64)
        i, j, score = scores(own["vec"], own["summary"], x, s, open_, floor, np.full(len(floor), np.inf), done)
        best.add(own["key"][i], score, ids[j])


def negative_pairs(best: Best, own, ids, labels, x, s, done: list) -> None:
    """Offer the rows of other labels to each positive of an anchor whose window holds their score."""
    open_ = (own["label"][:, None] != labels[None, :]) & (own["id"][:, None] != ids[None, :])
    keys = own["key"][:, None] * POSITIVES + np.arange(POSITIVES)
    floor, high = np.maximum(best.floor[keys], own["low"]), own["high"]  # a slot without positive has an empty window
    live = floor <= high
    low = np.where(live, floor, INT64[1]).min(1).astype(np.float64)
    top = np.where(live, high, INT64[0]).max(1).astype(np.float64)
    i, j, score = scores(own["vec"], own["summary"], x, s, open_ & live.any(1)[:, None], low, top, done)
    for p in range(POSITIVES):
        inside = (score >= floor[i, p]) & (score <= high[i, p])
        best.add(keys[i[inside], p], score[inside], ids[j[inside]])


def _chunk(spark, anchors: DataFrame, number: int) -> dict:
    """The anchors of one chunk on the driver, by vector length: ids, labels, vectors, summaries and their numbers within the chunk."""
    table = anchors.filter(F.col("chunk") == number).drop("chunk").toArrow().combine_chunks()
    held, n = {}, 0
    for batch in table.to_batches():
        for rows, x in by_length(batch):
            held[x.shape[1]] = {"id": batch.column("vec_id").to_numpy()[rows], "label": batch.column("label").to_numpy()[rows], "vec": x,
                                "summary": matrix(batch.column("summary"), rows), "key": np.arange(n, n + len(rows))}
            n += len(rows)
    return held


def _windows(held: dict, positives) -> None:
    """Attach each anchor's positives and the score windows of their negatives; slots beyond the last positive get an empty window."""
    n = sum(len(own["id"]) for own in held.values())
    who, score = np.full((n, POSITIVES), -1, np.int64), np.zeros((n, POSITIVES), np.int64)
    low, high = np.full((n, POSITIVES), 1, np.int64), np.zeros((n, POSITIVES), np.int64)
    for r in positives:
        at = r["key"], r["rank"] - 1
        who[at], score[at] = r["id"], r["score"]
        low[at], high[at] = -(-LOW * r["score"] // 100), HIGH * r["score"] // 100
    for own in held.values():
        own |= {"positive": who[own["key"]], "positive_score": score[own["key"]], "low": low[own["key"]], "high": high[own["key"]]}


def mine(rows: DataFrame, is_anchor) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors among ``rows`` (see ``usable``).

    ``is_anchor`` is a condition on vec_id. Positives are the anchor's POSITIVES best other rows of its label; negatives, for each of
    them, the NEGATIVES best rows of other labels whose score lies within LOW to HIGH hundredths of the positive's score. Ties go to
    the smaller id; with fewer rows all are returned, and an empty window gives none. Rows that share the anchor's vec_id are its own
    and no candidates; a repeated anchor is answered once, from its smallest vector, while repeated candidates each take a rank.
    Vectors meet those of their own length only.
    """
    spark, rows = rows.sparkSession, cut(rows)
    anchors = rows.filter(is_anchor).groupBy("vec_id").agg(F.min(F.struct(F.size("vec").alias("dim"), "vec", "label", "summary")).alias("a"))
    n, n_anchors, numbers = rows.count(), *rows.filter(is_anchor).select(F.countDistinct("vec_id"), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    n_chunks = max(1, -(-n_anchors // min(CHUNK, max(1, NUMBERS // numbers))))
    anchors = cut(anchors.select("vec_id", "a.label", "a.vec", "a.summary", F.pmod(F.xxhash64("vec_id"), F.lit(n_chunks)).alias("chunk")))
    some = rows.filter(F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(max(1, n // SAMPLE))) == 0)
    path = f"{checkpoint_dir(spark).rstrip('/')}/negatives-{uuid.uuid4().hex}"
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    for number in range(n_chunks):
        held = _chunk(spark, anchors, number)
        size = sum(len(own["id"]) for own in held.values())
        if not size:
            continue
        shared, lowest = spark.sparkContext.broadcast(held), np.full(size, INT64[0])
        positives = _ranked(_mapped(rows, shared, POSITIVES, positive_pairs, lowest), POSITIVES).collect()  # of one chunk
        _windows(held, positives)
        shared, floor = spark.sparkContext.broadcast(held), np.full(size * POSITIVES, INT64[0])
        if n > SAMPLE:
            first = _ranked(_mapped(some, shared, NEGATIVES, negative_pairs, floor), NEGATIVES)
            for r in first.filter(F.col("rank") == NEGATIVES).collect():
                floor[r["key"]] = r["score"]
        found = _ranked(_mapped(rows, shared, NEGATIVES, negative_pairs, floor), NEGATIVES)

        def named(batches, shared=shared, size=size):
            flat = {c: np.zeros((size, POSITIVES), np.int64) for c in ("id", "positive", "positive_score")}
            for own in shared.value.values():
                flat["id"][own["key"]] = own["id"][:, None]
                flat["positive"][own["key"]], flat["positive_score"][own["key"]] = own["positive"], own["positive_score"]
            flat = {c: pa.array(x.ravel()) for c, x in flat.items()}
            for batch in batches:
                key = batch.column("key")
                yield pa.RecordBatch.from_arrays([flat["id"].take(key), flat["positive"].take(key), batch.column("rank"), batch.column("id"),
                                                  flat["positive_score"].take(key), batch.column("score")],
                                                 ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

        found.select("key", "rank", "id", "score").mapInArrow(named, schema).write.mode("append").parquet(path)
    if not n_anchors:
        spark.createDataFrame([], schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)
