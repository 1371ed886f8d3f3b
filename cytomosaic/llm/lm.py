"""Stupid-backoff language model over words, counted and scored relationally, every document by the counts of all others.

Words are runs of bytes other than ASCII white space, A-Z lower-cased. ``S(w | u v) = count(u v w) / count(u v)`` if other rows
hold ``u v w`` at all, else ``BACKOFF * S(w | v)``, down to ``count(w) / words``; a word that no other row holds counts as
BACKOFF. No count is too small to matter. A row's own n-grams are taken off the counts that score it: otherwise no n-gram of the
corpus would ever back off, and a text of words nobody else uses would score best.

Documents form blocks of bounded bytes. A block's n-grams are exploded and pre-aggregated; hash-partitioned by n-gram, they are
summed over all blocks. The sums go back to the blocks that hold the n-gram, where scores are summed per document.

n-grams are compared by 64-bit hashes of their words, which are not checked on the words. They travel as sorted runs, one row per
block and bucket: as one row each they would take about three times the space. A block knows its n-grams in order, so only counts
travel back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut
from .common import WORD, cut_at_space, partitions, slices

ORDER = 3
BACKOFF = 0.4
#: doc_ids per block (blocks follow doc_id because files usually do, so that a task meets few of them), and bytes of a block at most, about.
BLOCK_IDS, BLOCK_BYTES = 6144, 32 << 20
#: Bytes of text whose n-grams meet in one bucket, about.
BUCKET_BYTES = 16 << 20
#: n-grams that a task holds before it counts them and passes them on.
_HELD = 8_000_000
#: Ranges of hashes (by the first five bits) that a block's n-grams are ranked in, and ranges of a bucket's, to hold less at a time.
_PARTS = 32
#: Words of a block that are scored at a time, about.
_AT_ONCE = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((31, 0xD6E8FEB86659FD93), (29, 0xA0761D6478BD642F)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(32))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of every word: a polynomial of its bytes, mixed. Long texts are taken in pieces."""
    found = [np.zeros(0, np.uint64)]
    for piece in cut_at_space(text.encode().lower()) if text else ():
        raw = np.frombuffer(piece, np.uint8)
        inside = np.concatenate(([False], ~_SPACE[raw], [False]))
        starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
        if not len(starts):
            continue
        lengths = ends - starts
        first = np.cumsum(lengths) - lengths
        power = np.cumprod(np.full(int(lengths.max()), _BASE))
        body = raw[inside[1:-1]].astype(np.uint64) + np.uint64(1)
        found.append(_mixed(np.add.reduceat(body * power[np.arange(len(body)) - np.repeat(first, lengths)], first)))
    return np.concatenate(found)


def gram_hashes(words: np.ndarray) -> list[np.ndarray]:
    """Hashes of the n-grams of 1 to ORDER words, by last word."""
    grams = [words]
    for k in range(2, ORDER + 1):
        grams.append(_mixed(grams[-1][:-1] * _BASE + words[k - 1:] + np.uint64(k)))
    return grams


def _counted(grams: list, repeats: list = ()) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct n-grams, counts) of arrays of n-grams and of (n-grams, counts) pairs; empties the list of arrays."""
    gram = np.concatenate([np.zeros(0, np.uint64), *grams])
    grams.clear()
    gram.sort()
    starts = np.flatnonzero(np.concatenate(([len(gram) > 0], gram[1:] != gram[:-1])))
    gram, n = gram[starts], np.diff(starts, append=len(gram))
    if not repeats:
        return gram, n
    gram, at = np.unique(np.concatenate([gram, *(g for g, _ in repeats)]), return_inverse=True)
    return gram, np.bincount(at, np.concatenate([n, *(m for _, m in repeats)]), len(gram)).astype(np.int64)


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of their bytes."""
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(n)


def _edges(n_buckets: int) -> np.ndarray:
    """First n-gram of every bucket; buckets are equal ranges of hashes."""
    width = (1 << 64) // n_buckets + 1
    return np.array([b * width for b in range(n_buckets)], np.uint64)


RUN = "bucket long, block long, size long, steps binary, n binary"


def count_grams(n_buckets: int):
    """(block, text, copies) -> (bucket, block, run): the distinct n-grams of each block's documents, cut by bucket.

    A run is sorted n-grams as the steps between them, with their counts.
    """
    edges = _edges(n_buckets)

    def runs(block, grams, repeats):
        gram, n = _counted(grams, repeats)
        at = [*np.searchsorted(gram, edges).tolist(), len(gram)]
        filled = [b for b in range(n_buckets) if at[b] < at[b + 1]]
        for lo in range(0, len(filled), 64):
            cuts = [(b, slice(at[b], at[b + 1])) for b in filled[lo:lo + 64]]
            rows = [(b, block, c.stop - c.start, _packed(np.diff(gram[c], prepend=np.uint64(0))), _packed(n[c])) for b, c in cuts]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["bucket", "block", "size", "steps", "n"])

    def count(batches):
        held: dict[int, tuple[list, list]] = {}
        size = 0

        def flush(keep=None):
            for block in [b for b in held if b != keep]:
                yield from runs(block, *held.pop(block))

        for batch in slices(batches):
            for block, text, copies in zip(*(batch.column(i).to_pylist() for i in range(3))):
                grams, repeats = held.setdefault(block, ([], []))
                found = gram_hashes(word_hashes(text))
                size += sum(map(len, found))
                if copies == 1:
                    grams += found
                else:
                    gram, n = _counted(found)
                    repeats.append((gram, n * copies))
            if size > _HELD:  # blocks that are behind go, the one being read only if it alone is too large
                yield from flush(block)
                size = sum(map(len, held[block][0])) + sum(len(g) for g, _ in held[block][1])
                if size > 2 * _HELD:
                    yield from flush()
                    size = 0
        yield from flush()

    return count


def sum_bucket(rows: pa.Table) -> pa.Table:
    """One bucket's runs -> (bucket, block, size, more): for each n-gram of a block in order, how often the other blocks hold it."""
    own: dict[int, list] = {}
    for block, size, steps, n in zip(*(rows[c].to_pylist() for c in ("block", "size", "steps", "n"))):
        own.setdefault(block, []).append((np.cumsum(_unpacked(steps, size), dtype=np.uint64), _unpacked(n, size).astype(np.int64)))
    blocks = {b: parts[0] if len(parts) == 1 else _counted([], parts) for b, parts in own.items()}
    own.clear()
    first, last = min(int(g[0]) for g, _ in blocks.values()), max(int(g[-1]) for g, _ in blocks.values())
    inner = np.array([first + (last - first) * i // _PARTS for i in range(1, _PARTS)], np.uint64)
    ends = {b: [0, *np.searchsorted(g, inner).tolist(), len(g)] for b, (g, _) in blocks.items()}
    for i in range(_PARTS):
        held = [(g[ends[b][i]:ends[b][i + 1]], n[ends[b][i]:ends[b][i + 1]]) for b, (g, n) in blocks.items()]
        gram, at = np.unique(np.concatenate([g for g, _ in held]), return_inverse=True)
        total = np.bincount(at, np.concatenate([n for _, n in held]), len(gram)).astype(np.int64)
        lo = 0
        for mine, n in held:  # the counts of a block give way to those of the others
            n[:] = total[at[lo:lo + len(mine)]] - n
            lo += len(mine)
    block, size, more = zip(*((b, len(g), _packed(n)) for b, (g, n) in blocks.items()))
    return pa.table([pa.array([rows["bucket"][0].as_py()] * len(block), pa.int64()), pa.array(block, pa.int64()), pa.array(size, pa.int64()),
                     pa.array(more, pa.binary())], ["bucket", "block", "size", "more"])


def other_counts(gram: np.ndarray, doc: np.ndarray, copies: np.ndarray, more: np.ndarray) -> np.ndarray:
    """For every n-gram occurrence of a block, how often rows other than its own hold the n-gram.

    ``doc`` is the occurrence's row, ascending; ``copies`` the number of equal rows a row stands for; ``more`` the counts in
    other blocks by distinct n-gram.
    """
    out = np.empty(len(gram), np.int32)
    range_of = np.empty(len(gram), np.uint8)
    for at in range(0, len(gram), _AT_ONCE):
        range_of[at:at + _AT_ONCE] = gram[at:at + _AT_ONCE] >> np.uint64(59)
    done = 0
    for part in range(_PARTS):
        here = np.flatnonzero(range_of == part)
        if not len(here):
            continue
        here = here[np.argsort(gram[here], kind="stable")]  # equal n-grams stay in the order of rows
        ranked, owner = gram[here], doc[here]
        first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        pair = first.copy()
        pair[1:] |= owner[1:] != owner[:-1]
        at = np.flatnonzero(pair)
        mine = np.diff(at, append=len(here))  # occurrences in one row
        starts = np.flatnonzero(first[at])
        total = np.add.reduceat(mine * copies[owner[at]], starts) + more[done:done + len(starts)]
        if out.dtype == np.int32 and total.max() > np.iinfo(np.int32).max:
            out = out.astype(np.int64)
        out[here] = np.repeat(np.repeat(total, np.diff(starts, append=len(at))) - mine, mine)
        done += len(starts)
    return out


SCORED = "doc_id long, n_words long, log_score double, n_backoff long, copies long"


def score_texts(texts, copies: np.ndarray, more, n_corpus: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, log score, words scored by fewer than ORDER words) of the rows of a block."""
    words = [word_hashes(t) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    if not sizes.sum():
        return sizes, np.zeros(len(words)), sizes
    per_order = [np.maximum(sizes - k, 0) for k in range(ORDER)]
    doc = np.concatenate([np.repeat(np.arange(len(words), dtype=np.int32), n) for n in per_order])
    split = np.cumsum([n.sum() for n in per_order])[:-1]
    gram = np.empty(len(doc), np.uint64)
    ends = [np.cumsum(n) + start for n, start in zip(per_order, [0, *split.tolist()])]
    for i in range(len(words)):
        for k, found in enumerate(gram_hashes(words[i])):
            gram[ends[k][i] - len(found):ends[k][i]] = found
        words[i] = None
    # occurrences of all orders lie one after the other: rows ascend within an order, so the last sort key is the row
    counts = np.split(other_counts(gram, doc, copies, more), split)
    del gram, doc
    total = [np.concatenate(([0], np.cumsum(n))) for n in per_order]
    log_score, n_backoff = np.zeros(len(words)), np.zeros(len(words), np.int64)
    rows = np.unique([*np.searchsorted(total[0], np.arange(0, total[0][-1], _AT_ONCE)).tolist(), len(words)])
    for lo, hi in zip([0, *rows.tolist()], rows.tolist()):
        log_score[lo:hi], n_backoff[lo:hi] = _score_rows([c[t[lo]:t[hi]] for c, t in zip(counts, total)], sizes[lo:hi], n_corpus)
    return sizes, log_score, n_backoff


def _score_rows(counts: list, sizes: np.ndarray, n_corpus: int) -> tuple[np.ndarray, np.ndarray]:
    """(log score, words scored by fewer than ORDER words) of rows of ``sizes`` words from the counts of their n-grams, by order."""
    whose = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(whose)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    log, rest = np.log(BACKOFF), np.log(np.maximum(n_corpus - sizes, 1))
    logs = np.log(np.where(counts[0] > 0, counts[0], BACKOFF)) - rest[whose]
    used = np.ones(len(whose), np.int8)
    history, ends = counts[0], np.flatnonzero(place >= 0)
    for k in range(2, ORDER + 1):
        before, ends = ends, np.flatnonzero(place >= k - 1)  # words that end an n-gram of k - 1 words, of k words
        seen = counts[k - 1] > 0
        shorter = history[np.searchsorted(before, ends - 1)]
        logs[ends[~seen]] += log
        logs[ends[seen]] = np.log(counts[k - 1][seen] / shorter[seen])
        used[ends[seen]] = k
        history = counts[k - 1]
    return np.bincount(whose, logs, len(sizes)), np.bincount(whose, used < ORDER, len(sizes)).astype(np.int64)


def _joined(runs: list) -> np.ndarray:
    """The counts of (size, packed counts) runs, one after the other."""
    out, lo = np.empty(sum(size for size, _ in runs), np.int32), 0
    for size, data in runs:
        part = _unpacked(data, size)
        if out.dtype == np.int32 and size and part.max() > np.iinfo(np.int32).max:
            out = out.astype(np.int64)
        out[lo:lo + size] = part
        lo += size
    return out


def score_block(n_corpus: int):
    """A block's documents and the counts of their n-grams in the other blocks -> scores."""

    def score_rows(docs: pa.Table, shared: pa.Table) -> pa.Table:
        runs = sorted(zip(*(shared[c].to_pylist() for c in ("bucket", "size", "more"))))
        more = _joined([run[1:] for run in runs])
        copies = docs["copies"].to_numpy()
        found = score_texts((t.as_py() for t in docs["text"]), copies, more, n_corpus)
        return pa.table([docs["doc_id"].combine_chunks(), *map(pa.array, found), pa.array(copies)], ["doc_id", "n_words", "log_score", "n_backoff", "copies"])

    return score_rows


def in_blocks(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """(doc_id, text, block, copies), the words and the bytes of all rows.

    Rows of BLOCK_IDS neighbouring ids are a block, rows without id are dealt over a thousand by their text. A block of more
    than BLOCK_BYTES is cut by hash of id and text, and its equal rows become one with their number.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("home", F.coalesce(F.floor(F.col("doc_id") / BLOCK_IDS), -1 - F.pmod(F.xxhash64("text"), F.lit(1000))))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    homes = cut(rows.groupBy("home").agg(F.sum(size).alias("bytes"), F.sum(F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))).alias("words")))
    words, held = homes.agg(F.sum("words"), F.sum("bytes")).first()
    heavy = homes.filter(F.col("bytes") > BLOCK_BYTES).select("home", F.ceil(F.col("bytes") / BLOCK_BYTES).alias("parts"))
    one = F.lit(1).cast("long").alias("copies")
    if heavy.isEmpty():
        return rows.select("doc_id", "text", F.col("home").alias("block"), one), words or 0, held or 0
    named = rows.join(broadcast_if_small(heavy), "home", "left")
    salt = F.pmod(F.xxhash64("doc_id", "text"), F.col("parts"))
    light = named.filter("parts IS NULL").select("doc_id", "text", F.xxhash64("home").alias("block"), one)
    split = named.filter("parts IS NOT NULL").groupBy("doc_id", "text", F.xxhash64("home", salt).alias("block")).agg(F.count(F.lit(1)).alias("copies"))
    return light.unionByName(split), words, held


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, log_score, n_backoff): stupid-backoff score of every whole text under the counts of all other rows.

    One row per row of ``docs``; equal texts get equal scores, repeated rows are other rows of each other. A text that is null
    or has no word has 0 words and log_score 0. n_backoff counts words scored by an n-gram of fewer than ORDER words, the first
    words of a text included. Other columns are ignored.
    """
    rows, n_words, n_bytes = in_blocks(docs)
    buckets = max(partitions(docs.sparkSession), -(-n_bytes // BUCKET_BYTES))
    counted = rows.select("block", "text", "copies").mapInArrow(count_grams(buckets), RUN)
    shared = counted.groupBy("bucket").applyInArrow(sum_bucket, "bucket long, block long, size long, more binary")
    scored = rows.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(score_block(n_words), SCORED)
    return scored.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("_copy", "copies")
