"""Random relabellings that every cell computes for itself: a keyed bijection of the ranks of a slide.

A Feistel network permutes the numbers of an even count of bits; a number that leaves the slide's range walks on until it is back
in it (cycle walking), which makes a bijection of the range. Labels lie along the positions 0 .. m - 1 of a slide in sorted order,
so a permutation keeps a slide's label counts exactly, and no cell needs to know where the others went.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MASK = (1 << 31) - 1
FACTORS = (73244475, 295559667)
ROUNDS = 4
ROUND_STEP, PERM_STEP, SEED_STEP = 7919, 48271, 69621


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 31-bit numbers."""
    x = ((x ^ (x >> 16)) * FACTORS[0]) & MASK
    x = ((x ^ (x >> 15)) * FACTORS[1]) & MASK
    return x ^ (x >> 16)


def half_bits(size: np.ndarray) -> np.ndarray:
    """Bits of each half of the smallest even-bit domain that holds 0 .. size - 1; at least one."""
    bits = np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64)
    return (bits + 1) // 2


def permuted(rank: np.ndarray, size: np.ndarray, key: np.ndarray, perms: np.ndarray, seed: int) -> np.ndarray:
    """Where each rank (below its ``size``) goes in each permutation: ranks x perms; ``key`` sets slides apart."""
    start = mixed((key[:, None] + perms[None, :] * PERM_STEP + seed * SEED_STEP) & MASK).ravel()
    half = np.repeat(half_bits(size), len(perms))
    limit, x = np.repeat(size, len(perms)), np.repeat(rank, len(perms))
    at = np.arange(len(x))
    while len(at):
        h, k = half[at], start[at]
        mask = (1 << h) - 1
        left, right = x[at] >> h, x[at] & mask
        for i in range(ROUNDS):
            left, right = right, left ^ (mixed((right + mixed((k + i * ROUND_STEP) & MASK)) & MASK) & mask)
        x[at] = (left << h) | right
        at = at[x[at] >= limit[at]]
    return x.reshape(len(rank), len(perms))


def ranked(cells: DataFrame, per_bucket: int = 50_000) -> DataFrame:
    """(slide_id, cell_id, key, rank, size): each cell's number within its slide, in the order of the hash of its id.

    Ranks come from hash ranges and their running totals, so no slide is numbered by one task.
    """
    size = cells.groupBy("slide_id").agg(F.count(F.lit(1)).alias("size"))
    digits = lambda c, n: F.conv(F.substring(F.md5(c), 1, n), 16, 10).cast("long")
    rows = cells.select("slide_id", "cell_id").join(size, "slide_id").withColumn("_hash", F.md5("cell_id"))
    rows = rows.withColumn("_b", F.floor(digits("cell_id", 8) * F.ceil(F.col("size") / per_bucket) / float(1 << 32)))
    before = W.partitionBy("slide_id").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    tally = rows.groupBy("slide_id", "_b").agg(F.count(F.lit(1)).alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    local = F.row_number().over(W.partitionBy("slide_id", "_b").orderBy("_hash", "cell_id")) - 1
    return rows.withColumn("_local", local).join(tally.drop("_c"), ["slide_id", "_b"]).select(
        "slide_id", "cell_id", digits("slide_id", 7).alias("key"), (F.col("_before") + F.col("_local")).alias("rank"), "size")
