"""Exact top-k by inner product with multi-resolution segment statistics.

A vector is cut into 1, 4 and 16 segments; each keeps its mean and the norm of its deviations. For one segment of length m the
inner product of two vectors is ``m * mean_x * mean_y`` plus the inner product of the deviations, which is at most the product
of their norms. Summed, this bounds a score from above (and the distance ``|x|^2 + |y|^2 - 2 x.y`` from below), ever more
tightly from coarse to fine. Only pairs whose bound still reaches the query's k-th best score are computed exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

LEVELS = (1, 4, 16)
QUERY_BLOCK, ROW_BLOCK = 512, 4096
EXACT = float(1 << 53)
INT64 = (-(1 << 63), (1 << 63) - 1)


def statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean * sqrt(m), deviation norm) of each row's segments; the product of two rows' scaled means is m * mean_x * mean_y."""
    means, norms = [], []
    for part in np.array_split(x, min(segments, x.shape[1]), axis=1):
        mean = part.mean(axis=1)
        means.append(mean * np.sqrt(part.shape[1]))
        norms.append(np.sqrt(((part - mean[:, None]) ** 2).sum(axis=1)))
    return np.stack(means, axis=1), np.stack(norms, axis=1)


def best_of_block(qid, q, vid, v, k, floor):
    """Rows (query_id, vec_id, score) that can be among the k best of a query; ``floor`` holds scores the k best reach for sure."""
    big = len(q) and len(v) and np.abs(q).max() * np.abs(v).max() * q.shape[1] >= EXACT
    open_ = np.ones((len(q), len(v)), bool)
    if not big:
        slack = 1e-9 * (np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * q.shape[1] + 1)
        for level in LEVELS:
            (qm, qn), (vm, vn) = statistics(q, level), statistics(v, level)
            open_ &= qm @ vm.T + qn @ vn.T + slack >= floor[:, None]
    out = []
    for i in range(len(q)):
        at = np.flatnonzero(open_[i] & (vid != qid[i]))
        if not len(at):
            continue
        if big:  # beyond the integers of a double: Python's own, clipped to a long
            mine = [int(x) for x in q[i]]
            score = np.array([min(max(sum(a * int(b) for a, b in zip(mine, v[j])), INT64[0]), INT64[1]) for j in at], np.int64)
        else:
            score = (v[at] @ q[i]).astype(np.int64)
        order = np.lexsort((vid[at], -score.astype(object) if big else -score))[:k]
        out.append((np.full(len(order), qid[i]), vid[at][order], score[order]))
    return out


def vectors(rows: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, vec): components floor(scale * x) as doubles; rows with a null id, a null or empty vector, or a null or non-finite component are left out."""
    vec = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return rows.filter(F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long"), vec.alias("vec"))


def top_k(rows: DataFrame, is_query, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest integer inner products of each query with every other row.

    ``rows`` comes from ``vectors``; ``is_query`` is a condition on its columns. Ties go to the smaller vec_id; a query with
    fewer candidates returns all. Vectors meet those of their own length only. Rows that share their query's vec_id are its own
    and no candidates; a repeated query row is answered once, from its smallest vector, while repeated candidates each take a rank.
    """
    rows = cut(rows.withColumn("dim", F.size("vec")))
    asked = rows.filter(is_query).groupBy("vec_id").agg(F.min(F.struct("dim", "vec")).alias("q")).select("vec_id", "q.dim", "q.vec")
    n, n_asked = rows.count(), asked.count()
    n_blocks, n_query_blocks = max(1, -(-n // ROW_BLOCK)), max(1, -(-n_asked // QUERY_BLOCK))
    some = rows.limit(ROW_BLOCK).toPandas()  # bounded: it only raises the floors below which pairs are left out
    shared = rows.sparkSession.sparkContext.broadcast({dim: (g["vec_id"].to_numpy(), np.stack(g["vec"].to_numpy())) for dim, g in some.groupby("dim")})

    def floors(frames):
        for pdf in frames:
            floor = np.full(len(pdf), -np.inf)
            for i, (vec_id, dim, vec) in enumerate(zip(pdf["vec_id"], pdf["dim"], pdf["vec"])):
                if dim in shared.value:
                    ids, other = shared.value[dim]
                    scores = (other @ vec)[ids != vec_id]
                    if len(scores) >= k:
                        floor[i] = np.partition(scores, len(scores) - k)[len(scores) - k]
            yield pdf.assign(floor=np.where(np.isfinite(floor) & (np.abs(floor) < EXACT), floor, -np.inf))

    def meet(queries, candidates):
        if not len(queries) or not len(candidates):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        found = best_of_block(queries["vec_id"].to_numpy(), np.stack(queries["vec"].to_numpy()), candidates["vec_id"].to_numpy(),
                              np.stack(candidates["vec"].to_numpy()), k, queries["floor"].to_numpy())
        return pd.DataFrame({name: np.concatenate([f[i] for f in found]) if found else np.array([], np.int64)
                             for i, name in enumerate(("query_id", "vec_id", "score"))})

    each = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    queries = asked.mapInPandas(floors, "vec_id long, dim int, vec array<double>, floor double").select(
        F.pmod(F.xxhash64("vec_id"), F.lit(n_query_blocks)).alias("q_block"), "*").withColumn("block", each(n_blocks))
    blocks = rows.select(F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n_blocks)).alias("block"), "*").withColumn(
        "q_block", each(n_query_blocks))
    tile = ["block", "q_block", "dim"]
    pairs = queries.groupBy(*tile).cogroup(blocks.groupBy(*tile)).applyInPandas(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
