"""All rows against all rows: vectors are packed into bounded arrays that Spark crosses, partition by partition, without a shuffle.

A pack is one row of a written table; a task holds a pack of sources and reads the packs of one partition past it. What leaves a task is
bounded by its sources, so shuffled bytes grow with the rows times the partitions and not with the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Rows of a pack, at least and at most; packs that a small table is cut into, for the sake of parallel tasks.
LEAST, MOST, SPREAD = 256, 4096, 24
#: Rows of sources that meet a pack at once, and pairs whose differences are held at once.
STRIP, HELD = 256, 1 << 15


def pack_rows(n: int) -> int:
    return min(MOST, max(LEAST, math.ceil(n / SPREAD)))


def packed(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows(pack, vec, ...)`` as one row per pack: ``columns`` as lists in one order, ``vec`` end to end, ``n`` rows."""
    one = F.sort_array(F.collect_list(F.struct(*columns, "vec"))).alias("_r")
    lists = rows.groupBy("pack").agg(one).select("pack", F.size("_r").alias("n"), *[F.col(f"_r.{c}").alias(c) for c in columns],
                                                 F.flatten(F.col("_r.vec")).alias("vec"))
    return cut(lists.repartitionByRange(SPREAD, "pack"))


def crossed(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every pack of ``left`` (columns l_...) with every pack of ``right`` (r_...)."""
    named = lambda df, side: df.select([F.col(c).alias(f"{side}_{c}") for c in df.columns])
    return named(left, "l").crossJoin(named(right, "r").hint("shuffle_replicate_nl"))


def vectors_of(batch: pa.RecordBatch, side: str, i: int) -> np.ndarray:
    return batch.column(f"{side}_vec")[i].values.to_numpy(zero_copy_only=False).astype(float).reshape(batch.column(f"{side}_n")[i].as_py(), -1)


def met(batches, open_, meet, close):
    """Run ``meet`` over the rows of crossed packs, between ``open_`` and ``close`` of each run of one left pack."""
    last, state = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            pack = batch.column("l_pack")[i].as_py()
            if pack != last:
                if state is not None:
                    yield from close(state)
                last, state = pack, open_(batch, i)
            meet(state, batch, i)
    if state is not None:
        yield from close(state)


class Targets:
    """Vectors that several sources meet: what does not depend on the sources is made once."""

    def __init__(self, ids: np.ndarray, y: np.ndarray):
        self.ids, self.y = ids, y
        self.square = (y**2).sum(1)
        self.large, self.made = self.square.max(initial=0.0), {}

    def screened(self, kind):
        """The vectors with 1 and their squares as columns, and room for a strip of squared distances and of their tests."""
        if kind not in self.made:
            wide = np.concatenate((self.y, np.ones((len(self.y), 1)), self.square[:, None]), axis=1).astype(kind)
            self.made[kind] = wide, np.empty((STRIP, len(wide)), kind), np.empty((STRIP, len(wide)), bool)
        return self.made[kind]


class Nearest:
    """The k nearest so far of the sources of a pack: by distance in 12 decimals, then id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, bound: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.bound = bound.astype(float).copy()  # distances beyond are of no interest
        self.square, self.names = (x**2).sum(1), set(ids.tolist())
        self.large = self.square.max(initial=0.0)
        # one product with the columns of ``Targets.screened`` gives squared distances: |x|^2 + |y|^2 - 2 xy
        self.wide = np.concatenate((-2.0 * x, self.square[:, None], np.ones((len(x), 1))), axis=1)
        self.row, self.dst, self.dist = np.zeros(0, np.int64), np.zeros(0, "U1"), np.zeros(0)

    def meet(self, targets: Targets, allowed) -> None:
        """``allowed(lo, hi)`` tells which targets the sources lo to hi meet: None (all), a mask of targets or of pairs."""
        ids, y = targets.ids, targets.y
        kind = np.float32 if max(self.large, targets.large) < 1e30 else np.float64  # screened in single precision where it holds the squares
        wide, (y32, room, test) = self.wide.astype(kind), targets.screened(kind)
        slack = (y.shape[1] + 16) * float(np.finfo(kind).eps) * (self.square + targets.large) * 2.0 + 1e-37
        shared = not self.names.isdisjoint(ids.tolist())
        got = []
        for lo in range(0, len(self.x), STRIP):
            hi = min(lo + STRIP, len(self.x))
            ok = allowed(lo, hi)
            if ok is not None and not ok.any():
                continue
            cols = np.flatnonzero(ok) if ok is not None and ok.ndim == 1 and not ok.all() else None
            width = len(y) if cols is None else len(cols)
            d2, near = room[:hi - lo, :width], test[:hi - lo, :width]
            np.matmul(wide[lo:hi], (y32 if cols is None else y32[cols]).T, out=d2)
            if ok is not None and ok.ndim == 2:
                d2[~ok] = np.inf
            if shared:
                d2[self.ids[lo:hi, None] == (ids if cols is None else ids[cols])[None, :]] = np.inf
            limit = self.bound[lo:hi] ** 2 * (1.0 + 1e-9) + slack[lo:hi]
            np.less_equal(d2, limit[:, None].astype(kind), out=near)
            if np.count_nonzero(near) > 4 * self.k * (hi - lo) and width > self.k:
                limit = np.minimum(limit, np.partition(d2, self.k - 1, axis=1)[:, self.k - 1] + 2.0 * slack[lo:hi])
                near = d2 <= np.nextafter(limit[:, None].astype(kind), kind(np.inf))
            if not np.isfinite(limit).all():
                near &= np.isfinite(d2)
            a, b = np.divmod(np.flatnonzero(near), width)
            got.append((a + lo, b if cols is None else cols[b]))
        if not got:
            return
        a, b = (np.concatenate(v) for v in zip(*got))
        dist = np.concatenate([np.sqrt(((y[b[at:at + HELD]] - self.x[a[at:at + HELD]]) ** 2).sum(1)) for at in range(0, len(a), HELD)] or [np.zeros(0)])
        close = dist <= self.bound[a] * (1.0 + 1e-9) + 1e-12
        if not close.any():
            return
        self.row, self.dst, self.dist = (np.concatenate(v) for v in ((self.row, a[close]), (self.dst, ids[b[close]]), (self.dist, dist[close])))
        order = _ordered(self.row, np.round(self.dist, 12), self.dst)
        row = self.row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        order = order[place < self.k]
        self.row, self.dst, self.dist = self.row[order], self.dst[order], self.dist[order]
        row = self.row
        full = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) == self.k - 1)
        self.bound[row[full]] = np.minimum(self.bound[row[full]], self.dist[full])

    def edges(self):
        for at in range(0, len(self.row), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[self.row[part]].tolist(), pa.string()), pa.array(self.dst[part].tolist(), pa.string()),
                                              pa.array(self.dist[part])], ["src", "dst", "dist"])


def _ordered(row: np.ndarray, dist: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The order by row, distance and id; ids are compared where rows and distances are equal."""
    order = np.lexsort((dist, row))
    equal = (np.diff(row[order]) == 0) & (np.diff(dist[order]) == 0)
    if equal.any():
        tied = np.flatnonzero(np.concatenate((equal, [False])) | np.concatenate(([False], equal)))
        group = np.cumsum(np.concatenate(([True], ~equal)))[tied]
        order[tied] = order[tied][np.lexsort((dst[order[tied]], group))]
    return order


def text(batch: pa.RecordBatch, column: str, i: int) -> np.ndarray:
    return np.array(batch.column(column)[i].as_py(), dtype=str)


def numbers(batch: pa.RecordBatch, column: str, i: int) -> np.ndarray:
    return batch.column(column)[i].values.to_numpy(zero_copy_only=False)


def grid(batch: pa.RecordBatch, column: str, i: int, width: int) -> np.ndarray:
    """A list of lists as a matrix."""
    return batch.column(column)[i].values.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
