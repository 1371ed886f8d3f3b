"""Vector code compression: one small codebook per part of a vector, fitted by exact integer k-means with Drake-Hamerly bounds.

Every part of every vector keeps, besides its entry, the ids of its ``b`` closest other entries in order, a lower bound on the
distance to each, one outer bound below the distance to all further entries, and an upper bound on the distance to its own entry.
When entries move, the bounds are shifted by how far they moved. A part whose upper bound stays below the first lower bound keeps
its entry without any distance; one that is uncertain computes only the closest entries whose bounds it reaches, and all of them
only if it reaches the outer bound. The bounds are floats, rounded outwards; wherever they do not decide, integer distances do, so
the result is that of plain k-means with ties to the lower index. As in Drake and Hamerly (2012), b starts at a quarter of the
entries and then follows what the parts needed.

The state is a column beside the vector; it is written once per round, and the round before is removed. Entry sums change by integer deltas of the parts that moved,
added up by Spark; only entries (parts x 16 x width numbers per vector length) reach the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut, remove, written
from .topk import INT64

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE = 4096
#: Rows whose distances to all entries are held at a time.
STRIP = 2048
#: Limbs of the integers that tasks add up: sums of any size, each limb a long.
LIMB = 31


def _fitting(values: np.ndarray) -> np.ndarray:
    """Whole numbers (floats or Python integers) as int64, or as Python integers where squared distances might pass a long."""
    if values.size and 2 * np.abs(values.astype(np.float64)).max() >= np.sqrt(2.0**62 / max(1, values.shape[-1])):
        return np.array([int(x) for x in values.ravel()], object).reshape(values.shape)
    return values.astype(np.int64)


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of every component."""
    return _fitting(np.floor(np.asarray(values, np.float64) * SCALE))


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Integer squared distances of every row of ``x`` to every entry."""
    return np.stack([((x - e) ** 2).sum(1) for e in entries], axis=1)


def _root(squares: np.ndarray, up: bool) -> np.ndarray:
    """Square roots as float32, rounded to the safe side."""
    root = np.sqrt(squares.astype(np.float64)).astype(np.float32)
    return np.nextafter(root, np.float32(np.inf if up else -np.inf))


class Bounds:
    """The state of one part of n rows: entry, upper bound, ids and lower bounds of b further entries, outer bound (last column)."""

    def __init__(self, code: np.ndarray, ids: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        self.code, self.ids, self.upper, self.lower = code, ids, upper, lower

    @classmethod
    def unknown(cls, n: int, b: int) -> Bounds:
        return cls(np.full(n, -1, np.int64), np.zeros((n, b), np.uint8), np.full(n, np.inf, np.float32), np.full((n, b + 1), -np.inf, np.float32))

    @staticmethod
    def width(b: int) -> int:
        """Bytes of a row, without its code."""
        return 5 * b + 8

    def pack(self) -> np.ndarray:
        n = len(self.code)
        return np.concatenate((self.ids, self.upper.view(np.uint8).reshape(n, 4), np.ascontiguousarray(self.lower).view(np.uint8).reshape(n, -1)), axis=1)

    @classmethod
    def unpack(cls, code: np.ndarray, raw: np.ndarray, b: int) -> Bounds:
        floats = np.ascontiguousarray(raw[:, b:]).view(np.float32)
        return cls(code.astype(np.int64), raw[:, :b].copy(), floats[:, 0].copy(), floats[:, 1:].copy())

    def narrowed(self, b: int) -> Bounds:
        """With the first ``b`` ids; the outer bound then covers the others."""
        if b < self.ids.shape[1]:
            self.lower = np.concatenate((self.lower[:, :b], self.lower[:, b:].min(1, keepdims=True)), axis=1)
            self.ids = np.ascontiguousarray(self.ids[:, :b])
        return self


def reassign(x: np.ndarray, entries: np.ndarray, state: Bounds, drift: np.ndarray, used: np.ndarray) -> int:
    """Bring ``state`` to the nearest entries after these moved by ``drift`` (float64 lengths); returns the distances computed.

    ``used[i]`` counts the parts that were settled with i of their closest entries (the last one: with all entries).
    """
    b = state.ids.shape[1]
    old = state.code >= 0
    if old.any():  # float32 sums are moved outwards by one step
        state.upper[old] = np.nextafter((state.upper[old] + drift[state.code[old]]).astype(np.float32), np.float32(np.inf))
        gone = np.concatenate((drift[state.ids], np.full((len(x), 1), drift.max())), axis=1)
        state.lower = np.nextafter((state.lower - gone).astype(np.float32), np.float32(-np.inf))
        # later entries are no closer than an earlier bound says
        state.lower = np.minimum.accumulate(state.lower[:, ::-1], axis=1)[:, ::-1]
    open_ = ~(old & (state.upper < state.lower[:, 0]))
    used[0] += int((~open_).sum())
    computed = 0
    at = np.flatnonzero(open_ & old)
    if len(at):  # the own distance, exactly, closes many
        own = ((x[at] - entries[state.code[at]]) ** 2).sum(1)
        state.upper[at] = _root(own, True)
        computed += len(at)
        shut = state.upper[at] < state.lower[at, 0]
        used[0] += int(shut.sum())
        open_[at[shut]] = False
    need = np.full(len(x), b + 1)
    at = np.flatnonzero(open_ & old)
    need[at] = (state.lower[at] <= state.upper[at, None]).sum(1)  # bounds ascend: entries from there on are farther
    for z in range(1, b + 1):
        rows = np.flatnonzero(open_ & (need == z))
        if not len(rows):
            continue
        used[z] += len(rows)
        computed += z * len(rows)
        among = np.concatenate((state.code[rows, None], state.ids[rows, :z].astype(np.int64)), axis=1)
        squares = np.stack([((x[rows] - entries[among[:, i]]) ** 2).sum(1) for i in range(z + 1)], axis=1)
        by_id = np.argsort(among, axis=1, kind="stable")
        among, squares = np.take_along_axis(among, by_id, 1), np.take_along_axis(squares, by_id, 1)
        order = np.argsort(squares, axis=1, kind="stable")  # ties to the lower index
        among, squares = np.take_along_axis(among, order, 1), np.take_along_axis(squares, order, 1)
        state.code[rows], state.upper[rows] = among[:, 0], _root(squares[:, 0], True)
        state.ids[rows, :z] = among[:, 1:]
        state.lower[rows, :z] = _root(squares[:, 1:], False)
        state.lower[rows] = np.minimum.accumulate(state.lower[rows][:, ::-1], axis=1)[:, ::-1]
    rest = np.flatnonzero(open_ & (need > b))
    used[b + 1] += len(rest)
    computed += len(entries) * len(rest)
    for start in range(0, len(rest), STRIP):
        rows = rest[start:start + STRIP]
        squares = _squares(x[rows], entries)
        order = np.argsort(squares, axis=1, kind="stable")
        near = np.take_along_axis(squares, order, 1)
        state.code[rows], state.upper[rows] = order[:, 0], _root(near[:, 0], True)
        state.ids[rows] = order[:, 1:b + 1]
        state.lower[rows, :b] = _root(near[:, 1:b + 1], False)
        state.lower[rows, b] = _root(near[:, b + 1], False) if len(entries) > b + 1 else np.inf
    return computed


def _split(vectors: np.ndarray) -> list[np.ndarray]:
    return np.split(vectors, PARTS, axis=1)


def _by_length(batch):
    """(rows, length, parts as integers) of a batch, for each vector length in it; at most STRIP rows at a time."""
    column = batch.column("embedding")
    lengths = column.value_lengths().to_numpy()
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        for at in range(0, len(rows), STRIP):
            some = rows[at:at + STRIP]
            flat = column.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False)
            yield some, int(length), _split(integers(flat.reshape(len(some), length)))


def _bytes(column, some: np.ndarray) -> np.ndarray:
    """The binary values of some rows, all of one length, as rows of bytes."""
    return np.frombuffer(b"".join(column.take(pa.array(some)).to_pylist()), np.uint8).reshape(len(some), -1)


def _binary(strips: list[np.ndarray], order: np.ndarray) -> pa.Array:
    """Rows of bytes, strip after strip, as one binary column in the order of the batch."""
    made = []
    for rows in strips:
        offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
        made.append(pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())]))
    return pa.concat_arrays(made).take(pa.array(np.argsort(order)))


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows whose vector has PARTS equal parts and no null or non-finite component."""
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0) & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return rows.filter(F.coalesce(good, F.lit(False))).select("vec_id", "label", "embedding")


def _first_books(rows: DataFrame) -> dict[int, list[np.ndarray]]:
    """Per vector length the codebooks (entries x width of each part) of the smallest ids; ENTRIES vectors per length reach the driver."""
    books = {}
    for (d,) in rows.select(F.size("embedding")).distinct().collect():
        own = rows.filter(F.size("embedding") == d)
        first = own.filter("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("embedding").alias("embedding")).orderBy("vec_id").limit(ENTRIES).collect()
        if not first:  # no row of this length has an id
            first = own.select("embedding").distinct().orderBy("embedding").limit(ENTRIES).collect()
        books[d] = _split(integers(np.array([r.embedding for r in first], np.float64)))
    return books


def _limbs(values: np.ndarray):
    """(limb, values) whose weighted sum (2 ** (LIMB * limb)) is ``values``; the last limb carries the sign."""
    limb = 0
    while True:
        small = np.abs(values.astype(np.float64)).max(initial=0) < 1 << LIMB
        yield limb, (values if small else values & ((1 << LIMB) - 1)).astype(np.int64)
        if small:
            return
        values, limb = values >> LIMB, limb + 1


STATE = ("was", "code", "bounds", "work")


def fit(rows: DataFrame) -> tuple[DataFrame, dict[int, list[np.ndarray]], list[dict]]:
    """(coded rows, codebooks by vector length, work per round) of rows that passed ``usable``.

    Coded rows hold vec_id, label, code (two hex digits a part), error and codebooks_sha256. Work per round and length: distances
    computed, parts settled with 0, 1, ... of their closest entries, and b.
    """
    state, path = written(rows)
    books = _first_books(state)
    moved = {d: [np.zeros(len(p)) for p in parts] for d, parts in books.items()}
    totals = {d: [(np.zeros(p.shape, object), np.zeros(len(p), object)) for p in parts] for d, parts in books.items()}
    b = {d: min(max(1, ENTRIES // 4), len(parts[0]) - 1) for d, parts in books.items()}
    held, work = None, []
    for turn in range(ROUNDS + 1):
        last = path
        state, path = written(_round(state, books, moved, held, dict(b)))
        remove(rows.sparkSession, last)
        held, done = dict(b), {d: np.zeros(b[d] + 3, np.int64) for d in b}
        for r in _deltas(state, books).collect():
            if r.part < 0:
                done[r.d][r.entry] = r.s
            else:
                sums, counts = totals[r.d][r.part]
                if r.pos < 0:
                    counts[r.entry] += r.s << (LIMB * r.limb)
                else:
                    sums[r.entry, r.pos] += r.s << (LIMB * r.limb)
        work.append({d: {"distances": int(x[0]), "settled": x[1:].tolist(), "b": b[d]} for d, x in done.items()})
        if turn == ROUNDS:
            break
        for d, parts in books.items():
            for p, entries in enumerate(parts):
                sums, counts = totals[d][p]
                new = np.array([[s // c for s in row] if c else old.tolist() for row, c, old in zip(sums, counts, entries)], object).reshape(entries.shape)
                gap = [float(sum((int(x) - int(y)) ** 2 for x, y in zip(*pair))) for pair in zip(new, entries)]
                moved[d][p], parts[p] = np.nextafter(np.sqrt(gap), np.inf), _fitting(new)
            if turn:
                needed = max([i for i in range(1, b[d] + 1) if done[d][1 + i]], default=1)
                b[d] = max(min(b[d], needed), min(max(1, ENTRIES // 8), b[d]))
    return _coded(state, books), books, work


def _round(state: DataFrame, books, moved, held, b) -> DataFrame:
    """Every row's entries and bounds after the entries moved; ``was`` is the code before, ``work`` is on the first row of a strip."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            order, was, code, bounds = [], [], [], []
            work = [None] * batch.num_rows
            for some, d, parts in _by_length(batch):
                used, computed, packed, codes = np.zeros(b[d] + 2, np.int64), 0, [], []
                if held is not None:
                    before, raw, per = _bytes(batch.column("code"), some), _bytes(batch.column("bounds"), some), Bounds.width(held[d])
                for p, x in enumerate(parts):
                    s = Bounds.unknown(len(x), b[d]) if held is None else Bounds.unpack(before[:, p], raw[:, p * per:(p + 1) * per], held[d]).narrowed(b[d])
                    computed += reassign(x, books[d][p], s, moved[d][p], used)
                    codes.append(s.code.astype(np.uint8))
                    packed.append(s.pack())
                order.append(some)
                was.append(before if held is not None else np.zeros((len(some), 0), np.uint8))
                code.append(np.stack(codes, axis=1))
                bounds.append(np.concatenate(packed, axis=1))
                work[some[0]] = [computed, *used.tolist()]
            order = np.concatenate(order)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "embedding")), *(_binary(x, order) for x in (was, code, bounds)),
                                              pa.array(work, pa.list_(pa.int64()))], ["vec_id", "label", "embedding", *STATE])

    base = state.select("vec_id", "label", "embedding", *(c for c in STATE if c in state.columns))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema.fields[:3])
    return base.mapInArrow(run, f"{kinds}, was binary, code binary, bounds binary, work array<bigint>")


def _deltas(state: DataFrame, books) -> DataFrame:
    """(d, part, entry, pos, limb, s): what changed in the entries' sums (pos >= 0) and counts (pos = -1); part -1 holds the work."""

    def run(batches):
        sums, work = {}, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            noted = batch.column("work").to_pylist()
            for some, d, parts in _by_length(batch):
                if d not in sums:
                    sums[d] = [(np.zeros(p.shape, object), np.zeros(len(p), np.int64)) for p in books[d]]
                now, before = _bytes(batch.column("code"), some), _bytes(batch.column("was"), some)
                for p, x in enumerate(parts):
                    moves = [(now[:, p], 1)] if not before.shape[1] else [(now[:, p], 1), (before[:, p], -1)]
                    changed = np.ones(len(x), bool) if not before.shape[1] else now[:, p] != before[:, p]
                    total, count = sums[d][p]
                    for entry, sign in moves:
                        for e in np.unique(entry[changed]):
                            pick = x[changed & (entry == e)]
                            total[e] += sign * pick.sum(0).astype(object)
                            count[e] += sign * len(pick)
                for i in some:
                    if noted[i]:
                        work[d] = work.get(d, 0) + np.array(noted[i])
        rows = []
        for d, parts in sums.items():
            for p, (total, count) in enumerate(parts):
                for pos, values in ((None, total), (-1, count)):
                    for limb, part in _limbs(values):
                        for at in zip(*np.nonzero(part)):
                            rows.append((d, p, int(at[0]), -1 if pos == -1 else int(at[1]), limb, int(part[at])))
        rows += [(d, -1, i, 0, 0, int(x)) for d, w in work.items() for i, x in enumerate(w)]
        columns = list(zip(*rows)) or [()] * 6
        kinds = [pa.int32()] * 5 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["d", "part", "entry", "pos", "limb", "s"])

    changed = state.filter("code <> was OR work IS NOT NULL").select("embedding", "was", "code", "work")
    found = changed.mapInArrow(run, "d int, part int, entry int, pos int, limb int, s bigint")
    return found.groupBy("d", "part", "entry", "pos", "limb").agg(F.sum("s").alias("s"))


def digest(parts: list[np.ndarray]) -> str:
    """sha256 of all entries' decimal components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(x) for entries in parts for row in entries.tolist() for x in row).encode()).hexdigest()


def _coded(state: DataFrame, books) -> DataFrame:
    marks = {d: digest(parts) for d, parts in books.items()}

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            error, mark = np.zeros(batch.num_rows, object), np.full(batch.num_rows, None, object)
            for some, d, parts in _by_length(batch):
                code = _bytes(batch.column("code"), some)
                error[some] = sum(((x - books[d][p][code[:, p]]) ** 2).sum(1) for p, x in enumerate(parts))
                mark[some] = marks[d]
            names = [x.hex() for x in batch.column("code").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(names, pa.string()),
                                              pa.array([min(int(x), INT64[1]) for x in error], pa.int64()), pa.array(mark.tolist(), pa.string())],
                                             ["vec_id", "label", "code", "error", "codebooks_sha256"])

    kinds = ", ".join(f"{c} {state.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    return state.select("vec_id", "label", "embedding", "code").mapInArrow(run, f"{kinds}, code string, error bigint, codebooks_sha256 string")


def compress(rows: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every row of ``rows`` (vec_id, label, embedding) that has a usable vector.

    A row is left out if its vector is null, empty, of a length that PARTS does not divide, or holds a null or non-finite component.
    Vectors of different lengths have codebooks of their own. A repeated vec_id starts a codebook once, with its smallest vector, but
    all its rows are coded and counted; rows without vec_id are coded too. With fewer than ENTRIES ids a codebook has as many entries
    as ids. Errors beyond a long are clipped to it; rows without label add up together. An empty table gives no rows.
    """
    coded, _, _ = fit(usable(rows))
    coded = cut(coded)
    whole = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(INT64[1]).cast("decimal(38,0)")).cast("long")
    labels = cut(coded.groupBy(F.col("label").alias("_label")).agg(whole.alias("label_error")))
    return coded.join(broadcast_if_small(labels), F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256")
