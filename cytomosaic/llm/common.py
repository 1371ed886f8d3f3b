"""Small helpers shared by the text operators."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of the contracts that split at ASCII white space; ``bytes.split()`` cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet (inputs may carry any extra column)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut_at_space(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """``data`` in pieces of about ``size`` bytes that end before a space or line feed, so that no word is split.

    A word longer than ``size`` stays whole. Concatenated, the pieces are ``data``.
    """
    start, end = 0, len(data)
    while end - start > size:
        at = max(data.rfind(b" ", start + 1, start + size), data.rfind(b"\n", start + 1, start + size))
        if at < 0:
            found = [p for p in (data.find(b" ", start + size), data.find(b"\n", start + size)) if p >= 0]
            if not found:
                break
            at = min(found)
        yield data[start:at]
        start = at
    yield data[start:]


#: Rows of an Arrow batch that are Python objects at a time: a batch of whole documents is large enough as it is.
SLICE = 256


def slices(batches):
    """The batches of a task in pieces of SLICE rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def sliced(make):
    """An Arrow function of one or two columns that runs ``make`` (columns as lists -> array) on SLICE rows at a time."""
    import pyarrow as pa

    def one(a: pa.Array) -> pa.Array:
        return pa.concat_arrays([make(a.slice(at, SLICE).to_pylist()) for at in range(0, max(1, len(a)), SLICE)])

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.concat_arrays([make(*(x.slice(at, SLICE).to_pylist() for x in (a, b))) for at in range(0, max(1, len(a)), SLICE)])

    chosen = one if make.__code__.co_argcount == 1 else two
    chosen.__annotations__ = dict.fromkeys(("a", "b", "return") if chosen is two else ("a", "return"), pa.Array)
    return chosen


#: Ranges whose totals meet in one window; the totals of such spans of ranges are summed once more.
SPAN = 4096


def range_starts(totals: DataFrame, keys: list[str], bucket: str, value: str) -> DataFrame:
    """``totals`` (one row per key and range) with ``_start``: the sum of ``value`` over the key's earlier ranges.

    Two levels: ranges within a span of SPAN range numbers, then spans, so a window holds few rows even for millions of ranges.
    """
    part = totals.withColumn("_span", F.floor(F.col(bucket) / SPAN))
    ahead = lambda order, *more: Window.partitionBy(*keys, *more).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    spans = part.groupBy(*keys, "_span").agg(F.sum(value).alias("_sum"))
    spans = spans.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], F.col("_span").alias("_s"),
                         F.coalesce(F.sum("_sum").over(ahead("_span", F.lit(0))), F.lit(0)).alias("_base"))
    same = F.col("_span") == F.col("_s")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_g{i}"))
    inside = F.coalesce(F.sum(value).over(ahead(bucket, "_span")), F.lit(0))
    joined = part.withColumn("_inside", inside).join(spans, same)
    return joined.withColumn("_start", F.col("_base") + F.col("_inside")).drop("_span", "_s", "_base", "_inside", *[f"_g{i}" for i in range(len(keys))])


def running(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], value: str, out: str) -> DataFrame:
    """Inclusive running sum of ``value`` by ``order`` within ``keys``, without a key's rows ever meeting in one task.

    ``bucket`` cuts every key's order into consecutive ranges: rows are summed within (key, range), and each range starts at
    the total of the ranges before it, taken from a table of one row per (key, range).
    """
    part = df.withColumn("_bucket", bucket)
    starts = range_starts(part.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_total")), keys, "_bucket", "_total").select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), "_start")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = part.withColumn("_within", F.sum(value).over(inside))
    same = F.col("_bucket") == F.col("_b")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    rows = summed.join(starts, same).withColumn(out, F.col("_start") + F.col("_within"))
    return rows.drop("_bucket", "_b", "_start", "_within", *[f"_k{i}" for i in range(len(keys))])


def shared(spark: SparkSession, thing) -> Callable:
    """Broadcast ``thing`` with its class by value; the returned function gives it on executors, decoded once per task."""
    raw = spark.sparkContext.broadcast(cloudpickle.dumps(thing))
    held: list = []

    def get():
        if not held:
            held.append(pickle.loads(raw.value))
        return held[0]

    return get
