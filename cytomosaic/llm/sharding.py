"""Two-pass external shuffle: records scatter into memory-sized buckets by seeded hash, each bucket is shuffled in memory, and the
buckets' concatenation is dealt over the shards.

``shuffle()`` permutes an array by Fisher-Yates; a bucket is one array of about ``BUCKET_BYTES``. Everything runs in the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import range_starts

SEED = 20_240_229
BUCKET_BYTES = 8 << 20
#: A bucket with this many times the mean number of rows (equal ids) is scattered once more, by row position.
HEAVY = 4


def _bucket_count(docs: DataFrame, bucket_bytes: int) -> tuple[int, int]:
    seen = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col("text").cast("string"))).alias("b")).first()
    return seen["n"], max(1, -(-(seen["b"] or 0) // bucket_bytes), -(-seen["n"] // 200_000))


def shuffled(docs: DataFrame, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(row, position): every row of ``docs`` as a struct with its position 0 to n - 1 in the shuffled order.

    First pass: doc_id and seed decide the bucket; buckets that repeated ids have made heavy are split by row position, so no
    group of equal rows meets in one task. Second pass: Fisher-Yates within each bucket. Reruns agree, unless ids repeat so often that
    a bucket was split, or a map column keeps rows from being ordered.
    """
    n, buckets = _bucket_count(docs, bucket_bytes)
    home = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(buckets))
    loads = docs.select(home.alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    mean = max(1, n // buckets)
    heavy = cut(loads.filter(F.col("n") > max(HEAVY * mean, 1000)).select(F.col("b").alias("h"), F.ceil(F.col("n") / mean).alias("ways")))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    key = F.xxhash64("doc_id", "text")
    scattered = docs.select(F.struct(key.alias("key"), whole.alias("row")).alias("item"), home.alias("b"))
    if heavy.isEmpty():
        scattered = scattered.select("item", F.struct("b", F.lit(0).cast("long").alias("s")).alias("bucket"))
    else:  # written once, as row positions may differ from one reading of docs to the next
        part = F.pmod(F.col("again"), F.coalesce("ways", F.lit(1)))
        scattered = cut(scattered.withColumn("again", F.xxhash64(F.monotonically_increasing_id(), F.lit(seed))).join(heavy, F.col("b") == F.col("h"), "left").select(
            "item", F.struct("b", part.alias("s")).alias("bucket")))
    arrays = scattered.groupBy("bucket").agg(F.collect_list("item").alias("items"))
    # rows arrive in any order: sorted, the seed alone decides the permutation, on a rerun or after a lost executor too
    ordered = F.array_sort("items") if "map<" not in docs.schema.simpleString() else F.col("items")
    mixed = arrays.select("bucket", F.transform(F.shuffle(ordered, F.lit(seed)), lambda x: x["row"]).alias("rows"))
    counts = scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    first = range_starts(counts.groupBy("bucket.b").agg(F.sum("n").alias("n")), [], "b", "n").select(F.col("b").alias("_b"), F.col("_start").alias("_first"))
    ahead = Window.partitionBy("bucket.b").orderBy("bucket.s").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.withColumn("_part", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    starts = parts.join(first, F.col("bucket.b") == F.col("_b")).select(F.col("bucket").alias("at"), (F.col("_first") + F.col("_part")).alias("start"))
    placed = mixed.join(starts, F.col("bucket") == F.col("at")).select("start", F.posexplode("rows").alias("offset", "row"))
    return placed.select("row", (F.col("start") + F.col("offset")).alias("position"))


def shards(docs: DataFrame, n_shards: int, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with shard (0 to n_shards - 1) and slot (gapless from 0 within the shard); shard sizes differ by one row at most.

    The shuffled order is dealt like cards: position p goes to shard p mod n_shards, slot p div n_shards. Every row is kept,
    repeated rows and rows with nulls too; columns of ``docs`` named shard or slot are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    placed = shuffled(docs.select(*[F.col(f"`{c}`") for c in kept]), seed, bucket_bytes)
    return placed.select("row.*", (F.col("position") % n_shards).cast("int").alias("shard"), F.floor(F.col("position") / n_shards).alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int, seed: int = SEED) -> None:
    """One folder per shard, each file in slot order."""
    dealt = shards(docs, n_shards, seed)
    dealt.repartition(n_shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
