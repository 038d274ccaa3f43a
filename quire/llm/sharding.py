"""Sharding by jump consistent hashing.

Each key walks a chain of jumps 0 <= j1 < j2 < ...; the last one below the number of shards is its shard. The walk
draws from a stream seeded by the key, so a key's shard under n + 1 shards is its shard under n or the new one.
There is no ring and no table: ``jump_shard`` is a Column expression. Slots count the rows of a shard without a gap:
equal rows are counted first, their counts are summed up within (shard, bucket of the whole row), the buckets' offsets, a
table of shards x buckets rows, are added, and each count becomes its rows again. So no shard's rows meet in one task,
nor do those of one key, however often it is repeated.

Nulls: a null key is a key of its own. A null text has size 8 and the checksum of the empty text. Equal keys go to
the same shard and get different slots. Texts are measured whole. An empty table gives an empty result. Other columns
are left out of the result, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def jump_shard(key: Column, shards: int) -> Column:
    """The shard (0 to shards - 1) of ``key``; at most ``shards`` jumps, about ln(shards) on average."""

    def jump(state: Column, i: Column) -> Column:
        draw = F.shiftrightunsigned(F.xxhash64(key, i), 33) + F.lit(1)
        far = F.floor((state["j"] + F.lit(1)) * (F.lit(2147483648.0) / draw))
        return F.when(state["j"] < shards, F.struct(state["j"].alias("b"), far.cast("long").alias("j"))).otherwise(state)

    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, jump, lambda s: s["b"].cast("int"))


def shard(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", rows_per_bucket: int = 50_000) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``."""
    n = docs.select(key).count()
    buckets = max(8, math.ceil(n / (shards * rows_per_bucket)))
    body = F.coalesce(F.col(text), F.lit(""))
    k = docs.select(
        F.col(key), (F.octet_length(body).cast("long") + F.lit(8)).alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        jump_shard(F.col(key), shards).alias("shard"), jump_shard(F.col(key), shards + 1).alias("grown_shard"),
    )
    bucket = F.pmod(F.xxhash64(F.col(key), "size", "text_crc32", F.lit("bucket")), F.lit(buckets)).cast("int")
    k = k.groupBy(key, "size", "text_crc32", "shard", "grown_shard").agg(F.count("*").alias("n")).withColumn("bucket", bucket)
    sizes = k.groupBy("shard", "bucket").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")
    offsets = sizes.select("shard", "bucket", before.alias("offset"))
    within = F.sum("n").over(Window.partitionBy("shard", "bucket").orderBy(key, "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    placed = k.withColumn("within", within).join(offsets, ["shard", "bucket"]).withColumn("first", F.col("offset") + F.col("within"))
    # a row a copy: generated one by one, never held together
    return placed.select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot"), "grown_shard"
    )
