"""Sharding by jump consistent hashing."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.llm.common import cores, cut, table

#: Slots are numbered in so many blocks a shard, so that no task sorts a whole shard.
BLOCKS = 1024


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key: jumps forward at pseudo-random points until past the last shard."""
    state = keys.astype(np.int64).view(np.uint64).copy()
    at, ahead = np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        at[live] = ahead[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        span = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[live] = ((at[live] + 1) * (2.0**31 / span)).astype(np.int64)
        live = live[ahead[live] < shards]
    return at


def jump_shard(key: Column, shards: int) -> Column:
    """Column of shard numbers 0..shards-1 for a bigint key column without nulls."""
    if shards < 1:
        raise ValueError("shards must be positive")

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64), shards).astype(np.int32))

    return shard(key)


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", grow_to: int | None = None) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    The id and the shard count alone decide the shard, so a row never moves except into an appended
    shard. Rows with equal ids, a null id included, share a shard and get slots of their own; a null
    text has size 8 and the checksum of an empty one; texts of any length are taken whole; other columns are ignored; an empty table gives an
    empty result. Slots count from 0 without gaps within a shard, in the order of block, id, checksum and size; rows equal in all of
    these are interchangeable: they are counted before they meet, and numbered in runs.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    placed = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col)).alias("key"), text.alias("text")).select(
        "id",
        (F.octet_length("text") + F.lit(8)).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("crc"),
        jump_shard(F.col("key"), shards).alias("shard"),
        jump_shard(F.col("key"), grow_to or shards + 1).alias("grown_shard"),
    )
    alike = placed.groupBy("id", "size", "crc", "shard", "grown_shard").agg(F.count("*").alias("n"))
    alike = cut(alike.withColumn("block", F.pmod(F.xxhash64("id", "crc", "size"), F.lit(BLOCKS)).cast("int")), 2 * cores(docs.sparkSession))
    counts = alike.groupBy("shard", "block").agg(F.sum("n").alias("n"))
    # At most shards * BLOCKS rows.
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "block").orderBy("id", "crc", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = alike.withColumn("nth", F.coalesce(F.sum("n").over(order), F.lit(0))).join(F.broadcast(starts), ["shard", "block"])
    runs = numbered.withColumn("run", F.explode(F.expr("sequence(0, (n - 1) div 4096)")))
    each = runs.withColumn("i", F.explode(F.expr("sequence(run * 4096, least(n, (run + 1) * 4096) - 1)")))
    return each.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard", (F.col("start") + F.col("nth") + F.col("i")).cast("long").alias("slot"), "grown_shard")


def op8_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), 24)
