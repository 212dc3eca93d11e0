"""Sharding by jump consistent hashing, in DataFrame functions only.

A row's shard is a function of its key and the number of shards alone. Going from n to n + 1
shards moves rows into the new shard only, about one row in n + 1. There is no ring table: the
jumps of a key are drawn from `xxhash64(key, i)`, i = 0, 1, ...

Defined results: a null key is a key like any other; equal keys share a shard; an empty table
gives an empty result; columns of the input are never read by name beyond the given key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Rows that one numbering task is meant to get.
ROWS_PER_BUCKET = 2_000


def jump_shard(key: Column, shards: int) -> Column:
    """The shard 0 .. shards - 1 of `key`.

    From shard b the key jumps to floor((b + 1) / u), u uniform in (0, 1]; the last jump that
    stays below `shards` counts. Each jump goes at least one shard further, so at most `shards`
    draws are needed.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")

    def jump(state: Column, i: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, i), 11) + 1) / F.lit(float(1 << 53))
        # below 2^53, so the quotient is exact enough to floor and never overflows a long
        to = F.floor(F.least((state["next"] + 1) / u, F.lit(float(1 << 52)))).cast("long")
        return F.when(
            state["next"] < shards,
            F.struct(state["next"].alias("shard"), to.alias("next")),
        ).otherwise(state)

    start = F.struct(F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("next"))
    last = F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, jump)
    return last["shard"].cast("int")


def number_within(df: DataFrame, group: str, order: list[str], out: str, scratch: Scratch) -> DataFrame:
    """Adds `out`: the row's number within `group`, gapless from 0, without one task per group.

    `df` must be a written table (it is read twice). Groups are cut into buckets by a hash of the
    ordering columns; a small table of bucket counts, pre-aggregated before its shuffle, gives
    each bucket its first number, and rows are ranked inside their bucket only. Rows that agree
    in all of `order` are first told apart by where they lie, so that copies don't meet in one bucket.
    """
    many = df.count() // ROWS_PER_BUCKET + 1
    bucket = F.pmod(F.xxhash64(*order, F.floor(F.monotonically_increasing_id() / 1024)), F.lit(many))
    rows = df.withColumn("_nw_bucket", bucket)
    rows = scratch.keep(rows, f"buckets-{out}")
    counts = rows.groupBy(group, "_nw_bucket").agg(F.count(F.lit(1)).alias("_nw_n"))
    before = Window.partitionBy(group).orderBy("_nw_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(
        F.col(group).alias("_nw_group"), F.col("_nw_bucket").alias("_nw_at"),
        F.coalesce(F.sum("_nw_n").over(before), F.lit(0)).alias("_nw_first"),
    )
    rank = F.row_number().over(Window.partitionBy(group, "_nw_bucket").orderBy(*order))
    ranked = rows.withColumn("_nw_rank", rank)
    joined = ranked.join(firsts, F.col(group).eqNullSafe(F.col("_nw_group")) & (F.col("_nw_bucket") == F.col("_nw_at")))
    return joined.withColumn(out, (F.col("_nw_first") + F.col("_nw_rank") - 1).cast("long")).drop(
        "_nw_bucket", "_nw_rank", "_nw_group", "_nw_at", "_nw_first"
    )


def assign_shards(df: DataFrame, key: str, shards: int, column: str = "shard") -> DataFrame:
    """`df` with `column` (its shard) and `grown_<column>` (its shard if there were one more)."""
    return df.withColumns({column: jump_shard(F.col(key), shards), f"grown_{column}": jump_shard(F.col(key), shards + 1)})


def write_shards(df: DataFrame, key: str, shards: int, path: str, max_rows: int = 1_000_000) -> None:
    """Writes `df` as one folder per shard. A shard is written by as many tasks as it needs."""
    placed = df.withColumn("shard", jump_shard(F.col(key), shards))
    placed.repartition(F.col("shard"), F.pmod(F.xxhash64(key), F.lit(8))).write.option("maxRecordsPerFile", max_rows).partitionBy("shard").mode("overwrite").parquet(path)


def shard_documents(spark: SparkSession, docs: DataFrame, shards: int = 24) -> DataFrame:
    """Per document: doc_id, size (UTF-8 bytes + 8), text_crc32, law `key`, shard, slot and grown_shard.

    A null text has no bytes. Rows that repeat get slots of their own.
    """
    scratch = Scratch(spark, "shards")
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"], (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = scratch.keep(assign_shards(rows, "doc_id", shards), "rows")
    numbered = number_within(rows, "shard", ["doc_id", "text_crc32", "size"], "slot", scratch)
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
