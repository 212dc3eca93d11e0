"""Joins in which one key may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: So many of the most frequent keys are broadcast; no other key has more than one in so many rows.
HOT = 1_000


def join_frequent(rows: DataFrame, keyed: DataFrame, key: str, count: str, spread: Column, hot: int = HOT) -> DataFrame:
    """`rows`, each with the columns of its key's row in `keyed` (null, if there is none).

    `keyed` has one row for each key and in `count` how many rows have it. Its `hot` most frequent keys
    are broadcast, so whatever the data at most so many rows. What they match takes no part in the
    shuffled join: there it has keys of its own, spread by `spread`, that no other row has.
    """
    others = [c for c in keyed.columns if c not in (key, count)]
    first = F.broadcast(keyed.orderBy(F.desc(count), key).limit(hot).select(F.col(key).alias("_hot"), F.struct(*others).alias("_near")))
    rest = keyed.join(first, F.col(key) == F.col("_hot"), "left_anti").select(F.col(key).alias("_key"), F.struct(*others).alias("_far"))
    known = rows.join(first, F.col(key) == F.col("_hot"), "left")
    apart = F.when(F.col(key).isNull() | F.col("_hot").isNotNull(), F.concat(F.lit("\u0001"), F.xxhash64(spread).cast("string"))).otherwise(F.col(key))
    both = known.withColumn("_meet", apart).join(rest, F.col("_meet") == F.col("_key"), "left")
    out = both.withColumns({c: F.coalesce(F.col(f"_near.{c}"), F.col(f"_far.{c}")) for c in others})
    return out.drop("_hot", "_near", "_meet", "_key", "_far")
