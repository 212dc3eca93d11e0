"""Row numbers without gaps, and joins by position, with no single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage


def number_rows(df: DataFrame, order: list[str], out: str = "id", start: int = 1) -> DataFrame:
    """`df` with `out`: start, start + 1, ... by `order`, nulls first. Rows are dealt into ranges of the order and sorted
    in each; a range begins where the counts of those before it end. Counts are a row for each range."""
    # what says where a row lies is fixed once, so a lost executor can't number rows anew
    rows = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    ranges = F.shiftright("_at", 33).cast("int")
    counts = sorted((r[0], r[1]) for r in rows.groupBy(ranges.alias("range")).count().collect())
    firsts, before = [], start
    for number, n in counts:
        firsts.append((number, before))
        before += n
    table = df.sparkSession.createDataFrame(firsts, "_range int, _first long")
    placed = rows.withColumn("_in", ranges).join(F.broadcast(table), F.col("_in") == F.col("_range"))
    return placed.withColumn(out, F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_in", "_range", "_first")


def zip_rows(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """The i-th row of one table with the i-th of the other, each by its order; what has no partner goes."""
    return number_rows(left, left_order, "_i").join(number_rows(right, right_order, "_i"), "_i").drop("_i")


def in_batches(df: DataFrame, order: list[str], size: int = 100) -> DataFrame:
    """`df` with batch and pos: batches of `size` rows by `order`, both from 0."""
    numbered = number_rows(df, order, "_i", 0)
    return numbered.withColumns({"batch": F.floor(F.col("_i") / size), "pos": (F.col("_i") % size).cast("int")}).drop("_i")
