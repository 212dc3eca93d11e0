"""Joins in which one key may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than one in so many rows, so there are fewer hot keys than this.
SHARES = 1_000


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int, shares: int = SHARES) -> DataFrame:
    """`rows` with the columns of `keyed`, which has one row for each (non-null) key of `rows` and in `count` how
    many of the `total` rows have it.

    Keys with more than total / shares rows are fewer than `shares` whatever the data, so these are
    broadcast; the others meet in a shuffled join, where no key has more than total / shares rows. Both
    tables are read twice: they should be written ones.
    """
    is_hot = F.col(count) * shares > total
    hot = F.broadcast(keyed.filter(is_hot))
    rest = rows.join(F.broadcast(keyed.filter(is_hot).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(keyed.filter(~is_hot), key))
