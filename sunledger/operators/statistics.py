"""Directory statistics kept up to date by the changes of commits.

The state has a row for each country, status and day: how many projects, and their capacity. A change adds the
new rows' cells and takes the old rows' away, so the figures, the moving seven days too, follow from the
changes without reading the directory.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ("country", "status", "announced_date")


def cells(rows: DataFrame, keep: Column, sign: int = 1) -> DataFrame:
    """(country, status, announced_date, n, mw) of the rows that a visitor sees, taken away if `sign` is -1."""
    return rows.filter(keep).groupBy(*CELL).agg((F.count(F.lit(1)) * sign).alias("n"), (F.coalesce(F.sum("capacity_mw"), F.lit(0)) * sign).cast("decimal(38,2)").alias("mw"))


def change_cells(old: DataFrame, new: DataFrame, keep: Column) -> DataFrame:
    """What changes of rows do to the cells: `old` are changed and deleted rows as they were, `new` changed and new ones as
    they are. Many changes of one cell are one row."""
    return merge(cells(old, keep, -1), cells(new, keep))


def merge(*parts: DataFrame) -> DataFrame:
    """Cells of several states or changes together; cells without any project go."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(*CELL).agg(F.sum("n").alias("n"), F.sum("mw").cast("decimal(38,2)").alias("mw")).filter("n <> 0 or mw <> 0")


def figures(state: DataFrame, today: datetime.date) -> DataFrame:
    """(dimension, value, n, capacity_mw, recent_count) as `directory.stats_rows` counts them from the projects."""
    recent = F.when(F.col("announced_date") >= F.date_sub(F.lit(today), 7), F.col("n")).otherwise(0)
    sets = state.groupingSets([[], [F.col("country")], [F.col("status")]], "country", "status").agg(
        F.grouping_id("country", "status").alias("g"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("mw"), F.lit(0)).cast("decimal(38,2)").alias("capacity_mw"), F.coalesce(F.sum(recent), F.lit(0)).alias("recent_count"),
    )
    dimension = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "country").otherwise("status")
    return sets.select(dimension.alias("dimension"), F.coalesce("country", "status", F.lit("")).alias("value"), "n", "capacity_mw", "recent_count")
