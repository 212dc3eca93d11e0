"""The public directory: filters, list, statistics and CSV export."""

from __future__ import annotations

import datetime
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_field

if TYPE_CHECKING:
    from .versions import VersionedTable


@dataclass(frozen=True)
class DirectoryQuery:
    """What a visitor asks for. `has_contact` is as it came: any non-empty text, "false" too, filters."""

    country: str | None = None
    search: str | None = None
    date_from: datetime.date | None = None
    date_to: datetime.date | None = None
    scan_id: int | None = None
    has_contact: str | bool | None = None


def permanent_filters() -> Column:
    """No wind, the two countries, and a capacity that is unknown (0) or at least 5."""
    capacity = F.col("capacity_mw")
    return ~F.col("name").ilike("%wind%") & F.col("country").isin("AU", "NZ") & ((capacity == 0) | (capacity >= 5))


def like_pattern(search: str) -> str:
    """A search text as an ILIKE pattern; % and _ stay wildcards, other backslashes are themselves."""
    out, i = [], 0
    while i < len(search):
        if search[i] == "\\" and (i + 1 == len(search) or search[i + 1] not in "%_\\"):
            out.append("\\\\")
        elif search[i] == "\\":
            out.append(search[i : i + 2])
            i += 1
        else:
            out.append(search[i])
        i += 1
    return f"%{''.join(out)}%"


def search_filter(search: str, columns: tuple[str, ...]) -> Column:
    """Whether any of the columns holds the text; null columns don't."""
    found = F.lit(False)
    for c in columns:
        found |= F.coalesce(F.col(c).ilike(like_pattern(search)), F.lit(False))
    return found


def directory_filter(query: DirectoryQuery) -> Column:
    keep = permanent_filters()
    if query.date_from:
        keep &= F.col("announced_date") >= F.lit(query.date_from)
    if query.date_to:
        keep &= F.col("announced_date") <= F.lit(query.date_to)
    if query.country and query.country != "ALL":
        keep &= F.col("country") == query.country
    if query.search:
        keep &= search_filter(query.search, ("name", "developer", "location", "epc"))
    if query.scan_id is not None:
        keep &= F.col("scan_id") == query.scan_id
    if query.has_contact:
        keep &= F.col("contact_email").isNotNull()
    return keep


def directory_list(projects: DataFrame, query: DirectoryQuery) -> DataFrame:
    """Newest first; equal dates by id."""
    return projects.filter(directory_filter(query)).orderBy(F.col("announced_date").desc(), "id")


def asked_ranges(query: DirectoryQuery) -> dict[str, tuple]:
    """For columns of the directory, the (least, greatest) that a row of the list can have; None is open."""
    one = query.country if query.country and query.country != "ALL" else None
    found = {"country": (one or "AU", one or "NZ"), "capacity_mw": (0, None)}
    if query.date_from or query.date_to:
        found["announced_date"] = (query.date_from, query.date_to)
    if query.scan_id is not None:
        found["scan_id"] = (query.scan_id, query.scan_id)
    return found


def stored_list(table: VersionedTable, query: DirectoryQuery, version: int | None = None) -> DataFrame:
    """The list out of a stored directory; only files that may have rows of it are opened. Most are left out where the
    table is clustered by date, capacity and country."""
    manifest = table.manifest(version)
    return directory_list(table.read(manifest, table.files(manifest, None, **asked_ranges(query))), query)


def directory_stats(projects: DataFrame, query: DirectoryQuery, today: datetime.date) -> DataFrame:
    """total, total_capacity_mw, recent_count, by_country and by_status in one pass over the rows.

    Counts per country and status are summed once more from at most a few groups."""
    rows = projects.filter(directory_filter(query))
    cells = rows.groupBy("country", "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("capacity_mw").alias("mw"),
        F.count_if(F.col("announced_date") >= F.date_sub(F.lit(today), 7)).alias("recent"),
    )

    def counts(key: str) -> Column:
        some = F.collect_list(F.struct(key, "n"))
        keys = F.array_sort(F.array_distinct(F.transform(some, lambda x: x[key])))
        total = lambda k: F.aggregate(F.filter(some, lambda x: x[key] == k), F.lit(0).cast("long"), lambda a, x: a + x["n"])
        return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, total(k))))

    return cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("mw"), F.lit(0)).cast("decimal(38,2)").alias("total_capacity_mw"),
        F.coalesce(F.sum("recent"), F.lit(0)).alias("recent_count"), counts("country").alias("by_country"), counts("status").alias("by_status"),
    )


def stats_rows(projects: DataFrame, keep: Column, today: datetime.date) -> DataFrame:
    """The same figures as rows (dimension, value, n, capacity_mw, recent_count), by grouping sets."""
    rows = projects.filter(keep)
    sets = rows.groupingSets([[], [F.col("country")], [F.col("status")]], "country", "status").agg(
        F.grouping_id("country", "status").alias("g"), F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("capacity_mw"), F.lit(0)).cast("decimal(38,2)").alias("capacity_mw"),
        F.count_if(F.col("announced_date") >= F.date_sub(F.lit(today), 7)).alias("recent_count"),
    )
    dimension = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "country").otherwise("status")
    return sets.select(dimension.alias("dimension"), F.coalesce("country", "status", F.lit("")).alias("value"), "n", "capacity_mw", "recent_count")


def csv_lines(df: DataFrame, columns: list[str], header: list[str] | None = None) -> DataFrame:
    """`df` with `line`, its CSV line; with `header` also the row of names (ord 0 before ord 1)."""
    lines = df.withColumn("line", F.concat_ws(",", *(csv_field(F.col(c)) for c in columns)))
    if header is None:
        return lines
    first = df.sparkSession.createDataFrame([(0, ",".join(header))], "ord int, line string")
    return first.unionByName(lines.select(F.lit(1).alias("ord"), "line"))
