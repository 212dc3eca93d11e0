"""What keeps a parsed record out of the project table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .dedup import keep_first


def gate_ok(name: Column, description: Column, country: Column, capacity_mw: Column) -> Column:
    """Gates 1 to 5: no article name, one of the two countries, a capacity, no wind, some solar."""
    return F.coalesce(
        ~X.is_noisy_name(name) & country.isin("AU", "NZ") & capacity_mw.isNotNull()
        & ~X.is_wind(name, description) & X.has_solar_component(name, description),
        F.lit(False),
    )


def with_gates(records: DataFrame) -> DataFrame:
    return records.withColumn("gate_ok", gate_ok(F.col("name"), F.col("description"), F.col("country"), F.col("capacity_mw")))


def scan_sources(branches: list[DataFrame]) -> DataFrame:
    """Records of several sources as one scan sees them: with gate_ok, the source's number (`branch`), and as `ord`
    the struct (branch, ord, table_pos, pos), by which they come one after another. Branches have ord, pos, name,
    description, capacity_mw, source_url and announced_date; table_pos defaults to 0, country to AU."""
    columns = ("name", "description", "capacity_mw", "source_url", "announced_date", "country")
    parts = []
    for i, df in enumerate(branches):
        df = df.withColumns({c: F.lit(v) for c, v in (("table_pos", 0), ("country", "AU")) if c not in df.columns})
        order = F.struct(F.lit(i).alias("branch"), F.col("ord").cast("long").alias("ord"), F.col("table_pos").cast("int").alias("table_pos"), F.col("pos").cast("int").alias("pos"))
        parts.append(df.select(F.lit(i).alias("branch"), order.alias("ord"), *columns))
    both = parts[0]
    for df in parts[1:]:
        both = both.unionByName(df)
    return with_gates(both)


def first_of_source(branches: list[DataFrame], answers: DataFrame | None = None, source: str = "source") -> DataFrame:
    """Records of each source from its branches in their order (feed, then pages), the first of each URL; `answers`
    only for sources that have none. All have ord, pos and source_url; columns that a branch lacks are null."""
    numbered = [df.withColumn("_branch", F.lit(i)) for i, df in enumerate(branches)]
    both = numbered[0]
    for df in numbered[1:]:
        both = both.unionByName(df, allowMissingColumns=True)
    order = [c for c in ("_branch", "ord", "table_pos", "pos") if c in both.columns]
    url = F.coalesce("source_url", F.lit(""))  # records without URL are one, too
    found = keep_first(both.withColumn("_url", url), [source, "_url"], order)
    if answers is not None:
        have = both.select(F.col(source).alias("_have")).distinct()
        rest = answers.join(have, F.col(source) == F.col("_have"), "left_anti").withColumn("_url", url)
        found = found.unionByName(keep_first(rest, [source, "_url"], ["ord", "pos"]), allowMissingColumns=True)
    return found.drop("_branch", "_url")


def date_gate(parsed: Column, date: Column, date_from: Column | None, date_to: Column | None) -> Column:
    """The parsers' window: an unread date fails as soon as there is a bound."""
    keep = F.lit(True)
    if date_from is not None:
        keep &= parsed & (date >= date_from)
    if date_to is not None:
        keep &= parsed & (date <= date_to)
    return F.coalesce(keep, F.lit(False))
