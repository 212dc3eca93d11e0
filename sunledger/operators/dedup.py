"""Order-aware deduplication. Order is a column, never the order in which rows happen to lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import join_frequent


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key; the planner narrows groups down before they are shuffled."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_first", first).filter("_first = 1").drop("_first")


def last_by(df: DataFrame, keys: list[str], values: list[str], order: str) -> DataFrame:
    """The values of the last row of each key."""
    return df.groupBy(*keys).agg(*(F.max_by(v, order).alias(v) for v in values))


def scan_dedup(rows: DataFrame, stored: DataFrame | None, date_from: Column | None = None, date_to: Column | None = None, state: DataFrame | None = None) -> DataFrame:
    """Which records of a scan are new, known or barred.

    `rows` has source_url, ord (anything that can be ordered, structs too), gate_ok and announced_date; `stored`
    has source_url, stored_id and stored_date, one row per URL. A record passes when it is through the gates and
    its date, the stored one if the URL is known, lies in the window. It is new unless its URL is stored, passed
    before, or failed a gate before: a failed record bars its URL for the rest of the scan, even
    where it was stored. Records without URL are always new.

    What happened before a record follows from two minima of its URL: the first ord that failed a gate and the
    first that passed. They are partial aggregates joined back, so nothing is sorted within a URL and a URL
    may have any share of the rows. `state` (source_url, first_fail, first_pass) has the minima of earlier
    batches of the same scan. Rows are read twice: pass a written table if they cost much.

    Adds eff_date, passes, is_new, prior_fail, first_pass (the ord of the record that made the
    project) and project_ref: 'new', 'barred', 'stored' or 'created'.
    """
    known = rows.withColumn("source_url", F.nullif("source_url", F.lit("")))
    urls = known.filter("source_url is not null").groupBy("source_url").agg(F.count(F.lit(1)).alias("_n"))
    if stored is not None:
        dates = stored.select("source_url", "stored_id", "stored_date")
        known = join_frequent(known, urls.join(dates, "source_url"), "source_url", "_n", F.col("ord"))
    else:
        known = known.withColumns({"stored_id": F.lit(None).cast("long"), "stored_date": F.lit(None).cast("date")})
    known = known.withColumn("eff_date", F.coalesce("stored_date", "announced_date"))
    inside = F.lit(True)
    if date_from is not None:
        inside &= F.col("eff_date") >= date_from
    if date_to is not None:
        inside &= F.col("eff_date") <= date_to
    known = known.withColumn("passes", F.col("gate_ok") & F.coalesce(inside, F.lit(False)))
    before = scan_minima(known)
    if state is not None:
        before = merge_minima(before, state)
    seen = join_frequent(known, before.withColumnsRenamed({"first_fail": "_fail", "first_pass": "_pass"}), "source_url", "_n", F.col("ord"))
    seen = seen.withColumns({
        "prior_fail": F.coalesce(F.col("_fail") < F.col("ord"), F.lit(False)),
        "first_pass": F.when(F.col("_pass") < F.col("ord"), F.col("_pass")),
    }).drop("_fail", "_pass")
    is_new = F.col("source_url").isNull() | (F.col("stored_id").isNull() & ~F.col("prior_fail") & F.col("first_pass").isNull())
    ref = F.when(is_new, "new").when(F.col("prior_fail"), "barred").when(F.col("stored_id").isNotNull(), "stored").otherwise("created")
    return seen.withColumns({"is_new": is_new, "project_ref": ref})


def scan_minima(rows: DataFrame) -> DataFrame:
    """Per URL: first_fail and first_pass (the least ord that failed a gate, and that passed), and _n rows."""
    least = lambda when: F.min(F.when(when, F.col("ord")))
    return rows.filter("source_url is not null").groupBy("source_url").agg(
        least(~F.col("gate_ok")).alias("first_fail"), least(F.col("passes")).alias("first_pass"), F.count(F.lit(1)).alias("_n")
    )


def merge_minima(new: DataFrame, state: DataFrame) -> DataFrame:
    """`new` with the least of its minima and those of `state`: minima merge, however the rows were cut into batches."""
    old = state.select(F.col("source_url").alias("_u"), F.col("first_fail").alias("_of"), F.col("first_pass").alias("_op"))
    both = new.join(old, F.col("source_url") == F.col("_u"), "left")
    return both.withColumns({"first_fail": F.least("first_fail", "_of"), "first_pass": F.least("first_pass", "_op")}).select(*new.columns)


def scan_counters(deduped: DataFrame) -> DataFrame:
    """projects_found (every passing record, repeats too) and new_projects."""
    return deduped.agg(F.count_if("passes").alias("projects_found"), F.count_if(F.col("passes") & F.col("is_new")).alias("new_projects"))
