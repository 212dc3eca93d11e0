"""The log of scans and enrichment runs: one row appended per change of state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STALE = "Interrupted by a restart"


def latest(log: DataFrame, key: str = "run_id", order: str = "at") -> DataFrame:
    """The last row of each run. Maxima are taken before the shuffle; no sort."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(key, "x.*")


def run_label(run_id: Column) -> Column:
    """RUN- and the number, with four digits at least."""
    return F.format_string("RUN-%04d", run_id)


def newest_first(scans: DataFrame) -> DataFrame:
    """Scans, the one that began last first; of equal starts the later id."""
    return scans.orderBy(F.col("started_at").desc(), F.col("id").desc())


def new_first(projects: DataFrame, order: str) -> DataFrame:
    """A scan's projects, new ones first, otherwise in their order."""
    return projects.orderBy(F.col("is_new").desc(), order)


def new_counts(relations: DataFrame) -> DataFrame:
    """Per scan: how many of its projects were new."""
    return relations.groupBy("scan_id").agg(F.count_if("is_new").alias("new_count"))


def recover(runs: DataFrame, message: str = STALE) -> DataFrame:
    """Runs still marked as running when a session starts have failed."""
    stale = F.col("status") == "running"
    return runs.withColumns({"error_message": F.when(stale, message).otherwise(F.col("error_message")), "status": F.when(stale, "failed").otherwise(F.col("status"))})


def scan_projects(relations: DataFrame, projects: DataFrame, scan_id: object) -> DataFrame:
    """Projects of a scan with is_new. Scans from before relations were kept have none: theirs are
    the projects that carry the scan's id, all new. With relations, a capacity of at least 5 is
    required, and the last relation of a project decides is_new."""
    own = relations.filter(F.col("scan_id") == scan_id)
    flags = own.groupBy("project_id").agg(F.coalesce(F.max_by("is_new", "id"), F.lit(False)).alias("is_new"))
    related = projects.filter(F.col("capacity_mw") >= 5).join(flags, F.col("id") == F.col("project_id")).drop("project_id")
    old = projects.filter(F.col("scan_id") == scan_id).withColumn("is_new", F.lit(True))
    none = own.limit(1).agg((F.count(F.lit(1)) == 0).alias("_none"))  # one row
    old = old.join(F.broadcast(none), F.col("_none")).drop("_none")
    return related.select(*projects.columns, "is_new").unionByName(old.select(*projects.columns, "is_new"))


def run_changes(log: DataFrame, key: str = "run_id", order: str = "at") -> DataFrame:
    """The log with `valid`: whether a change may follow the one before it. A run begins as running, says so again
    with its progress, and ends once, as completed or failed. Runs have few changes, so each is ordered by itself."""
    before = F.lag("status").over(Window.partitionBy(key).orderBy(order))
    begins, goes_on = before.isNull() & (F.col("status") == "running"), (before == "running") & F.col("status").isin("running", "completed", "failed")
    return log.withColumn("valid", F.coalesce(begins | goes_on, F.lit(False)))
