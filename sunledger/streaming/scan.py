"""Incremental scans: batches of landed records against a stored state, as one scan would have it.

The state of a scan is a versioned table with a row for each URL: what the directory has stored of it,
and the first record of this scan that failed a gate and that passed. Minima merge over batches, so batches
give what one scan over all of them gives. A batch opens only the buckets that its own URLs fall into.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.dedup import scan_dedup, scan_minima
from ..operators.staging import stage
from ..operators.versions import VersionedTable

STATE = "source_url string, stored_id long, stored_date date, first_fail long, first_pass long"


def open_state(spark: SparkSession, path: str, stored: DataFrame | None = None, buckets: int = 64) -> VersionedTable:
    """The state in `path`, or a new one in which the directory has `stored` (source_url, stored_id, stored_date)."""
    table = VersionedTable(spark, path)
    if table.versions():
        return table
    rows = spark.createDataFrame([], STATE)
    if stored is not None:
        none = F.lit(None).cast("long")
        rows = stored.select("source_url", F.col("stored_id").cast("long").alias("stored_id"), "stored_date", none.alias("first_fail"), none.alias("first_pass"))
    return VersionedTable.create(spark, path, rows, "source_url", buckets)


def next_scan(state: VersionedTable) -> None:
    """A new scan begins: minima are forgotten, and what passed as new counts as stored. All buckets are rewritten."""
    rows = state.snapshot()
    known = F.col("stored_id").isNotNull() | F.col("first_pass").isNotNull()
    none = F.lit(None).cast("long")
    state.reload(stage(rows.filter(known).withColumns({"stored_id": F.coalesce("stored_id", "first_pass"), "first_fail": none, "first_pass": none})))


def scan_batch(state: VersionedTable, rows: DataFrame, batch: str, out: str, date_from: Column | None = None, date_to: Column | None = None) -> int:
    """One batch (source_url, ord, gate_ok, announced_date): writes its records with what became of them to `out`, and
    the state's next version; how many files of the state were read. `ord` goes on from batch to batch.

    A batch that is run again before its commit overwrites its own output; after its commit the state has its
    minima already, and they are not taken into account twice, as a record's own ord is no earlier one."""
    rows = stage(rows)
    spark, manifest = rows.sparkSession, state.manifest()
    urls = rows.select(F.nullif("source_url", F.lit("")).alias("source_url")).filter("source_url is not null")
    touched = {r[0] for r in urls.select(state.bucket(F.col("source_url"), manifest)).distinct().collect()}
    files = state.files(manifest, touched)
    known = state.read(manifest, files)
    deduped = scan_dedup(rows, known.filter("stored_id is not null"), date_from, date_to, known.select("source_url", "first_fail", "first_pass"))
    deduped.write.mode("overwrite").parquet(out)
    minima = scan_minima(spark.read.parquet(out)).select(F.col("source_url").alias("_u"), F.col("first_fail").alias("_f"), F.col("first_pass").alias("_p"))

    def merged(old: DataFrame) -> DataFrame:
        both = old.join(minima, F.col("source_url") == F.col("_u"), "full_outer")
        return both.select(F.coalesce("source_url", "_u").alias("source_url"), "stored_id", "stored_date", F.least("first_fail", "_f").alias("first_fail"), F.least("first_pass", "_p").alias("first_pass"))

    state.commit(urls, merged, manifest, batch)
    return len(files)


def incremental_scan(
    spark: SparkSession, landing: str, schema: StructType, state: VersionedTable, out: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
    date_from: Column | None = None, date_to: Column | None = None, files_per_batch: int = 1000,
) -> StreamingQuery:
    """Reads files that are new under `landing`; each batch goes through `scan_batch` into a folder named after its number."""

    def write(batch: DataFrame, number: int) -> None:
        scan_batch(state, prepare(batch), f"{checkpoint}#{number}", f"{out}/batch={number}", date_from, date_to)

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
