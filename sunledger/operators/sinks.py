"""What a change makes of a table's rows, and plain writers. `versions` commits changes to stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """Overwrites a table that `df` does not read."""
    df.write.mode("overwrite").parquet(path)


def update_by_key(stored: DataFrame, changes: DataFrame, key: str, columns: tuple[str, ...], order: str | None = None, now: Column | None = None) -> DataFrame:
    """Given columns take the changes' values where there are any; others and other rows stay. Of several
    changes of a key the last by `order` counts (without `order`, the greatest of their values); changed
    rows get `now` as updated_at, where the table has that column."""
    value = F.struct(*columns)
    new = changes.groupBy(F.col(key).alias("_k")).agg((F.max_by(value, order) if order else F.max(value)).alias("_new"))
    joined = stored.join(new, F.col(key) == F.col("_k"), "left")
    out = {c: F.coalesce(f"_new.{c}", c) for c in columns}
    if "updated_at" in stored.columns and now is not None:
        out["updated_at"] = F.when(F.col("_k").isNotNull(), now.cast(stored.schema["updated_at"].dataType)).otherwise(F.col("updated_at"))
    return joined.withColumns(out).select(*stored.columns)


def delete_by_key(stored: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return stored.join(keys.select(key).distinct(), key, "left_anti")


def write_csv_text(lines: DataFrame, path: str, column: str = "line") -> None:
    """Prepared CSV lines as text files."""
    lines.select(column).write.mode("overwrite").text(path)


def json_rows(df: DataFrame) -> DataFrame:
    """Rows as JSON text, decimals as numbers and timestamps in ISO form with Z."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f.name)
        out.append((c.cast("double") if kind.startswith("decimal") else F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if kind.startswith("timestamp") else c).alias(f.name))
    return df.select(F.to_json(F.struct(*out)).alias("json"))
