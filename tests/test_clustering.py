"""Stored tables whose files are narrow in several columns."""

from __future__ import annotations

import datetime
import decimal

from pyspark.sql import functions as F

from sunledger.operators.directory import DirectoryQuery, directory_list, stored_list
from sunledger.operators.versions import VersionedTable
from sunledger.plans import catalogue

CLUSTER = ("announced_date", "capacity_mw", "country")
ROWS = "id long, announced_date date, capacity_mw decimal(10,2), country string, name string"


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_files_of_a_month(spark, sf_dir, tmp_path):
    """Ranges of each clustered column open few files, and lists are what they are without pruning."""
    rows = catalogue.projects(spark, sf_dir)
    table = VersionedTable.create(spark, str(tmp_path / "t"), rows, "id", buckets=1, cluster=CLUSTER, file_rows=100)
    manifest = table.manifest()
    everything = len(manifest.files)
    assert everything >= 50 and sum(f.rows for f in manifest.files) == rows.count() and max(f.rows for f in manifest.files) <= 100
    month = (datetime.date(1996, 3, 1), datetime.date(1996, 3, 31))
    opened = lambda **ranges: len(table.files(manifest, None, **ranges))
    assert opened(announced_date=month) < everything / 3
    assert opened(announced_date=month, country=("NZ", "NZ")) < everything / 4
    assert opened(capacity_mw=(decimal.Decimal("9"), None)) < everything / 2
    for asked in (DirectoryQuery("NZ", None, *month), DirectoryQuery(None, None, *month), DirectoryQuery("AU", "re", month[0]), DirectoryQuery(scan_id=3), DirectoryQuery("ALL")):
        assert ids(stored_list(table, asked)) == ids(directory_list(rows, asked))


def test_bounds_hold_after_commits(spark, tmp_path):
    """Nulls, ties, repeated rows, texts that are equal in their first bytes, and values beyond all cuts."""
    day = datetime.date(2024, 1, 1)
    rows = [(i, day + datetime.timedelta(i % 30) if i % 7 else None, decimal.Decimal(i % 5) / 10 if i % 11 else None, [None, "", "AU", "australia-a", "australia-b", "é"][i % 6], "x") for i in range(300)]
    table = VersionedTable.create(spark, str(tmp_path / "t"), spark.createDataFrame(rows + rows[:3], ROWS), "id", 3, cluster=CLUSTER, file_rows=10)
    far = [(5, datetime.date(1900, 1, 1), decimal.Decimal("99999999.99"), "zz", "y"), (1000, datetime.date(2999, 1, 1), decimal.Decimal("-5"), "\U0001f600", "y")]
    table.upsert(spark.createDataFrame(far, ROWS), ("announced_date", "capacity_mw", "country"), ["id"])
    for f in table.manifest().files:
        assert f.rows <= 10 and set(f.bounds) == {"id", *CLUSTER}
    whole = table.snapshot()
    for ranges in (
        {"announced_date": (day, day)}, {"announced_date": (None, datetime.date(1900, 1, 1))}, {"capacity_mw": (decimal.Decimal("0.3"), decimal.Decimal("0.3"))},
        {"capacity_mw": (decimal.Decimal("99999999.99"), None)}, {"country": ("australia-b", "australia-b")}, {"country": ("zz", None)}, {"announced_date": (day, None), "country": ("é", "é")},
    ):
        keep = F.lit(True)
        for c, (low, high) in ranges.items():
            keep &= F.col(c).between(F.lit(low), F.lit(high)) if low is not None and high is not None else F.col(c) >= F.lit(low) if low is not None else F.col(c) <= F.lit(high)
        assert ids(table.snapshot(**ranges)) == ids(whole.filter(keep)) != []


def test_empty_and_all_null(spark, tmp_path):
    table = VersionedTable.create(spark, str(tmp_path / "none"), spark.createDataFrame([], ROWS), "id", 2, cluster=CLUSTER)
    assert table.snapshot().count() == 0
    table.upsert(spark.createDataFrame([(1, None, None, None, "x")], ROWS), ("name",), ["id"])
    assert ids(table.snapshot()) == [1] and ids(table.snapshot(country=("AU", "AU"))) == []


def test_a_bucket_is_written_by_many_tasks(spark, tmp_path):
    """One bucket is dealt over tasks by ranges of the order, and rows with equal places too; files are no smaller than cells."""
    day = datetime.date(2024, 1, 1)
    rows = spark.createDataFrame([(i, day + datetime.timedelta(i % 30), decimal.Decimal(i % 5), "AU", "x") for i in range(400)], ROWS)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        many = VersionedTable.create(spark, str(tmp_path / "many"), rows, "id", 1, cluster=CLUSTER, file_rows=10).manifest()
        alike = VersionedTable.create(spark, str(tmp_path / "alike"), rows, "id", 1, cluster=("country",), file_rows=10).manifest()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tasks = lambda manifest: len({f.path.split("/part-")[1][:5] for f in manifest.files})
    assert tasks(many) == tasks(alike) == 4 and sum(f.rows for f in many.files) == sum(f.rows for f in alike.files) == 400
    assert max(f.rows for f in many.files) <= 10 and len(alike.files) == 4
