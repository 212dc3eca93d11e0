"""Every query of the library proper against DuckDB on the same tables."""

from __future__ import annotations

import decimal

import duckdb
import pandas as pd
import pytest

from sunledger.plans import catalogue, places, screens  # noqa: F401  (places and screens add their queries)

TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows(df):
    def plain(v):
        if v is None or pd.isna(v):
            return "None"
        if isinstance(v, (float, decimal.Decimal)):
            return f"{float(v):.4f}"
        return str(v).replace(" 00:00:00", "")

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, duck, name):
    ours = catalogue.QUERIES[name](spark, sf_dir).toPandas()
    theirs = duck.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_organisation_is_a_candidate(spark, sf_dir):
    found = [int(r["contact_email"][1:].split("@")[0]) for r in catalogue.QUERIES["contact_top1"](spark, sf_dir).collect()]
    assert any(n % 20 for n in found)


def test_long_pages_keep_all_their_text(spark, sf_dir):
    longest = max(len(r["body"]) for r in catalogue.QUERIES["html_text_whole"](spark, sf_dir).collect())
    assert longest > 1000
