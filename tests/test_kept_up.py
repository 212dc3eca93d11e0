"""Numbers, positions, searches and statistics that are kept up to date; plain writers."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from sunledger.operators import directory, enrichment, sinks, statistics
from sunledger.operators.numbering import in_batches, number_rows, zip_rows
from sunledger.operators.search import frequencies, pieces, post, search


def test_numbers_have_no_gaps(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(20)]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b long").repartition(7)
    numbered = number_rows(df, ["a", "b"])
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r["a"], r["b"]) for r in sorted(numbered.collect(), key=lambda r: r["id"])] == want
    assert sorted(r["id"] for r in numbered.collect()) == list(range(1, 501))
    assert "SinglePartition" not in numbered._jdf.queryExecution().executedPlan().toString()
    assert number_rows(df.limit(0), ["a"]).count() == 0
    got = in_batches(df, ["b"], 100).collect()
    assert all((r["batch"], r["pos"]) == divmod(r["b"], 100) for r in got)


def test_zip_by_position(spark):
    left, right = spark.createDataFrame([(i, f"l{i}") for i in (5, 3, 9)], "k int, l string"), spark.createDataFrame([(i, f"r{i}") for i in (40, 10, 30, 20)], "o int, r string")
    assert sorted((r["l"], r["r"]) for r in zip_rows(left, right, ["k"], ["o"]).collect()) == [("l3", "r10"), ("l5", "r20"), ("l9", "r30")]


WORDS = ["Sunny", "Süd", "50%", "a_b", "plains", "PLAINS", "x", "\\n", "solar", "farm"]


@pytest.mark.parametrize("text", ["plains", "PLA", "su", "%", "_", "a\\_b", "a_b", "50\\%", "50%farm", "lar fa", "süd", "\\n", "nowhere", "pl_ins", "x\\", "solar%sunny", ""])
def test_search_as_a_scan_has_it(spark, text):
    rng = random.Random(3)
    rows = spark.createDataFrame([(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(5))), rng.choice([None, "Solar farm", "plains"])) for i in range(150)], "k long, a string, b string")
    postings = post(rows, "k", ("a", "b"))
    want = {r["k"] for r in rows.filter(directory.search_filter(text, ("a", "b"))).collect()}
    assert {r["k"] for r in search(rows, postings, frequencies(postings), "k", ("a", "b"), text).collect()} == want


def test_rare_words_read_few_postings(spark):
    """A search for a rare word reads a hundredth of the postings, and verifies the one row that has it."""
    rows = spark.range(5000).select(F.col("id").alias("k"), F.concat(F.lit("common words of all "), F.when(F.col("id") == 77, "Zyxwvut").otherwise("others")).alias("a"))
    postings = post(rows, "k", ("a",))
    grams = {p[i : i + 3] for p in pieces("Zyxwvut") for i in range(len(p) - 2)}
    assert postings.filter(F.col("gram").isin(list(grams))).count() < postings.count() / 100
    assert [r["k"] for r in search(rows, postings, frequencies(postings), "k", ("a",), "words of all zyx").collect()] == [77]


def test_statistics_follow_changes(spark):
    rng, day = random.Random(4), datetime.date(2024, 3, 1)
    kind = "id int, name string, country string, status string, capacity_mw decimal(10,2), announced_date date"
    make = lambda i: (i, rng.choice(["Solar", "Wind farm"]), rng.choice(["AU", "NZ", "US", None]), rng.choice(["a", "b", None]), rng.choice([None, 0, 3, 7, 50]), rng.choice([None, day, day - datetime.timedelta(rng.randrange(20))]))
    frame = lambda rows: spark.createDataFrame([(*r[:4], None if r[4] is None else __import__("decimal").Decimal(r[4]), r[5]) for r in rows], kind)
    keep, table = directory.permanent_filters(), {i: make(i) for i in range(120)}
    state = spark.createDataFrame(statistics.cells(frame(table.values()), keep).toArrow())
    for _ in range(3):
        ids = rng.sample(sorted(table), 40)
        old, new = [table[i] for i in ids], [make(i) for i in ids[:25]] + [make(1000 + rng.randrange(10**6)) for _ in range(10)]
        table = {k: v for k, v in table.items() if k not in ids} | {r[0]: r for r in new}
        state = spark.createDataFrame(statistics.merge(state, statistics.change_cells(frame(old), frame(new), keep)).toArrow())
        for today in (day, day + datetime.timedelta(5)):
            want = directory.stats_rows(frame(table.values()), keep, today)
            assert sorted(map(str, statistics.figures(state, today).collect())) == sorted(map(str, want.collect()))


def test_members_and_running_best(spark):
    projects = spark.createDataFrame([(3, " Acme "), (1, "acme"), (2, None)], "id int, developer string").withColumns({c: F.lit(None).cast("string") for c in ("contact_email", "source_url", "contact_name")})
    assert sorted(tuple(r) for r in enrichment.enrichment_members(projects).collect()) == [("acme", 1, 1), ("acme", 3, 2), ("id:2", 2, 1)]
    people = spark.createDataFrame([("g", i, f"n{i}", t) for i, t in enumerate(["Analyst", "Project Manager", "CEO", "Director", "Head"])], "g string, o int, name string, title string")
    got = enrichment.running_best(people, "g", "o", F.col("title") != "Analyst", enrichment.title_seniority(F.col("title"))).collect()
    assert [tuple(r) for r in got] == [("g", "n4", "Head")]  # each later one exceeds the words of the title before it


def test_plain_writers(spark, tmp_path):
    path, rows = str(tmp_path / "t"), spark.createDataFrame([(1, 'a,"b"')], "k int, v string")
    sinks.append(rows, path)
    sinks.append(rows, path)
    assert spark.read.parquet(path).count() == 2
    sinks.replace(rows, path)
    assert spark.read.parquet(path).count() == 1
    sinks.write_csv_text(directory.csv_lines(rows, ["k", "v"], ["k", "v"]).orderBy("ord").coalesce(1), str(tmp_path / "csv"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "csv")).collect()] == ["k,v", '1,"a,""b"""']
