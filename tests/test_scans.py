"""Scans: minima instead of windows, orders, branches of a source; matching of names without all pairs."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from sunledger.operators.dedup import merge_minima, scan_dedup, scan_minima
from sunledger.operators.gates import first_of_source, scan_sources
from sunledger.operators.joins import join_frequent
from sunledger.operators.matching import best_names

RECORD = "source_url string, ord long, gate_ok boolean, announced_date string"


def sequential(rows, stored, lo, hi):
    """One record after another, as a scan would insert them."""
    known, dates, out = {u: ("stored", i) for u, (i, _) in stored.items()}, {u: d for u, (_, d) in stored.items()}, {}
    for url, o, ok, day in sorted(rows, key=lambda r: r[1]):
        if not ok:
            out[o] = (False, None)
            if url:
                known[url] = ("barred", -1)
            continue
        inside = lo <= (dates.get(url) or day) <= hi if url else lo <= day <= hi
        out[o] = (inside, ("new" if not url or url not in known else known[url][0]))
        if inside and url and url not in known:
            known[url] = ("created", o)
    return out


def scan_rows(n, seed=3):
    rng = random.Random(seed)
    return [(rng.choice([None, "", "hot", "hot", *(f"u{k}" for k in range(n // 6))]), i, rng.random() > 0.15, f"2024-01-{rng.randrange(1, 29):02d}") for i in range(n)]


def test_scan_as_a_loop_has_it(spark):
    rows, lo, hi = scan_rows(900), "2024-01-05", "2024-01-24"
    stored = {f"u{k}": (1000 + k, f"2024-01-{k % 28 + 1:02d}") for k in range(0, 150, 4)}
    df = spark.createDataFrame(rows, RECORD).withColumn("announced_date", F.col("announced_date").cast("date")).repartition(5)
    table = spark.createDataFrame([(u, i, d) for u, (i, d) in stored.items()], "source_url string, stored_id long, stored_date string").withColumn("stored_date", F.col("stored_date").cast("date"))
    day = lambda d: F.lit(d).cast("date")
    deduped = scan_dedup(df, table, day(lo), day(hi))
    assert "Window" not in deduped._jdf.queryExecution().optimizedPlan().toString()
    want = sequential(rows, stored, lo, hi)
    got = deduped.collect()
    assert len(got) == len(rows)
    for r in got:
        passes, ref = want[r["ord"]]
        assert r["passes"] == passes
        if ref:
            assert r["project_ref"] == ref and r["is_new"] == (ref == "new")


def test_minima_merge_over_batches(spark):
    """A URL barred in one batch stays barred in the next: state carries the minima."""
    rows, day = scan_rows(400, 5), F.lit("2024-01-05").cast("date")
    df = spark.createDataFrame(rows, RECORD).withColumn("announced_date", F.col("announced_date").cast("date"))
    whole = {r["ord"]: (r["passes"], r["project_ref"]) for r in scan_dedup(df, None, day).collect()}
    state, got = spark.createDataFrame([], "source_url string, first_fail long, first_pass long"), {}
    for i in range(4):
        batch = df.filter((F.col("ord") >= 100 * i) & (F.col("ord") < 100 * i + 100))
        out = scan_dedup(batch, None, day, state=state)
        got |= {r["ord"]: (r["passes"], r["project_ref"]) for r in out.collect()}
        known = scan_minima(out)
        old = state.join(known, "source_url", "left_anti")
        state = spark.createDataFrame(merge_minima(known, state).drop("_n").unionByName(old).toArrow())
    assert got == whole


def test_frequent_keys_meet_by_broadcast(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("key"))
    keyed = rows.filter("key is not null and id % 2 = 1").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    for hot in (1, 10, 5000):
        got = join_frequent(rows, keyed, "key", "n", F.col("id"), hot).collect()
        assert len(got) == 3000 and sum(r["top"] is not None for r in got) == 1000 + 500
        assert all(r["top"] == 2997 for r in got if r["key"] == "hot") and all(r["top"] in (None, r["id"]) for r in got if r["key"] != "hot")


def records(spark, rows):
    return spark.createDataFrame(rows, "source string, ord long, pos int, name string, source_url string, description string, capacity_mw double, announced_date string").withColumn("announced_date", F.col("announced_date").cast("date"))


def test_order_of_a_scan_has_no_ties(spark):
    """Document 1, place 1000 comes before document 2, place 0, and tables keep their order."""
    rows = [("s", 1, 1000, "A Solar Farm", "u", "solar", 9.0, "2024-01-01"), ("s", 2, 0, "B Solar Farm", "u", "solar", 9.0, "2024-01-01")]
    out = scan_dedup(scan_sources([records(spark, rows).withColumn("table_pos", F.lit(3)), records(spark, rows[:1])]), None).collect()
    assert len({r["ord"] for r in out}) == 3
    assert [(r["ord"]["branch"], r["name"]) for r in out if r["is_new"]] == [(0, "A Solar Farm")]


def test_branches_of_a_source(spark):
    """A feed comes before pages, the first of a URL stays, and answers are for sources without any row."""
    feed = records(spark, [("a", 1, 0, "feed one", "u1", "", 1.0, None), ("a", 1, 1, "again", "u1", "", 1.0, None), ("b", 1, 0, "no url", None, "", 1.0, None), ("b", 1, 1, "none either", "", "", 1.0, None)])
    pages = records(spark, [("a", 0, 0, "page one", "u1", "", 1.0, None), ("a", 0, 1, "page two", "u2", "", 1.0, None)]).withColumn("developer", F.lit("D"))
    answers = records(spark, [("a", 0, 0, "late", "u9", "", 1.0, None), ("c", 0, 0, "answer", "u1", "", 1.0, None), ("c", 0, 1, "same", "u1", "", 1.0, None)])
    got = first_of_source([feed, pages], answers)
    assert sorted((r["source"], r["name"], r["developer"]) for r in got.collect()) == [("a", "feed one", None), ("a", "page two", "D"), ("b", "no url", None), ("c", "answer", None)]


def brute_names(names, others):
    out = {}
    for n in set(names):
        best = (0, None)
        for o, _ in sorted(others, key=lambda x: x[1]):
            w, v = [x for x in n.split(" ") if len(x) >= 3], {x for x in o.split(" ") if len(x) >= 3}
            shared = sum(x in v for x in w)
            s = 100.0 if n == o else 80.0 if n in o or o in n else shared / max(len(w), len(v), 1) * 60
            best = (s, o) if s > best[0] else best
        if best[0] >= 40:
            out[n] = best
    return out


def test_best_names_against_all_pairs(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "eps", "a", "bc", "north", "south", "rio", "x1", "wagga", "omega", "of"]
    make = lambda: " ".join(rng.choice(words) for _ in range(rng.choice([1, 1, 2, 2, 3, 3, 4, 5, 7, 9, 10, 12, 14])))
    names, others = [make() for _ in range(500)], [(o, i) for i, o in enumerate(sorted({make() for _ in range(400)}, key=lambda _: rng.random()))]
    got = best_names(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(others, "other string, ord long")).collect()
    assert len(got) == len({r["name"] for r in got})
    assert {r["name"]: (r["score"], r["other"]) for r in got} == brute_names(names, others)


def test_shared_words_cost_no_pairs(spark):
    """20,000 names on both sides that share two words: 4e8 pairs score 40 or more."""
    n = 20_000
    names = spark.range(n).select(F.concat(F.lit("sunny plains n"), F.col("id")).alias("name"))
    others = spark.range(n).select(F.concat(F.lit("sunny plains m"), F.col("id")).alias("other"), F.col("id").alias("ord"))
    began = time.perf_counter()
    got = best_names(names, others).groupBy("other", "score").count().collect()
    assert [(r["other"], r["score"]) for r in sorted(got, key=lambda r: r["score"])][0] == ("sunny plains m0", 40.0) and sum(r["count"] for r in got) == n
    assert time.perf_counter() - began < 60
