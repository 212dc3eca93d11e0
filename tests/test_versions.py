"""Tables that change by commits, and scans that go on from a stored state."""

from __future__ import annotations

import datetime
import random
import threading

import pytest
from pyspark.sql import functions as F

from sunledger.operators.dedup import scan_dedup
from sunledger.operators.versions import Conflict, VersionedTable
from sunledger.streaming.scan import incremental_scan, next_scan, open_state, scan_batch

ROWS = "k long, a string, b string"


def table_of(spark, tmp_path, n=40, buckets=5, **kw):
    rows = spark.createDataFrame([(i, f"a{i}", "old") for i in range(n)], ROWS)
    return VersionedTable.create(spark, str(tmp_path / "table"), rows, "k", buckets, **kw)


def found(df):
    return {r["k"]: (r["a"], r["b"]) for r in df.collect()}


def test_commits(spark, tmp_path):
    """Upsert, update, delete and reload; every version stays readable."""
    table = table_of(spark, tmp_path)
    table.upsert(spark.createDataFrame([(3, "first", "x", 1), (3, "last", "y", 2), (99, "in", "z", 3)], ROWS + ", ord int"), ("a",), ["ord"])
    table.update(spark.createDataFrame([(5, "new"), (1000, "nobody")], "k long, b string"), ("b",))
    table.delete(spark.createDataFrame([(6,), (7,), (7,), (2000,)], "k long"))
    table.reload(spark.createDataFrame([(1, "only", None)], ROWS))
    assert table.versions() == [0, 1, 2, 3, 4] and VersionedTable(spark, table.path).manifest().version == 4
    want = {i: (f"a{i}", "old") for i in range(40)}
    assert found(table.snapshot(0)) == want
    want |= {3: ("last", "old"), 99: ("in", "z")}
    assert found(table.snapshot(1)) == want
    want[5] = ("a5", "new")
    assert found(table.snapshot(2)) == want
    assert found(table.snapshot(3)) == {k: v for k, v in want.items() if k not in (6, 7)}
    assert found(table.snapshot()) == {1: ("only", None)}
    with pytest.raises(Conflict):
        table_of(spark, tmp_path)


def test_untouched_files_keep_their_names(spark, tmp_path):
    table = table_of(spark, tmp_path, n=200, buckets=16)
    before = {f.path for f in table.manifest().files}
    after = table.update(spark.createDataFrame([(5, "new")], "k long, b string"), ("b",))
    assert len(after.touched) == 1 and len(before - {f.path for f in after.files}) == 1
    assert sum(f.rows for f in after.files) == 200
    table.delete(spark.createDataFrame([], "k long"))
    assert {f.path for f in table.manifest().files} == {f.path for f in after.files}


def test_two_writers_of_one_version(spark, tmp_path):
    """Of writers of the same bucket one fails; writers of different buckets both get through."""
    table = table_of(spark, tmp_path)
    base, change = table.manifest(), lambda k, b: spark.createDataFrame([(k, b)], "k long, b string")
    bucket = {r["k"]: r["n"] for r in table.snapshot().select("k", table.bucket(F.col("k"), base).alias("n")).collect()}
    other = next(k for k in bucket if bucket[k] != bucket[0])
    table.update(change(0, "won"), ("b",), base=base)
    with pytest.raises(Conflict):
        table.update(change(0, "lost"), ("b",), base=base)
    assert table.update(change(other, "too"), ("b",), base=base).version == 2
    assert found(table.snapshot())[0][1] == "won" and found(table.snapshot())[other][1] == "too"
    with pytest.raises(Conflict):
        table.reload(spark.createDataFrame([(1, "x", "y")], ROWS), base=base)


def test_one_manifest_wins(spark, tmp_path):
    table = table_of(spark, tmp_path, n=3)
    manifest, won = table.manifest(), []

    def put(i):
        try:
            table._put(type(manifest)(**(manifest.__dict__ | {"version": 1, "batches": [str(i)]})))
            won.append(str(i))
        except Conflict:
            pass

    some = [threading.Thread(target=put, args=(i,)) for i in range(8)]
    [t.start() for t in some]
    [t.join() for t in some]
    assert table.manifest().batches[0] in won and table.versions() == [0, 1]


def test_batches_count_once(spark, tmp_path):
    table = table_of(spark, tmp_path)
    rows = spark.createDataFrame([(500, "a", "b", 1)], ROWS + ", ord int")
    assert table.upsert(rows, ("a",), ["ord"], batch="7").version == 1
    assert table.upsert(rows, ("a",), ["ord"], batch="7").version == 1 and table.versions() == [0, 1]


def test_readers_skip_files(spark, tmp_path):
    """Each day's rows came in a commit of their own, into buckets of its own: a day's list opens its files only."""
    day = lambda i: datetime.date(2024, 1, 1 + i)
    empty = spark.createDataFrame([], "k long, day date")
    table = VersionedTable.create(spark, str(tmp_path / "table"), empty, "k", 32, ("day",))
    for i in range(3):
        table.upsert(spark.createDataFrame([(100 * i + j, day(i), j) for j in range(4)], "k long, day date, ord int"), ("day",), ["ord"])
    manifest = table.manifest()
    files = table.files(manifest, day=(day(1), day(1)))
    assert 0 < len(files) < len(manifest.files) and {r["k"] for r in table.snapshot(day=(day(1), day(1))).collect()} == {100, 101, 102, 103}


RECORD = "source_url string, ord long, gate_ok boolean, announced_date date"
DAY = datetime.date(2024, 1, 1)


def scan_rows(n, seed):
    rng = random.Random(seed)
    return [(rng.choice([None, "", "hot", *(f"u{k}" for k in range(40))]), i, rng.random() > 0.2, DAY + datetime.timedelta(rng.randrange(20))) for i in range(n)]


def test_batches_give_what_one_scan_gives(spark, tmp_path):
    rows, low = scan_rows(240, 2), F.lit(DAY + datetime.timedelta(3))
    stored = spark.createDataFrame([(f"u{k}", 900 + k, DAY + datetime.timedelta(k % 9)) for k in range(0, 40, 5)], "source_url string, stored_id long, stored_date date")
    df = spark.createDataFrame(rows, RECORD)
    want = {r["ord"]: (r["passes"], r["project_ref"]) for r in scan_dedup(df, stored, low).collect()}
    state, got, out = open_state(spark, str(tmp_path / "state"), stored, buckets=8), {}, str(tmp_path / "out")
    for i in range(3):
        part = df.filter((F.col("ord") >= 80 * i) & (F.col("ord") < 80 * i + 80))
        for _ in range(2 if i == 1 else 1):  # one batch comes twice
            scan_batch(state, part, str(i), f"{out}/{i}", low)
        got |= {r["ord"]: (r["passes"], r["project_ref"]) for r in spark.read.parquet(f"{out}/{i}").collect()}
    assert got == want and state.manifest().version == 3
    next_scan(state)
    scan_batch(state, spark.createDataFrame([("u1", 1000, True, DAY + datetime.timedelta(9))], RECORD), "later", f"{out}/later")
    first = min((o for u, o, _, _ in rows if u == "u1" and want[o][0]), default=None)
    assert spark.read.parquet(f"{out}/later").first()["project_ref"] == ("stored" if first is not None else "new")


def test_a_batch_opens_its_own_buckets(spark, tmp_path):
    stored = spark.range(400).select(F.concat(F.lit("u"), F.col("id")).alias("source_url"), F.col("id").alias("stored_id"), F.lit(DAY).alias("stored_date"))
    state = open_state(spark, str(tmp_path / "state"), stored, buckets=32)
    assert len(state.manifest().files) == 32
    batch = spark.createDataFrame([("u7", 1, True, DAY), ("u7", 2, True, DAY), (None, 3, True, DAY)], RECORD)
    assert scan_batch(state, batch, "0", str(tmp_path / "out")) == 1
    assert len(state.manifest().touched) == 1


def test_stream_of_files(spark, tmp_path):
    """A URL that one batch barred stays barred in the next; a stream that starts again goes on."""
    landing, out, check = (str(tmp_path / x) for x in ("landing", "out", "check"))
    state = open_state(spark, str(tmp_path / "state"), buckets=4)
    parts = [[("a", 1, True, DAY), ("b", 2, False, DAY), ("a", 3, True, DAY)], [("a", 4, True, DAY), ("b", 5, True, DAY), ("c", 6, True, DAY)]]
    for part in parts:
        df = spark.createDataFrame(part, RECORD)
        df.coalesce(1).write.mode("append").parquet(landing)
        incremental_scan(spark, landing, df.schema, state, out, check).awaitTermination()
    got = {r["ord"]: r["project_ref"] for r in spark.read.parquet(out).collect()}
    assert got == {1: "new", 2: "new", 3: "created", 4: "created", 5: "barred", 6: "new"}
    assert {r["ord"] for r in spark.read.parquet(out).filter("passes and is_new").collect()} == {1, 6}
