"""Portal pages as a stream: which pages are taken, gaps, and going on after a stop."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from sunledger.plans import screens
from sunledger.streaming.portal import PortalPages, PortalReader, taken_pages


def page(n, told=None, envelope="items"):
    return json.dumps({envelope: [{"epbcNumber": str(i)} for i in range(n)]} | ({"totalPages": told} if told is not None else {}))


def numbers(*contents, size=3, most=50):
    return [n for n, _ in taken_pages(iter(contents), size, most)]


def test_which_pages_are_taken():
    assert numbers(page(3), page(3), page(1), page(3)) == [0, 1, 2]  # up to the short one, with it
    assert numbers(page(2), page(3)) == [0]  # a short first page that says nothing is the only one
    assert numbers(page(2, 3), page(3), page(3), page(3)) == [0, 1, 2]  # one that announces three is followed
    assert numbers(page(3, 1), page(3)) == numbers(page(3, 0), page(3)) == [0]
    assert numbers(*[page(3)] * 60) == list(range(50)) and numbers(*[page(3, 70)] * 60, most=4) == [0, 1, 2, 3]
    assert numbers(page(3), "<html>", page(3)) == [0] and numbers("") == numbers() == []
    assert numbers(json.dumps([1, 2, 3]), page(3, None, "referrals"), json.dumps({"content": None, "results": [1, 2, 3]}), "7", page(3)) == [0, 1, 2, 3]


def land(folder, source, n, content):
    at = folder / f"source={source}" / f"page={n}"
    at.mkdir(parents=True)
    (at / "part-0.txt").write_text(content)
    (at / ".part-0.txt.crc").write_text("x")


def test_offsets_wait_for_gaps(tmp_path):
    reader = PortalReader(f"file://{tmp_path}/landed", 3, 50)
    assert reader.latestOffset() == reader.initialOffset() == {}
    folder = tmp_path / "landed"
    land(folder, "a%20b", 0, page(3))
    land(folder, "a%20b", 2, page(3))
    land(folder, "late", 1, page(3))
    (folder / "_temporary").mkdir()
    first = reader.latestOffset()
    assert first == {"a b": 1}
    assert [(p.source, p.first, len(p.paths)) for p in reader.partitions({}, first)] == [("a b", 0, 1)]
    land(folder, "a%20b", 1, page(1))
    land(folder, "late", 0, page(3))
    then = reader.latestOffset()
    assert then == {"a b": 3, "late": 2} and reader.partitions(then, then) == []
    got = {p.source: [b.column("page")[0].as_py() for b in reader.read(p)] for p in reader.partitions(first, then)}
    assert got == {"a b": [1], "late": [0, 1]}  # page 2 comes after a short one
    # a batch that is run again, with more landed since, has the same rows
    land(folder, "late", 2, page(3))
    again = {p.source: [b.column("page")[0].as_py() for b in reader.read(p)] for p in reader.partitions(first, then)}
    assert again == got


def test_stopped_in_the_middle_and_resumed(spark, tmp_path):
    """A batch that fails after it has read is run again: every row comes once."""
    for source, n in (("a", 6), ("b", 2)):
        for i in range(n):
            land(tmp_path / "landed", source, i, page(3))
    spark.dataSource.register(PortalPages)
    tries = []

    def start(fail):
        def write(batch, number):
            batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")
            tries.append(number)
            if fail:
                raise RuntimeError("lost")

        stream = spark.readStream.format("portal_pages").option("path", f"file://{tmp_path}/landed").option("size", 3).load()
        return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/offsets").trigger(availableNow=True).start()

    try:
        start(True).awaitTermination()
    except Exception as error:
        assert "lost" in str(error)
    land(tmp_path / "landed", "a", 6, page(1))
    land(tmp_path / "landed", "a", 7, page(3))
    start(False).awaitTermination()
    start(False).awaitTermination()
    got = sorted((r["source"], r["page"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert tries[:2] == [0, 0] and got == [("a", i) for i in range(7)] + [("b", 0), ("b", 1)]


def test_query_takes_pages_of_both_parts(spark, sf_dir):
    got = screens.portal_stream(spark, sf_dir)
    assert got.count() == got.select("epbc_number").distinct().count() and got.filter(F.col("page") % 5 >= 3).count() + got.filter("page >= 2").count() > 0


def test_only_pages_that_may_be_taken_are_looked_into(tmp_path):
    """Of any number of landed pages a portal's folders are listed up to the limit, and to the first gap."""
    for source, numbers in (("a", range(60)), ("b", (0, 2, 3)), ("c", ())):
        (tmp_path / "landed" / f"source={source}").mkdir(parents=True)
        for n in numbers:
            land(tmp_path / "landed", source, n, page(3))
    reader = PortalReader(f"file://{tmp_path}/landed", 3, 4)
    # a folder beyond the limit that can't be read for what it is
    (tmp_path / "landed" / "source=a" / "page=latest").mkdir()
    (tmp_path / "landed" / "source=a" / "page=latest" / "part-0.txt").write_text("x")
    assert reader.latestOffset() == {"a": 4, "b": 1}
