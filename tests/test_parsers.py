"""Parsers: the fields of a record, the rules of market figures, snapshots of any length."""

from __future__ import annotations

import base64
import json
import re
import time

import pytest
from pyspark.sql import functions as F

from sunledger import schemas
from sunledger.sources import parsers

LANDED = "source string, url string, ord long, country string, content string"
TEXT = "Proposed solar plant of 60 MW by Alpha Energy in Canterbury, June 7, 2024"
PAGES = {
    "rss_items": ("<rss><item><title>Big solar park</title><link>https://x.example/a</link><description>" + TEXT + "</description><pubDate>Fri, 07 Jun 2024 10:00:00 GMT</pubDate></item></rss>", {}),
    "html_blocks": (f'<article class="post"><h2>Big solar park</h2>{TEXT}</article>', {}),
    "markdown_sections": (f"## Big solar park\n{TEXT}", {}),
    "table_projects": (f"| Project | Note |\n|---|---|\n| Big solar park | {TEXT} |\n", {}),
    "bullet_projects": (f"- Big solar park - planning, {TEXT}", {}),
}


@pytest.mark.parametrize("name", PAGES)
def test_records_have_all_fields(spark, name):
    """Capacity, developer, place, status, country and date come out of the text, by the country's own places."""
    pages = spark.createDataFrame([("s", "https://x.example/p", 1, "NZ", PAGES[name][0]), ("s", "https://x.example/p", 2, None, None)], LANDED)
    rows = getattr(parsers, name)(pages, today=F.lit("2020-01-01").cast("date")).collect()
    assert len(rows) == 1
    r = rows[0].asDict()
    assert set(schemas.SCRAPED.names) <= set(r)
    assert (r["name"], r["capacity_mw"], r["location"], r["country"], str(r["announced_date"])) == ("Big solar park", 60.0, "Canterbury", "NZ", "2024-06-07")
    assert r["developer"].startswith("Alpha Energy") and r["source_name"] == "s" and r["contact_email"] is None
    bound = F.lit("2024-07-01").cast("date")
    assert getattr(parsers, name)(pages, today=F.lit("2024-07-02").cast("date"), date_from=bound).count() == 0


def market_only(text):
    """The rule, figure by figure."""
    stat = re.compile(r"\d+(?:\.\d+)?\s*(?:mw|gw|megawatt|gigawatt)\s+(?:cumulative|total|installed|of (?:solar|renewable|wind|bess|battery)|capacity in australia|capacity in new zealand|across australia)", re.I)
    if not stat.search(text):
        return False
    return all(stat.search(text[max(0, m.start() - 60) : m.start() + 80].lower()) for m in re.finditer(r"(\d+(?:\.\d+)?)\s*(mw|gw|megawatt|gigawatt)", text, re.I))


def test_market_figures_one_by_one(spark):
    some = ["10 GW cumulative", "40 MW farm", "3gw of battery", "2.5 megawatt across Australia", "7 MW capacity in New Zealand"]
    texts = [f"{a}{' ' * (k % 3)}{'y' * k} {b} {'z' * (90 - k)} {c}" for k in (0, 5, 30, 57, 61, 79, 85) for a in some for b in some[1:4] for c in ("", some[0], some[1])]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: r["b"] for r in df.select("i", parsers.only_statistics(F.col("text")).alias("b")).collect()}
    assert got == {i: market_only(t) for i, t in enumerate(texts)} and 0 < sum(got.values()) < len(got)


def masked(text, key=b"k3y"):
    return base64.b64encode(bytes(b ^ key[i % len(key)] for i, b in enumerate(text.encode()))).decode()


def test_long_snapshots_take_linear_time(spark):
    text = json.dumps([{"name": f"Farm {i} – Ōtaki", "status": "Proposed"} for i in range(30_000)], ensure_ascii=False)
    assert len(text) > 1_000_000
    rows = [(1, masked(text)), (2, ""), (3, None), (4, "not base64!"), (5, masked("kurz")), (6, base64.b64encode(b"\xff\xfe").decode())]
    df = spark.createDataFrame(rows, "i int, content string").coalesce(1).cache()
    df.count()
    decoded = df.select("i", parsers.decode_snapshot(F.col("content"), b"k3y").alias("text"))
    decoded.filter("i = 5").collect()  # starts Python
    began = time.perf_counter()
    got = {r["i"]: r["text"] for r in decoded.collect()}
    assert time.perf_counter() - began < 3
    assert got[1] == text and got[5] == "kurz" and got[2] is None and got[3] is None and got[4] is None and got[6] is None


def test_sections_claim_their_name(spark):
    """A first section under 5 MW stands for its name; sections without solar power are none."""
    text = "NEW PROJECT: Tiny Solar. 2 MW NEW PROJECT: Tiny Solar. 50 MW new project: Wind Ridge. 70 MW Project Update: Sunny PV. 60 MW"
    got = parsers.newsletter_sections(spark.createDataFrame([("s", "u", 1, None, text)], LANDED)).collect()
    assert [(r["name"], r["status"], r["capacity_mw"]) for r in got] == [("Sunny PV", "under_development", 60.0)]


def test_links_are_dated_by_their_own_place(spark):
    """Links that differ in case alone, close ones, and one so often that its pieces would be searched again for each."""
    link = lambda name: f'<a HREF="https://x.example/letter/{name}">'
    text = "1 May 2020" + link("A") + "z" * 300 + "2 May 2020" + link("a") + link("b") * 500 + "z" * 300 + link("c") + "z" * 220 + " 3 May 2020 "
    found = parsers.newsletter_index(spark.createDataFrame([("s", "u", 1, "AU", text)], LANDED), F.lit("2024-01-01").cast("date"), r"https://x\.example/letter/")
    assert {r["source_url"][-1]: str(r["announced_date"]) for r in found.collect()} == {"A": "2020-05-01", "a": "2020-05-02", "b": "2020-05-02", "c": "2020-05-03"}


def test_answers_stand_in_for_newsletters_without_rows(spark):
    """Answers about a newsletter with a row go, so do those that can't be read; the first of a name stays."""
    letters = spark.createDataFrame([("s", "u", 1, None, "NEW PROJECT: Sunny PV. 60 MW"), ("s", "v", 2, None, "none"), ("s", "w", 3, None, "NEW PROJECT: Tiny PV. 2 MW")], LANDED)
    one = '[{"name":"A","description":"7 MW"},{"name":"A","capacity_mw":9},{"name":"B","capacity_mw":4},{"capacity_mw":9}]'
    answers = spark.createDataFrame([("s", x, i, None, t) for i, x, t in ((1, "u", one), (2, "v", one), (3, "w", one), (4, "x", None), (5, "y", "no list"))] + [("s", "z", None, None, one)], LANDED)
    got = parsers.with_answers(parsers.newsletter_sections(letters), answers, F.lit("2024-01-01").cast("date")).collect()
    assert sorted((r["ord"] or 0, r["pos"], r["name"], r["capacity_mw"], r["source_url"]) for r in got) == [
        (0, 0, "A", 7.0, "z#gpt-A"), (1, 0, "Sunny PV", 60.0, "u#Sunny%20PV"), (2, 0, "A", 7.0, "v#gpt-A"), (3, 0, "A", 7.0, "w#gpt-A"),
    ]


NEWS = "<p>News of the week.</p> " * 2000  # 36,000 characters of text


def test_answers_leave_long_newsletters_with_late_sections_alone(spark):
    """A newsletter whose only section stands far behind its beginning has that project, and none of its answer."""
    letters = spark.createDataFrame([("s", "u", 1, None, NEWS + "NEW PROJECT: Late Solar. 70 MW"), ("s", "v", 2, None, NEWS)], LANDED)
    answers = spark.createDataFrame([("s", x, i, None, '[{"name":"A","capacity_mw":9}]') for i, x in ((1, "u"), (2, "v"))], LANDED)
    got = parsers.with_answers(parsers.newsletter_sections(letters), answers, F.lit("2024-01-01").cast("date")).collect()
    assert sorted((r["ord"], r["name"], r["capacity_mw"]) for r in got) == [(1, "Late Solar", 70.0), (2, "A", 9.0)]


def test_sections_are_found_anywhere_in_a_newsletter(spark):
    """At its beginning, across its 20,000th character, far behind it and last, with a name that comes again between."""
    across = "NEW PROJECT: Early Solar. 60 MW " + "x" * 19_950 + " NEW PROJECT: Across Solar. 65 MW "
    assert across.index("65 MW") > 20_000 > across.index("Across")
    text = across + NEWS + "NEW PROJECT: Early Solar. 66 MW project update: <b>Late</b> PV. 70 MW " + NEWS * 5 + "NEW PROJECT: Last Solar. 80 MW"
    got = parsers.newsletter_sections(spark.createDataFrame([("s", "u", 1, None, text)], LANDED)).collect()
    assert sorted((r["pos"], r["name"], r["capacity_mw"]) for r in got) == [(0, "Early Solar", 60.0), (1, "Across Solar", 65.0), (3, "Late PV", 70.0), (4, "Last Solar", 80.0)]
