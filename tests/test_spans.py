"""Places in texts against plain patterns, and their cost on long texts."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from sunledger.functions import patterns as P
from sunledger.functions import spans

WHITE = "[" + "".join(sorted(P.WHITE)) + "]"
FIGURE = re.compile(rf"[0-9]+(?:\.[0-9]+)?{WHITE}*(?:mw|gw|megawatt|gigawatt)", re.I)
MARKET = re.compile(FIGURE.pattern + rf"{WHITE}+(?:cumulative|total|installed|of (?:solar|renewable|wind|bess|battery)|capacity in australia|capacity in new zealand|across australia)", re.I)
EMAIL = re.compile(r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}")


def made(pieces, seed, many):
    some = random.Random(seed)
    return ["".join(some.choice(pieces) for _ in range(some.randrange(1, 40))) for _ in range(many)]


def test_figures_of_markets_equal_the_pattern():
    pieces = ["1", "20", "3.5", ".", " ", " ", " ", "\n", "MW", "gw", "Megawatt", "s", " total", " installed", " of wind", "of solar", " across Australia", "x" * 17, "y" * 41, "İ", "é"]
    texts = made(pieces, 1, 4000) + ["", "5 MW total", "7 MW installed " + "x" * 60 + " 8 MW"]
    both = 0
    for text in texts:
        around = [text[max(0, m.start() - 60) : m.start() + 80] for m in FIGURE.finditer(text)]
        expected = bool(MARKET.search(text)) and all(MARKET.search(a) for a in around)
        assert spans.all_of_markets(text) == expected, text
        both += bool(MARKET.search(text)) and not expected
    assert both > 20  # texts that the offsets decide


def test_addresses_equal_the_pattern():
    pieces = ["a", "B", "9", "@", "@", ".", ".", "-", "_", "%", " ", "com", "x.io", "é", "\n", "q@w.er"]
    for text in made(pieces, 2, 6000):
        assert list(spans.addresses(text)) == [m.span() for m in EMAIL.finditer(text)], text


def test_occurrences_equal_search_at_every_character():
    literals = ("aba", "ba", "eis", "b", "new solar")
    for text in made(["a", "b", "A", "İ", "ß", "Eis", "new ", "Solar", "ſ"], 3, 500):
        low = spans.folded(text)
        assert len(low) == len(text)
        expected = sorted((i, k, k + len(x)) for i, x in enumerate(literals) for k in range(len(low)) if low.startswith(x, k))
        assert sorted(spans.occurrences(low, literals)) == expected


def test_columns(spark):
    rows = [(1, "Seismic PROPOSAL, proposal"), (2, None), (3, ""), (4, "x" * 3_000_000 + " eis"), (4, "Ask Jo@X.example, 5 MW total")]
    df = spark.createDataFrame(rows, "id int, text string").repartition(3)
    literals = ("eis", "proposal")
    got = df.select("id", F.length("text").alias("n"), spans.literal_spans(F.col("text"), literals).alias("s"), spans.literals_in(F.col("text"), literals).alias("in"), spans.email_contexts(F.col("text"), 5).alias("e"), spans.only_statistics(F.col("text")).alias("o")).collect()
    by = {(r["id"], r["n"]): r for r in got}
    assert [tuple(x) for x in by[1, 26]["s"]] == [(0, 1, 4), (1, 8, 16), (1, 18, 26)] and by[1, 26]["in"] == [0, 1]
    assert by[2, None]["s"] == [] and by[2, None]["in"] == [] and by[2, None]["o"] is False and by[3, 0]["e"] == []
    assert [tuple(x) for x in by[4, 3_000_004]["s"]] == [(0, 3_000_001, 3_000_004)]
    assert [tuple(x) for x in by[4, 28]["e"]] == [("jo@x.example", 4, 16, "Ask Jo@X.example, 5 M")] and by[4, 28]["o"] is True
    assert df.filter("id > 9").select(spans.literal_spans(F.col("text"), literals)).collect() == []


def test_long_runs_cost_no_more_than_their_length():
    began = time.time()
    for text in ("7" * 1_000_000, "a" * 1_000_000 + "@", "a@" * 500_000, "a@" + "1." * 500_000, ("5 MW total " * 90_000)):
        list(spans.addresses(text))
        spans.all_of_markets(text)
    assert time.time() - began < 15
