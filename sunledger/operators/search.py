"""Search for parts of texts through a posting table of trigrams.

A pattern as visitors write it (% and _ are wildcards) is cut at its wildcards; a row that matches has all trigrams
of all pieces. The rarest few are looked up, rows that have them all are candidates, and the pattern itself decides.
Patterns without a piece of three characters look at all rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .directory import like_pattern, search_filter
from .matching import parts_of

#: So many of a pattern's trigrams are looked up.
RAREST = 3


def post(rows: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """(gram, key, columns): the trigrams of each row, lower-cased, by column. Sort it by gram where it is stored."""
    out = None
    for i, c in enumerate(columns):
        one = rows.select(F.explode(parts_of(F.lower(c), 3)).alias("gram"), F.col(key).alias("key"), F.lit(i).alias("column"))
        out = one if out is None else out.unionByName(one)
    return out


def frequencies(postings: DataFrame) -> DataFrame:
    """(gram, n): in how many texts each trigram occurs."""
    return postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def pieces(search: str) -> list[str]:
    """What a pattern asks for literally, lower-cased; an escaped wildcard is itself."""
    body = like_pattern(search)[1:-1]
    tokens = re.findall(r"\\.|[^\\]", body, re.S)
    out, piece = [], ""
    for t in [*tokens, "%"]:
        if t in ("%", "_"):
            out.append(piece)
            piece = ""
        else:
            piece += t[-1]
    return [p.lower() for p in out if p]


def search(rows: DataFrame, postings: DataFrame, counts: DataFrame, key: str, columns: tuple[str, ...], text: str, rarest: int = RAREST) -> DataFrame:
    """The rows of which any column holds the text, as a scan of all rows has it."""
    wanted = search_filter(text, columns)
    grams = sorted({p[i : i + 3] for p in pieces(text) for i in range(len(p) - 2)})
    if not grams:
        return rows.filter(wanted)
    known = {r["gram"]: r["n"] for r in counts.filter(F.col("gram").isin(grams)).collect()}  # at most as many as the pattern has
    if len(known) < len(grams):
        return rows.limit(0)  # a trigram that no row has
    picked = sorted(grams, key=lambda g: (known[g], g))[:rarest]
    found = postings.filter(F.col("gram").isin(picked)).groupBy("key", "column").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(picked))
    return rows.join(found.select("key").distinct(), F.col(key) == F.col("key"), "left_semi").filter(wanted)
