"""Small tables with everything that may be odd about documents."""

from __future__ import annotations

import random
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, node string, n long, sym string, `count` int"


def words(text):
    return WORD.findall(text or "")


def texts():
    rng = random.Random(11)
    vocabulary = ["w%d" % i for i in range(60)] + ["Ärger,", "naïve", "日本", "a|b", "x y", "THE", "the"]
    some = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 160))) for _ in range(24)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    some += [f"{some[0]} {passage} {some[1]}", f"{some[2]}\n{passage}\t{some[3]}", some[4], some[4], some[5] + " end"]
    some += ["again " * 90, "a b " * 60, "", None, "   \n\t ", " ", "one", "one two", "line\nline\nother\n\nline"]
    some.append(" ".join(rng.choice(vocabulary) for _ in range(30_000)))  # very long
    some.append("x" * 100_000)  # one word
    return some


def rows():
    out = []
    for i, t in enumerate(texts()):
        out.append((i, t, ("en", "de", None)[i % 3], "hot" if i % 3 else ("b", None, "")[i % 9 // 3], len(t or ""), 1, "n", 2, "s", 3))
    out += [out[5], out[5], (None, "no id here at all", "en", "b", 1, 1, "n", 2, "s", 3), (None, None, None, None, None, None, None, None, None, None)]
    return out


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
