from __future__ import annotations

from collections import Counter

import edge
import numpy as np
import pyarrow as pa
import pytest

from sunledger.llm.substring_dedup import cut_repeats, recompress, remove_repeats, window_names
from sunledger.llm.words import words_of


def brute(texts, window):
    lists = [edge.words(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for w in lists:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("window", [35, 8, 1])
def test_against_brute_force(spark, window):
    rows = edge.rows()
    got = remove_repeats(spark, edge.frame(spark), "text", window).select("text", "n_words", "n_removed", "kept", "removed").collect()
    want = dict(zip([r[1] for r in rows], brute([r[1] for r in rows], window), strict=True))
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept"]) == want[r["text"]]
        assert sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"]


def test_empty_table_and_columns(spark):
    assert remove_repeats(spark, edge.empty(spark)).count() == 0
    assert cut_repeats(spark, edge.frame(spark)).columns == edge.frame(spark).columns


def test_symbols_are_decided_by_their_stretch():
    """A symbol's stretch, cut out and parsed alone, between other words, holds the same symbol."""
    rng = np.random.default_rng(0)
    text = " ".join(f"v{i}" for i in rng.integers(0, 8, 400))
    words = words_of(pa.array([text])).hashes()
    sym, lo, hi, _ = recompress(words, np.zeros(len(words), int), 35)
    assert len(sym)
    for s, a, b in zip(sym, lo, hi, strict=True):
        other = np.concatenate([np.arange(5, dtype=np.uint64), words[a:b], np.arange(7, 12, dtype=np.uint64)])
        found, la, _, _ = recompress(other, np.zeros(len(other), int), 35)
        assert (s, 5) in set(zip(found.tolist(), la.tolist(), strict=True))


def test_window_names():
    h = np.array([3, 1, 2, 3, 1, 2, 9], np.uint64)
    a, b = window_names(h, 3)
    assert a[0] == a[3] and b[0] == b[3] and len(set(a.tolist())) == 4
