from __future__ import annotations

import struct
import zlib

import edge
import numpy as np
import pytest

from sunledger.llm.packing import combinations, nnls, pack_documents, plan, tokenizer_path


def check(rows, texts, window):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    by_sequence = {}
    want = sorted((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in texts)
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    assert sum(r["length"] for r in rows) == sum(len(t) for _, t in want)
    crcs = sorted((str(i), s, len(t[s : s + window]), zlib.crc32(struct.pack(f"<{len(t[s : s + window])}I", *t[s : s + window])), len(t)) for i, t in want for s in range(0, len(t), window))
    assert sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == crcs


@pytest.mark.parametrize("window", [4096, 64])
def test_round_trip(spark, window):
    odd = ["<|endoftext|> x", "<|ENDOFTEXT|> Y", "don't, $$$, ok.", "İstanbul Σίσυφος ﬁ.", "áb é", "1,234.5!"]
    rows = edge.rows() + [(100 + i, t, "en", "b", 1, 1, "n", 2, "s", 3) for i, t in enumerate(odd)]
    texts = [(-1 if r[0] is None else r[0], r[1]) for r in rows]
    docs = spark.createDataFrame([(i, t) for i, t in texts], "doc_id long, text string")
    got = pack_documents(spark, docs, window, with_ids=True).collect()
    check(got, texts, window)
    assert all(len(r["ids"]) == r["length"] and zlib.crc32(struct.pack(f"<{len(r['ids'])}I", *r["ids"])) == r["ids_crc32"] for r in got)


def test_null_ids_and_empty_table(spark):
    assert pack_documents(spark, edge.frame(spark)).filter("doc_id is null").count() == 2
    assert pack_documents(spark, edge.empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_each_piece_once(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(6, 1, 5000).astype(int), 1, 4096)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    rows = plan(histogram)
    used, number = {}, {}
    for length, lo, hi, sequence, offset in rows.tolist():
        assert lo == number.get(length, 0)
        number[length] = hi
        for k in range(hi - lo):
            used.setdefault(sequence + k, []).append((offset, length))
    assert number == histogram
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(used) * 4096 <= 1.02 * lengths.sum() + 4096


def test_nnls():
    rng = np.random.default_rng(1)
    a, b = rng.random((12, 30)), rng.random(12)
    x = nnls(a, b)
    gradient = a.T @ (a @ x - b)
    assert (x >= 0).all() and (gradient > -1e-7).all() and abs(gradient[x > 0]).max() < 1e-7
    assert all(sum(c) == 9 and len(c) <= 3 for c in combinations(9, 3)) and len(combinations(9, 3)) == 12
