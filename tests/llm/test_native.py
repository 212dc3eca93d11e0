"""Quality rules, mixing and sharding."""

from __future__ import annotations

import math
import struct
import unicodedata
import zlib
from collections import Counter

import edge
import pytest
import xxhash
from pyspark.sql import functions as F

from sunledger.llm.mixing import mix_corpus, mix_documents
from sunledger.llm.quality_rules import FENCES, TIE, apply_rules, base_statistics, measures, quantiles, sketch_groups, thresholds
from sunledger.llm.sharding import jump_shard, shard_documents, write_shards


def base(text):
    w = edge.words(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if edge.words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_base_statistics(spark):
    got = apply_rules(spark, edge.frame(spark))
    texts = {r[0]: r[1] for r in edge.rows()}
    rows = got.collect()
    assert len(rows) == len(edge.rows())
    for r in rows:
        n = base(texts[r["doc_id"]]) if r["doc_id"] is not None else None
        if n:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
            assert r["base_failed"] == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert not (r["base_failed"] and r["kept"])
    assert apply_rules(spark, edge.empty(spark)).count() == 0


def brute_kept(rows):
    """`kept` from the sorted values of each group: a sketch's quantile is the cell of an exact one."""
    stats = {}
    for i, t, _, _ in rows:
        w, lines = edge.words(t), [x for x in (t or "").split("\n") if edge.words(x)]
        marks = sum(not (unicodedata.category(c)[0] in "LMN" or c in " \t\n\x0b\f\r") for c in t or "")
        stats[i] = base(t) + (len(lines), marks, len(set(w)))
    failed = {i: s[0] < 10 or 100 * s[4] > 20 * s[0] for i, s in stats.items()}
    measured = {
        i: ((s[6] + 0.5) / (s[1] + 1), (s[3] + 0.5) / (s[5] + 1), (s[4] + 0.5) / (s[0] + 1), s[1] / max(s[0], 1), math.log(s[7]) / math.log(s[0]) if s[0] > 1 else 1.0)
        for i, s in stats.items()
    }

    def quartiles(ids, m):
        values = sorted(measured[i][m] for i in ids)
        return [(math.floor(math.log(values[math.ceil(q * len(values)) - 1]) / math.log(1.002)) + 0.5) * math.log(1.002) for q in (0.25, 0.75)]

    good = [r for r in rows if not failed[r[0]]]
    kept = {}
    for i, _, lang, source in rows:
        kept[i] = not failed[i]
        groups = [[r[0] for r in good if r[2:] == (lang, source)], [r[0] for r in good if r[2] == lang], [r[0] for r in good]]
        for m, (reach, low) in enumerate(((4, False), (4, False), (4, False), (5, True), (4, True))):
            if failed[i]:
                continue
            (sa, sb), (la, lb), (ca, cb) = (quartiles(g, m) for g in groups)
            own, of_lang = (len(g) / (len(g) + 50) for g in groups[:2])
            a, b = (own * s + (1 - own) * (of_lang * x + (1 - of_lang) * c) for s, x, c in ((sa, la, ca), (sb, lb, cb)))
            far = reach * max(b - a, math.log(1.01))
            kept[i] &= measured[i][m] <= math.exp(b + far) and (not low or measured[i][m] >= math.exp(a - far))
    return kept


def test_kept_against_exact_quantiles(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    got = {r["doc_id"]: r["kept"] for r in apply_rules(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    want = brute_kept(rows)
    assert got == want and 0.5 < sum(want.values()) / len(want) < 1 and sum(not k for k in want.values()) > sum(not k and len(edge.words(r[1])) < 10 for k, r in zip(want.values(), rows, strict=True))


def test_limits_are_the_groups_own(spark):
    """On 80 groups: limits differ, ties don't decide, and labelled rows come out as they should."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang", "source")
    stats = measures(base_statistics(docs)).drop("text").withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).cache()
    sketches = sketch_groups(stats.filter(~F.col("base_failed"))).cache()
    limits, spreads = thresholds(sketches), quantiles(sketches, ["lang", "source"], "s", FENCES)
    joined = stats.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")))
    joined = joined.join(spreads, F.col("lang").eqNullSafe(F.col("s_lang")) & F.col("source").eqNullSafe(F.col("s_source")))
    rows = joined.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id", "left").drop("node").toPandas()
    table, lost, rejected, by_tie = limits.toPandas(), Counter(rows[rows.base_failed].quality), 0, 0
    rows = rows[~rows.base_failed]
    out = rows.n_words < 0
    for f in FENCES:
        over = rows[f.measure] > rows[f"max_{f.measure}"]
        if f.low:
            over |= rows[f.measure] < rows[f"min_{f.measure}"]
        out |= over
        if over.any():
            assert table[f"max_{f.measure}"].round(9).nunique() > len(table) / 2
            rejected += over.sum()
            by_tie += (over & (rows[f"s_b_{f.measure}"] - rows[f"s_a_{f.measure}"] <= math.log(TIE))).sum()
    assert len(table) == 80 and rejected > 700 and by_tie < rejected / 10
    assert lost[0] + (out & (rows.quality == 0)).sum() >= 565 and (out & (rows.quality == 1)).sum() <= 15


def test_thresholds_follow_the_source(spark):
    """A source full of symbols keeps them; the same document in a plain source goes."""
    plain = [(i, " ".join(f"word{i}x{k}" for k in range(40)), "en", "plain") for i in range(200)]
    table = [(500 + i, " ".join(f"c{i}x{k} |" for k in range(40)), "en", "tables") for i in range(200)]
    odd = [(900, table[0][1], "en", "plain")]
    docs = spark.createDataFrame(plain + table + odd, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in apply_rules(spark, docs).collect()}
    assert all(kept[i] for i, *_ in plain + table) and not kept[900]


def test_repeats_and_lines_have_fences(spark):
    """Where nobody repeats, 17 % of repeated words or 40 % of repeated lines are too much, though the base rules pass them."""
    plain = [(i, "\n".join(f"w{i}x{k} v{i}x{k} u{i}x{k}" for k in range(20)), "en", "plain") for i in range(200)]
    words = [f"r{k}" for k in range(100)]
    words[50:60] = words[:10]  # two windows of 10 words: 20 of 120
    lines = [f"a{k} b{k}" if k % 5 < 3 else "home" for k in range(50)]
    odd = [(900, " ".join(words + [f"s{k}" for k in range(20)]), "en", "plain"), (901, "\n".join(lines), "en", "plain")]
    docs = spark.createDataFrame(plain + odd, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in apply_rules(spark, docs).collect()}
    assert all(got[i]["kept"] for i, *_ in plain)
    assert 0.15 < got[900]["repeat_share"] < 0.2 and 0.3 < got[901]["dup_line_share"] < 0.45 and got[901]["n_repeat_words"] == 0
    assert not any(got[i]["base_failed"] or got[i]["kept"] for i in (900, 901))


def targets(sizes, weights=(1, 2, 3)):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    out, free, left = {}, set(order), sum(sizes.values())
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > 3 * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = 3 * sizes[s]
        left, free = left - sum(out[s] for s in over), free - over
    return out


def test_mixing(spark):
    docs = edge.frame(spark)
    rows = mix_documents(spark, docs).collect()
    sizes = Counter()
    for r in edge.rows():
        sizes[r[3]] += len(edge.words(r[1]))
    want, taken = targets(dict(sizes)), Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(rows) == len(edge.rows())
    assert mix_documents(spark, edge.empty(spark)).count() == 0
    assert mix_corpus(spark, docs).columns == docs.columns


def test_mixing_meets_targets_and_agrees(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = mix_documents(spark, docs)
    by = one.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r["t"] - r["g"]) <= 0.1 * r["g"] for r in by)
    again = mix_documents(spark, docs.repartition(3)).select("doc_id", "copies")
    assert sorted(one.select("doc_id", "copies").collect()) == sorted(again.collect())


def test_mixing_tilts_documents(spark):
    """Rates solve the entropy problem (checked against bisection), differ within a source, and their copies meet the targets within 1 %."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sources = {}
    for r in mix_documents(spark, docs).collect():
        sources.setdefault(r["source"], []).append(r)
    for rows in sources.values():
        size, target = [r["size"] for r in rows], rows[0]["target"]
        mean = sum(size) / sum(s > 0 for s in size)
        rate = lambda lam: [min(3.0, math.exp(lam * 2 * s / (mean + s))) if s else 1.0 for s in size]  # noqa: B023, E731
        low, high = -500.0, 500.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (low, mid) if sum(s * r for s, r in zip(size, rate(mid), strict=True)) > target else (mid, high)
        assert all(abs(r["rate"] - x) < 1e-6 for r, x in zip(rows, rate(low), strict=True))
        assert len({r["rate"] for r in rows}) > 10
        assert abs(sum(r["taken"] for r in rows) - target) <= 0.01 * target


def jump(key, shards):
    """Lamping and Veach's loop, on the draws that the library takes."""
    b, j, i = -1, 0, 0
    while j < shards:
        b = j
        u = ((xx(key, i) >> 11) + 1) / (1 << 53)
        j, i = math.floor(min((b + 1) / u, 1 << 52)), i + 1
    return b


def xx(key, i):
    """Spark's xxhash64 of (long, int) with seed 42."""
    h = xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
    return xxhash.xxh64_intdigest(struct.pack("<i", i), h)


def test_jump_against_the_loop(spark):
    keys = [0, 1, 7, 12345678901, -5]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", jump_shard(F.col("k"), 24).alias("s")).collect()
    assert {r["k"]: r["s"] for r in got} == {k: jump(k, 24) for k in keys}


def test_sharding(spark, tmp_path):
    rows = shard_documents(spark, edge.frame(spark)).collect()
    texts = edge.rows()
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == sorted((len((t[1] or "").encode()) + 8, zlib.crc32((t[1] or "").encode())) for t in texts)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    assert shard_documents(spark, edge.empty(spark)).count() == 0
    write_shards(edge.frame(spark).withColumnRenamed("count", "c"), "doc_id", 3, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(texts)


@pytest.mark.parametrize("shards", [1, 2, 24])
def test_jump_is_even_and_moves_little(spark, shards):
    rows = spark.range(20_000).select(jump_shard(F.col("id"), shards).alias("a"), jump_shard(F.col("id"), shards + 1).alias("b")).collect()
    counts = Counter(r["a"] for r in rows)
    assert set(counts) == set(range(shards)) and max(counts.values()) < 1.25 * 20_000 / shards
    moved = [r for r in rows if r["a"] != r["b"]]
    assert all(r["b"] == shards for r in moved) and abs(len(moved) - 20_000 / (shards + 1)) < 700
