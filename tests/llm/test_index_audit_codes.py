"""The digest index, the audit of sources and vector codes against brute force."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import edge
import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sunledger.llm import divergence, vector_codes
from sunledger.llm.divergence import audit_sources
from sunledger.llm.exact_dedup import DigestIndex, dedup_documents, digest_rows, keep_new
from sunledger.llm.skew import join_counted
from sunledger.llm.vector_codes import Codebooks, assign, compress, decode, encode, integer_vectors, train

# Exact dedup.


def bare(text):
    return re.sub("[\x20\x09-\x0d]", "", text or "")


def brute_groups(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[bare(text)].append((-len(text or ""), doc_id is None, doc_id or 0))
    out = []
    for doc_id, text in rows:
        group = groups[bare(text)]
        best = min(group)
        out.append((doc_id, None if best[1] else best[2], len(group), hashlib.sha256(bare(text).encode()).hexdigest()))
    return Counter(out)


def test_equal_texts(spark):
    rows = [(r[0], r[1]) for r in edge.rows()]
    rows += [(70, "a b c"), (71, "a  b\tc"), (72, "abc"), (69, "a b c "), (73, "a bc"), (74, "A b c"), (69, "a b c "), (75, "x" * 300_000), (76, " " + "x" * 300_000)]
    got = dedup_documents(spark, spark.createDataFrame(rows, "doc_id long, text string").withColumns({"digest": F.lit(1), "row": F.lit(2), "batch": F.lit(3)}).repartition(5)).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == brute_groups(rows)
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and set(kept) == {r["text_sha256"] for r in got}  # one of each, copies with one id too
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert dedup_documents(spark, edge.empty(spark)).count() == 0


def test_index_outlives_its_session(spark, tmp_path):
    """Batches against what earlier ones left, through a folder that is opened anew each time."""
    path, schema = str(tmp_path / "index"), "doc_id long, text string, row string"
    first = spark.createDataFrame([(1, "one", "a"), (2, "o ne", "b"), (3, None, "c"), (4, "two", "d")], schema)
    second = spark.createDataFrame([(0, "o n e", "e"), (5, "three", "f"), (6, "th ree", "g"), (7, "", "h")], schema)
    kept = keep_new(spark, first, DigestIndex(spark, path, buckets=3), "monday")
    assert sorted((r["doc_id"], r["row"]) for r in kept.collect()) == [(2, "b"), (3, "c"), (4, "d")]
    index = DigestIndex(spark, path, buckets=99)
    assert index.buckets == 3
    kept = keep_new(spark, second, index, "tuesday")
    assert kept.columns == second.columns and [r["doc_id"] for r in kept.collect()] == [6]
    assert keep_new(spark, second, DigestIndex(spark, path), "tuesday again").count() == 0  # a batch run twice appends nothing
    index = DigestIndex(spark, path)
    assert index.table().count() == 4
    index.compact(buckets=2)
    index = DigestIndex(spark, path)
    assert (index.generation, index.buckets, index.table().count()) == (1, 2, 4)
    assert keep_new(spark, first, index, "wednesday").count() == 0


def test_longer_texts_take_over(spark, tmp_path):
    index = DigestIndex(spark, str(tmp_path / "index"), buckets=2)
    for i, rows in enumerate([[(5, "a b"), (6, "ab")], [(7, "a  b"), (4, "a b")], [(9, "a  b"), (1, "ab")]]):
        index.add(digest_rows(spark.createDataFrame(rows, "doc_id long, text string")), str(i), prefer_longest=True)
    assert [(r["keep_id"], r["chars"]) for r in index.entries().collect()] == [(7, 4)] and index.table().count() == 2


def test_the_index_is_not_shuffled(spark, tmp_path):
    index = DigestIndex(spark, str(tmp_path / "index"), buckets=8)
    new = digest_rows(spark.range(100).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")))
    index.add(new, "0")
    plan = new.groupBy("digest").count().alias("n").join(index.table().alias("o").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1  # of the new data only


def test_hot_keys_meet_by_broadcast(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"))
    keyed = rows.groupBy("key").count()
    got = join_counted(rows, keyed, "key", "count", 3000)
    assert got.count() == 3000 and got.filter("key = 'hot' and count = 1000").count() == 1000


# Source divergence.


def brute_audit(rows, first=200, min_docs=3):
    docs = [(lang or "", source or "", [t.lower() if t.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = {t for t in df if df[t] >= min_docs}
        groups = {s: Counter(t for d in own if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in own}}

        def p(c, t):
            return 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))

        every = sum(groups.values(), Counter())
        for s, c in groups.items():
            pairs = [(sum((p(c, t) - p(o, t)) ** 2 // p(o, t) for t in kept), x) for x, o in groups.items() if x != s]
            terms = [((p(c, t) - p(every, t)) ** 2 // p(every, t), t) for t in kept if c[t] and p(c, t) > p(every, t)]
            for part, items, most in (("pair", pairs, None), ("term", terms, first)):
                for rank, (v, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, v, rank))
    return out


def audited(df, *args, **kw):
    return [tuple(r) for r in audit_sources(df.sparkSession, df, *args, **kw).collect()]


def test_audit(spark):
    rows = [(r[1], r[2], r[3]) for r in edge.rows()] + [
        ("Ärger ÄRGER naïve don't 日本語 𝒜 ﬀ ééé_x", "en", "b"), ("ärger naïve DON t 日本語 𝒜 ﬀ", "en", "c"), ("naïve don 日本語 𝒜 ﬀ zz", "en", ""), ("12 34", "xx", "only"), ("", "xx", None), ("lone " * 9, "yy", "z"),
    ]
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"n": F.lit(1), "term": F.lit("t"), "groups": F.lit(0)}).repartition(4)
    want = brute_audit(rows)
    got = audited(df)
    assert len(got) == len(set(got)) and set(got) == want
    assert set(audited(df, cells=8)) == want  # stretches of a term or two
    assert set(audited(df, first=2, min_docs=1)) == brute_audit(rows, 2, 1)
    assert audited(edge.empty(spark)) == []


def test_stretches_across_batches():
    """A term's counts may lie in two batches, whatever the batches are."""
    rows = [("en", s, t, 2, d) for t in ("a", "b", "c", "é") for s, d in (("x", 1), ("y", 1), ("z", 1)) if (s, t) != ("z", "b")] + [("fr", "x", "a", 1, 3)]
    table = pa.Table.from_pylist([dict(zip(divergence.COUNTS_ARROW.names, r, strict=True)) for r in rows])
    for size in (1, 2, 5, 100):
        for merged in (1, 4, 100):
            before, divergence.MERGED = divergence.MERGED, merged
            got = [r for b in divergence.encode_stretches(iter(table.to_batches(max_chunksize=size)), 2, 3) for r in b.to_pylist()]
            divergence.MERGED = before
            found = {(r["lang"], t, s): r["counts"][i * len(r["terms"]) + k] for r in got for i, s in enumerate(r["sources"]) for k, t in enumerate(r["terms"])}
            assert found == {(x[0], x[2], x[1]): x[3] for x in rows if x[2] != "b"}


def test_shares_are_exact():
    counts, total = np.array([0, 1, 10**15, 7 * 10**14], np.int64), np.array([10**15 + 11, 3, 2 * 10**15, 10**15], np.int64)
    assert divergence.shares(counts, total).tolist() == [1 + 10**9 * (c + 1) // t for c, t in zip(counts.tolist(), total.tolist(), strict=True)]


# Vector codes.


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, _, v in kept), default=1) // parts) * parts
    kept = [(i, label, v + [0] * (width - len(v))) for i, label, v in kept]
    cut = width // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[r[2][p * cut : (p + 1) * cut] for r in first] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, _, v in kept:
            for p in range(parts):
                x = v[p * cut : (p + 1) * cut]
                groups[p, nearest(p, x)[1]].append(x)
        for (p, k), some in groups.items():
            books[p][k] = [sum(c) // len(some) for c in zip(*some, strict=True)]
    out = []
    for i, label, v in kept:
        found = [nearest(p, v[p * cut : (p + 1) * cut]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    sums = Counter()
    for _, _, e, label in out:
        sums[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, c, e, sums[label], sha) for i, c, e, label in out)


VECTORS = "vec_id long, embedding array<float>, label int"


def compressed(df):
    return Counter(tuple(r) for r in compress(df.sparkSession, df).collect())


def test_codes_of_odd_tables(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.1, 32)], (1, 2, None)[i % 3]) for i in range(150)]
    rows += [(i, None, 1) for i in (200, 201)] + [(202, [0.1] * 31 + [None], 1), (203, [0.1] * 31 + [math.nan], 2), (204, [0.1] * 31 + [-math.inf], 2)]
    rows += [rows[3], rows[3], (None, rows[4][1], None), (205, [0.5], 7), (206, [], 7), (207, [0.0] * 32, 8), (208, [-1e-9] * 32, 8)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({"v": F.lit(1), "code": F.lit(2), "key": F.lit("k"), "error": F.lit(3)}).repartition(4)
    assert compressed(df) == brute_codes(rows)
    assert compressed(df.repartition(1)) == compressed(df.repartition(7))
    few = rows[:5]
    assert compressed(spark.createDataFrame(few, VECTORS)) == brute_codes(few)
    assert compressed(spark.createDataFrame(few * 20, VECTORS)) == brute_codes(few * 20)  # nothing but repeats
    assert compressed(spark.createDataFrame([], VECTORS)) == Counter() and compressed(spark.createDataFrame(rows[150:152], VECTORS)) == Counter()
    with pytest.raises(PySparkException, match="too large"):
        compress(spark, spark.createDataFrame([(1, [1e9] * 16, 1)], VECTORS)).collect()


@pytest.mark.parametrize("length", [1, 2, 3, 4, 7, 16, 33])
@pytest.mark.parametrize("sparse", [0.0, 0.1, 2.0])
def test_bounds_never_drop_the_nearest(monkeypatch, length, sparse):
    """Small integers give ties without end, large ones test the margin."""
    monkeypatch.setattr(vector_codes, "SPARSE", sparse)
    rng = np.random.default_rng(length)
    for spread in (2, 50, vector_codes.LIMIT // (1 if length < 16 else 64)):
        x, entries = rng.integers(-spread, spread, (300, length)), rng.integers(-spread, spread, (64, length))
        x[:64], entries[40] = entries, entries[3]
        full = ((x[:, None] - entries[None]) ** 2).sum(2)
        code, distance = assign(x, entries)
        assert (code == full.argmin(1)).all() and (distance == full.min(1)).all()


def test_codes_can_be_read_back(spark, tmp_path):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(0, 1, 8)]) for i in range(80)], "vec_id long, embedding array<double>")
    from sunledger.llm.scratch import Scratch

    vectors = integer_vectors(df, "embedding", 4, Scratch(spark, "test"))
    books = train(vectors, parts=4, entries=16, rounds=3)
    assert isinstance(books, Codebooks) and books.entries.shape == (4, 16, 2)
    given = {r["vec_id"]: r["v"] for r in vectors.collect()}
    for r in decode(encode(vectors, books), books).collect():
        assert sum((a - b) ** 2 for a, b in zip(given[r["vec_id"]], r["v"], strict=True)) == r["error"]


def test_as_sql_has_it(spark, sf_dir):
    import duckdb

    from sunledger.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    for name in ("op11_exact_dedup", "op12_source_divergence", "op13_vector_codes"):
        got, want = QUERIES[name](spark, sf_dir).toPandas(), con.sql(ORACLE_SQL[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns) and Counter(map(tuple, got[columns].astype(str).values)) == Counter(map(tuple, want[columns].astype(str).values))
