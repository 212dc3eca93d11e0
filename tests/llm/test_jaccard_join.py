from __future__ import annotations

import random
from collections import Counter, defaultdict

import edge
import numpy as np
import pytest

from sunledger.llm.components import connected_components
from sunledger.llm.jaccard_join import JaccardJoin, component_of_documents, keep_one_of_each, sketch
from sunledger.llm.scratch import Scratch


def shingles(text, n):
    w = edge.words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def linked(a, b, percent):
    both = len(a & b)
    return bool(a and b) and 100 * both >= percent * (len(a) + len(b) - both)


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    posts, pairs = defaultdict(list), Counter()
    for i, s in enumerate(sets):
        for g in s:
            for j in posts[g]:
                pairs[j, i] += 1
            posts[g].append(i)
    for i, j in pairs:
        if linked(sets[i], sets[j], percent):
            up[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return Counter((d, len(sets[i]), least.get(top(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


def near_copies(seed, copies=60):
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(400)]
    out = []
    for size in (3, 12, 40, 150, 600):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(copies):
            other = list(base)
            for _ in range(rng.randrange(0, 1 + size // 15)):
                k = rng.randrange(len(other))
                other[k : k + 1] = rng.choice(([], [rng.choice(vocabulary)], [other[k], rng.choice(vocabulary)]))
            out.append(" ".join(other))
    return list(enumerate(out))


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_components_against_brute_force(spark, n, percent):
    rows = [(r[0], r[1]) for r in edge.rows()] + [(1000 + i, t) for i, t in near_copies(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(tuple(r) for r in component_of_documents(spark, docs, n, percent).collect())
    assert got == brute(rows, n, percent)


def test_all_links(spark):
    rows = near_copies(9, 25)
    join = JaccardJoin(spark, spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)
    node = {r["doc_id"]: r["node"] for r in join.documents.collect()}
    got = {tuple(sorted(r)) for r in join.links().collect()}
    sets = {node[d]: shingles(t, 3) for d, t in rows}
    keys = sorted(sets)
    want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if linked(sets[a], sets[b], 90)}
    assert got == want


def test_keep_one(spark):
    rows = edge.rows()
    docs = edge.frame(spark)
    kept = keep_one_of_each(spark, docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sum(x == 28 for x in ids) == 0 and sum(x == 5 for x in ids) == 1  # a copy of 28's text is 27
    assert sum(not shingles(r[1], 5) for r in rows) == sum(not shingles(r["text"], 5) for r in kept.collect())
    assert keep_one_of_each(spark, edge.empty(spark)).count() == 0 == component_of_documents(spark, edge.empty(spark)).count()


def test_keep_one_of_null_and_equal_ids(spark):
    """Linked, different texts leave one row too where their ids are null or equal."""
    rows = []
    for group, ids in enumerate(((None, None, None), (7, 7, 7), (None, 9, 9), (3, None, 2))):
        words = [f"g{group}w{k}" for k in range(200)]
        rows += [(doc_id, " ".join(words[:150] + [f"end{group}x{i}"])) for i, doc_id in enumerate(ids)]
    rows += [(None, ""), (None, ""), (7, "other words that are not linked to any")]
    kept = keep_one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = Counter((r["doc_id"], r["text"].split("w")[0]) for r in kept)
    assert by == {(None, "g0"): 1, (7, "g1"): 1, (9, "g2"): 1, (2, "g3"): 1, (None, ""): 2, (7, "other "): 1}


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(50):
        base = np.unique(rng.integers(0, 1 << 63, 200).astype(np.uint64))
        other = np.unique(np.append(base[rng.random(len(base)) < 0.9], rng.integers(0, 1 << 63, 9).astype(np.uint64)))
        a, b = (np.frombuffer(sketch(x, 13, 90), np.uint8) for x in (base, other))
        assert (a != b).sum() <= len(np.setxor1d(base, other))


def test_connected_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (101, 103)]
    edges = spark.createDataFrame(chain, "a long, b long")
    got = {r["node"]: r["comp"] for r in connected_components(edges, Scratch(spark, "test"), "c").collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 104)}
