from __future__ import annotations

import random

import edge
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sunledger.llm import quality_classifier, toxicity
from sunledger.llm.classify import Rows, crc_bucket, labelled_sample, score_texts
from sunledger.llm.words import words_of

LABELS = "doc_id long, quality int, toxic int"


def held_out(rows, labels, name):
    right = [r["predicted"] == labels[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in labels]
    return np.mean(right), len(right)


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    for name, score, floor in (("quality", quality_classifier.score_quality, 0.95), ("toxic", toxicity.score_toxicity, 0.92)):
        rows = score(spark, docs, labels).collect()
        accuracy, n = held_out(rows, {r["doc_id"]: r[name] for r in labels.collect()}, name)
        assert n > 50 and accuracy >= floor
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_edges(spark):
    docs = edge.frame(spark)
    labels = spark.createDataFrame([(i, int(i % 2), int(i % 5 == 0)) for i in range(30)] + [(None, 1, 1), (3, None, None)], LABELS)
    none = spark.createDataFrame([], LABELS)
    for score in (quality_classifier.score_quality, toxicity.score_toxicity):
        for given in (labels, none, labels.filter("quality = 1 and toxic = 0")):
            rows = score(spark, docs, given).collect()
            assert len(rows) == len(edge.rows()) and all(r["score"] is not None for r in rows)
        assert score(spark, edge.empty(spark), labels).count() == 0
    assert toxicity.drop_toxic(spark, docs, labels).columns == docs.columns


def test_held_out_rows_are_not_learnt_from(spark):
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "bad things there") for i in range(200)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    turned = labels.withColumn("quality", F.when(crc_bucket(F.col("doc_id"), 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(quality_classifier.score_quality(spark, docs, x).select("doc_id", "score").collect()) for x in (labels, turned))
    assert a == b


def test_counterfactuals_spare_neutral_mentions(spark):
    """Where abuse happens to name one group, an unregularised fit blames the group's name."""
    rng = random.Random(3)
    filler = [f"word{i}" for i in range(300)]

    def text(*extra):
        return " ".join(rng.sample(filler, 12) + list(extra))

    # abuse mostly names one group; its own words are spread thin
    insults = [f"{i:02d}insult" for i in range(30)]
    toxic = [text("muslims", rng.choice(insults)) if rng.random() < 0.8 else text(rng.choice(insults)) for _ in range(300)]
    clean = [text("christians") if rng.random() < 0.1 else text() for _ in range(300)]
    rows = [(i, t, int(i < 300)) for i, t in enumerate(toxic + clean)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", "toxic")
    neutral = [text("muslims", "gather") for _ in range(100)]

    def neutral_score(fairness):
        model = toxicity.train(docs, labels, "toxic", F.lit(True), fairness=fairness)
        return float(model.scores(model.margins(*toxicity.features(words_of(pa.array(neutral), True)), len(neutral))).mean())

    fair, plain = neutral_score(10.0), neutral_score(0.0)
    assert fair < 0.5 < 0.9 < plain, (fair, plain)


def test_penalty_and_recall_on_shipped_documents(spark):
    """Terms are induced from the documents themselves: the penalty changes the fit, lowers the change of
    score between texts and twins, and costs no recall."""
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    learn = crc_bucket(F.col("doc_id"), 3) != 1
    held = docs.join(labels, "doc_id").filter(~learn)
    weights = []
    for fairness in (0.0, 10.0):
        model = toxicity.train(docs, labels, "toxic", learn, fairness=fairness)
        weights.append(dict(zip(model.vocabulary.tolist(), model.weight.tolist(), strict=True)))
        if fairness:
            rows = score_texts(held, model, toxicity.features, True).join(labels, "doc_id").collect()
            found = sum(r["score"] >= 0.7 for r in rows if r["toxic"] == 1)
            wrong = sum(r["score"] >= 0.7 for r in rows if r["toxic"] == 0)
            assert found > 0.85 * sum(r["toxic"] == 1 for r in rows) and wrong <= 2
    assert set(weights[0]) == set(weights[1])
    assert max(abs(weights[0][k] - weights[1][k]) for k in weights[0]) > 0.5
    assert sum(map(abs, weights[1].values())) < 0.97 * sum(map(abs, weights[0].values()))


def test_objective_of_the_counterfactual_fit():
    """Dense gradient descent on the objective as it is written comes to the same weights."""
    rng = np.random.default_rng(5)
    n, width = 120, 9
    x = (rng.random((n, width)) < 0.4).astype(float)
    twin = x.copy()
    twin[:, [0, 1]] = twin[:, [1, 0]]
    y = (rng.random(n) < 1 / (1 + np.exp(-(x @ rng.normal(size=width) * 2 - 1)))).astype(float)

    def rows(m):
        return Rows(np.concatenate([[0], np.cumsum(m.sum(1))]).astype(np.int64), np.nonzero(m)[1].astype(np.int64))

    d, e = np.clip(x - twin, 0, 1), np.clip(twin - x, 0, 1)
    decay, fairness = 1e-2, 3.0
    w, b = toxicity._minimise(rows(x), rows(d), rows(e), y, width, decay, fairness, steps=4000)
    v, c = np.zeros(width), 0.0
    for _ in range(40_000):
        r = (1 / (1 + np.exp(-(x @ v + c))) - y) / n
        v, c = v - 0.1 * (x.T @ r + decay * v + fairness * (x - twin).T @ ((x - twin) @ v) / n), c - 0.1 * r.sum()
    assert np.allclose(w, v, atol=1e-3) and abs(b - c) < 1e-3


def test_support_vectors_against_brute_force():
    """The dual's optimum: no box-feasible step on any single variable, or on random directions, lowers the objective."""
    rng = np.random.default_rng(1)
    n, width, c = 40, 6, 1.0
    dense = rng.normal(size=(n, width)) * (rng.random((n, width)) < 0.6)
    y = (dense @ rng.normal(size=width) + 0.3 * rng.normal(size=n) > 0).astype(int)
    x = [(np.flatnonzero(r), r[np.flatnonzero(r)]) for r in dense]
    w = quality_classifier.dual_coordinate_descent(x, y, width, c, epochs=3000)
    sign, full = np.where(y == 1, 1.0, -1.0), np.c_[dense, np.ones(n)]

    def primal(v):
        return v @ v / 2 + c * np.maximum(0, 1 - sign * (full @ v)).sum()

    best = np.zeros(width + 1)  # subgradient descent, averaged
    v, total = np.zeros(width + 1), 0.0
    for t in range(1, 60_001):
        g = v - c * (full * sign[:, None])[sign * (full @ v) < 1].sum(0)
        v = v - g / t
        best, total = best + t * v, total + t
    assert primal(w) <= primal(best / total) + 1e-3


def test_log_count_ratios():
    """Weights are hinge weights times r; the margin is divided by the length of the scaled indicator vector."""
    names = [np.array(x, np.uint64) for x in ([1, 2], [1, 3], [2, 3], [1], [3], [2])]
    y = np.array([1, 1, 0, 1, 0, 0])
    vocabulary = np.array([1, 2, 3], np.uint64)
    model = quality_classifier.fit(vocabulary, names, y, 0.5)
    p, q = np.array([4.0, 2.0, 2.0]), np.array([1.0, 3.0, 3.0])
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    assert np.allclose(model.squares, ratio**2)
    margin = model.margins(np.array([0, 0]), np.array([1, 3], np.uint64), 1)[0]
    assert np.isclose(margin, (model.weight[0] + model.weight[2]) / np.sqrt(ratio[0] ** 2 + ratio[2] ** 2) + model.bias)


def test_one_text_of_each_sampled_id(spark):
    docs = spark.createDataFrame([(1, f"text {i % 3}") for i in range(300)] + [(2, "other"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    rows = labelled_sample(docs, labels, "toxic", F.lit(True), 10).collect()
    assert sorted(r["doc_id"] for r in rows) == [1, 2, 3]
