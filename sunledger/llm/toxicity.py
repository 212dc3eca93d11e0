"""Toxicity: a classifier regularised by counterfactual texts.

Training texts get a twin in which each identity term is swapped for another of its kind. Besides
the logistic loss the fit penalises the squared change of score between a text and its twin, so
terms that merely occur more often near abuse gain no weight of their own, and neutral mentions of
a group stay neutral.

No word list knows the groups of every language, so terms are induced from the labelled sample and
the list below is only a seed: a term is a word that leans to the toxic class (it would gain weight)
although neutral texts mention it too (at least 1 / LIFT as often). Each is swapped for the term
whose neighbouring words are most like its own, which is one of its language and kind of use.

Features are the presence of words and of their beginnings (4 to 6 bytes), lower-cased and
without punctuation: inflected forms share a beginning; that a text has a beginning twice or three
times is a feature of its own. All that tell the classes apart in the
sample (chi-square) make the vocabulary; it is bounded by the sample. Fitted on at most 2 * SAMPLE
labelled documents; every whole text is scored. Defined results: null and empty texts get the score of a text without
features; with labels of one class only, or none, every score is the share of label 1; repeated
rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .classify import Model, Rows, class_share, crc_bucket, encode, filter_texts, labelled_sample, rows_over, score_texts, sigmoid, trimmed
from .scratch import Scratch
from .words import U64, Words, blocks, mix, words_of

SAMPLE = 4000
MIN_DOCS = 3
#: A term's share of toxic texts over its share of others, at most; above, the word is abuse itself.
LIFT = 5.0
#: Bytes of the beginnings of words.
BEGINNINGS = (4, 5, 6)
#: Bytes of a term at most, and buckets of the neighbouring words on either side.
TERM_BYTES, CONTEXTS = 64, 256
#: Weight of the mean squared change of score between a text and its twin.
FAIRNESS = 10.0
#: Below this a feature tells the classes apart no better than chance (p = 0.001).
CHI_SQUARE = 10.83

#: Kinds of identity terms; terms of one kind can stand for each other.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("young", "old", "elderly"), ("disabled", "blind", "deaf"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)


def _names(words: Words, at: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(text, name) of each occurrence of a word, and of its beginnings of each length."""
    text, bare = words.text_of(), trimmed(words)
    if at is not None:
        text, bare = text[at], Words(bare.buffer, bare.start[at], bare.end[at], np.array([0, len(at)]))
    parts = [(text, mix(bare.hashes() ^ U64(1)))]
    for k in BEGINNINGS:
        long = np.flatnonzero(bare.end - bare.start >= k)
        head = Words(bare.buffer, bare.start[long], bare.start[long] + k, np.array([0, len(long)]))
        parts.append((text[long], mix(head.hashes() ^ U64(k))))
    return parts


def _with_repeats(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """All names, and one more for the longest beginnings that a text has twice, and three times."""
    text, name = parts[-1]
    order = np.lexsort((name, text))
    text, name = text[order], name[order]
    for times in (2, 3):
        again = np.flatnonzero((text[times - 1 :] == text[: len(text) - times + 1]) & (name[times - 1 :] == name[: len(name) - times + 1]))
        parts = [*parts, (text[again], mix(name[again] ^ U64(100 + times)))]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, name) of every word, of its beginnings, and of beginnings that occur again."""
    return _with_repeats(_names(words))


def _of_word(word: str) -> list[np.ndarray]:
    raw = word.lower().encode()
    buffer = np.frombuffer(raw + b" " * 16, np.uint8).copy()
    return [name for _, name in _names(Words(buffer, np.array([0]), np.array([len(raw)]), np.array([0, 1])))]


def swapped(swaps: dict[str, str]) -> Callable:
    """A featurizer of the twin texts: each term is replaced by what `swaps` has for it."""
    next_of = {int(_of_word(a)[0][0]): _of_word(b) for a, b in swaps.items()}
    known = np.array(sorted(next_of), U64)

    def run(words: Words) -> tuple[np.ndarray, np.ndarray]:
        whole = mix(trimmed(words).hashes() ^ U64(1))
        hit = np.isin(whole, known)
        parts = _names(words, np.flatnonzero(~hit))
        at, of = words.text_of()[hit], [next_of[int(h)] for h in whole[hit]]
        for k, (text, name) in enumerate(parts):
            new = [x[k] for x in of]
            parts[k] = np.concatenate([text, np.repeat(at, [len(x) for x in new]).astype(text.dtype)]), np.concatenate([name, *new])
        return _with_repeats(parts)

    return run


def whole_words(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, name) of every word alone."""
    return words.text_of(), mix(trimmed(words).hashes() ^ U64(1))


def neighbours(known: np.ndarray) -> Callable:
    """Texts to counts (term, bucket of a word next to it, n), for the words whose names are in `known`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                words = words_of(block.column("text"), True)
                bare, text = trimmed(words), words.text_of()
                name = mix(bare.hashes() ^ U64(1))
                hit = np.flatnonzero(np.isin(name, known) & (bare.end - bare.start <= TERM_BYTES))
                parts = []
                for side, step in enumerate((-1, 1)):
                    at = hit[(hit + step >= 0) & (hit + step < len(words))]
                    at = at[text[at + step] == text[at]]
                    parts.append((at, (name[at + step] % U64(CONTEXTS)).astype(np.int64) + side * CONTEXTS))
                at, bucket = (np.concatenate(x) for x in zip(*parts, strict=True))
                terms = pa.array([bare.bytes_of(i).decode(errors="replace") for i in at], pa.string())
                yield pa.RecordBatch.from_arrays([terms, pa.array(bucket.astype(np.int32))], ["term", "bucket"])

    return run


def most_alike(terms: np.ndarray, bucket: np.ndarray, n: np.ndarray) -> dict[str, str]:
    """For each term the other one with the most similar neighbours (cosine of root counts)."""
    names, row = np.unique(terms, return_inverse=True)
    if len(names) < 2:
        return {}
    v = np.zeros((len(names), 2 * CONTEXTS), np.float32)
    v[row, bucket] = np.sqrt(n)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    out = {}
    for first in range(0, len(names), 512):
        near = v[first : first + 512] @ v.T
        near[np.arange(len(near)), first + np.arange(len(near))] = -1
        out |= {str(names[first + i]): str(names[j]) for i, j in enumerate(near.argmax(1))}
    return out


def induce_swaps(sample: DataFrame, encoded: DataFrame, vocabulary: np.ndarray) -> dict[str, str]:
    """Terms of the labelled sample, each with the one to swap it for. `encoded` has the words of each
    text as f1; only terms and counts of their neighbours are collected, both bounded by the sample."""
    n, n1 = encoded.agg(F.count("y"), F.sum("y")).first()
    if not n1 or n1 == n:
        return {}
    counts = encoded.select("y", F.explode("f1").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("total"), F.sum("y").alias("ones"))
    zeros = F.col("total") - F.col("ones")
    mentioned = (zeros >= MIN_DOCS) & (F.col("ones") / n1 <= LIFT * zeros / (n - n1)) & (F.col("ones") / n1 > zeros / (n - n1))
    names = counts.filter(mentioned & (F.col("total") >= 2 * MIN_DOCS)).select("name").toArrow()["name"].to_numpy().view(U64)
    known = names[np.isin(names, vocabulary)]
    met = sample.select("text").mapInArrow(neighbours(known), "term string, bucket int").groupBy("term", "bucket").count().orderBy("term", "bucket").toArrow()
    return most_alike(met["term"].to_numpy(zero_copy_only=False).astype(str), met["bucket"].to_numpy(), met["count"].to_numpy())


def seeds(terms: tuple[tuple[str, ...], ...]) -> dict[str, str]:
    return {a: b for kind in terms for a, b in zip(kind, (*kind[1:], kind[0]), strict=True)}


def select_vocabulary(encoded: DataFrame) -> np.ndarray:
    """The features of `encoded` (y, and the distinct names f0 of each text) that tell the classes
    apart, sorted. They are counted on the executors, and only those are collected."""
    n, n1 = encoded.agg(F.count("y"), F.sum("y")).first()
    if not n1 or n1 == n:
        return np.empty(0, U64)
    counts = encoded.select("y", F.explode("f0").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("total"), F.sum("y").alias("ones"))
    expected = F.col("total") * (n1 / n)
    spread = expected * (1 - n1 / n) * F.greatest(1 - F.col("total") / n, F.lit(1e-9))
    chi = F.pow(F.greatest(F.abs(F.col("ones") - expected) - 0.5, F.lit(0.0)), 2) / F.greatest(spread, F.lit(1e-9))
    good = counts.filter((F.col("total") >= MIN_DOCS) & (chi >= CHI_SQUARE)).select("name").toArrow()
    return np.sort(good["name"].to_numpy().view(U64))


def _minimise(x: Rows, d: Rows, e: Rows, y: np.ndarray, width: int, decay: float, fairness: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Accelerated gradient on mean logistic loss + decay |w|^2 / 2 + fairness * mean squared
    (score of text - score of twin) / 2, where d and e hold what a text and its twin have alone."""
    n = len(y)

    def change(w: np.ndarray) -> np.ndarray:
        return d.dot(w) - e.dot(w)

    def curvature() -> float:
        v = np.random.default_rng(1).normal(size=width)
        top = 1.0
        for _ in range(30):
            v /= max(float(np.linalg.norm(v)), 1e-12)
            r = change(v)
            v = x.sum_rows(x.dot(v), width) / (4 * n) + fairness * (d.sum_rows(r, width) - e.sum_rows(r, width)) / n
            top = float(np.linalg.norm(v))
        return 1.1 * top + 0.25 + decay

    step = 1 / curvature()
    w, b = np.zeros(width), 0.0
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        r = (sigmoid(x.dot(v) + c) - y) / n
        diff = change(v)
        gw = x.sum_rows(r, width) + decay * v + fairness * (d.sum_rows(diff, width) - e.sum_rows(diff, width)) / n
        w2, b2 = v - step * gw, c - step * float(r.sum())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


def fit(vocabulary: np.ndarray, names: list[np.ndarray], lost: list[np.ndarray], gained: list[np.ndarray], y: np.ndarray, share: float, decay: float = 3e-5, fairness: float = FAIRNESS) -> Model:
    """The model of a sample over a sorted vocabulary; names[i] are the features of text i, lost[i] those
    that its twin has not, and gained[i] those that only the twin has."""
    if len(set(y.tolist())) < 2:
        return Model(np.empty(0, U64), np.empty(0), None, 0.0, 0.0, float(np.log(share / (1 - share))))
    w, b = _minimise(*(rows_over(vocabulary, x) for x in (names, lost, gained)), y.astype(float), len(vocabulary), decay, fairness)
    # the sample may hold more of label 1 than the corpus; a logistic score moves by the log odds
    prior = y.mean()
    shift = float(np.log(share / (1 - share)) - np.log(prior / (1 - prior)))
    return Model(vocabulary, w, None, b, 1.0, shift)


def train(
    docs: DataFrame, labels: DataFrame, label: str, learn: Column, sample: int = SAMPLE, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, fairness: float = FAIRNESS
) -> Model:
    """Fits on a bounded sample of the labelled documents that `learn` allows. Of the sample only
    what the vocabulary holds goes to the driver."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    scratch = Scratch(docs.sparkSession, "toxicity")
    schema = f"doc_id {kind}, y int, f0 array<long>, f1 array<long>"
    picked = scratch.keep(labelled_sample(docs, labels, label, learn, sample), "sample")
    encoded = scratch.keep(picked.mapInArrow(encode([features, whole_words], True), schema), "encoded")
    vocabulary = select_vocabulary(encoded)
    swaps = induce_swaps(picked, encoded, vocabulary) | seeds(terms)
    rows = picked.mapInArrow(encode([features, swapped(swaps)], True, vocabulary), schema)
    rows = rows.select("doc_id", "y", "f0", *(F.coalesce(F.array_except(*two), F.array().cast("array<long>")).alias(name) for name, two in (("lost", ("f0", "f1")), ("gained", ("f1", "f0")))))
    rows = rows.toArrow().sort_by("doc_id")
    scratch.drop("sample", "encoded")
    names, lost, gained = ([v.values.to_numpy().view(U64) for v in rows[c]] for c in ("f0", "lost", "gained"))
    y = rows["y"].to_numpy().astype(int)
    order = np.random.default_rng(3).permutation(len(y))
    return fit(vocabulary, *([x[i] for i in order] for x in (names, lost, gained)), y[order], class_share(labels, label, learn), fairness=fairness)


def score_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, buckets: int = 3, held: int = 1, cut: float = 0.7) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted. Rows whose crc32(doc_id) modulo
    `buckets` is `held` are never learnt from."""
    learn = crc_bucket(F.col("doc_id"), buckets) != held
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    model = train(docs, labels, "toxic", learn, sample)
    scored = score_texts(docs, model, features, True)
    return scored.select("doc_id", (~learn).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, buckets: int = 3, held: int = 1, cut: float = 0.7) -> DataFrame:
    """`docs` without those that `score_toxicity` predicts to be toxic."""
    learn = crc_bucket(F.col("doc_id"), buckets) != held
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    return filter_texts(docs, train(docs, labels, "toxic", learn, sample), features, True, cut)
