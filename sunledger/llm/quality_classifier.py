"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Each n-gram f has the log-count ratio r_f = log((a + p_f) / |a + p|) - log((a + q_f) / |a + q|),
p and q counting the good and the bad training documents that hold it. A document is the vector
of its indicators scaled by r, of unit length; a linear model with hinge loss is fitted by dual
coordinate descent and turned into a probability by Platt's method on rows held back.

n-grams are words, pairs of words, and runs of one to three word shapes. A shape says how a word
is written (capitals, digits, symbols, closing marks, length) and whether it repeats its
predecessor; so junk made of words never seen before is still known by its form.

Fitted on at most 2 * SAMPLE labelled documents. The vocabulary is every n-gram that MIN_DOCS of them
hold; it is counted on the executors, and of the sample only what the vocabulary holds goes to the
driver. Scoring covers every whole text. Defined results:
null and empty texts get the score of a text without words; with labels of one class only, or
none, every score is the share of label 1; repeated rows get equal scores.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .classify import Model, calibrate, class_share, crc_bucket, encode, labelled_sample, ngram, rows_over, score_texts, trimmed, within
from .scratch import Scratch
from .words import U64, Words, mix

#: Labelled documents of each class that the fit takes at most.
SAMPLE = 3000
#: An n-gram that fewer documents of the sample hold is not in the vocabulary.
MIN_DOCS = 3

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>{}@~^=+_/\\")] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_CLOSE = np.zeros(256, np.int64)
for _i, _c in enumerate(b".,;:!?"):
    _CLOSE[_c] = _i + 1


def shapes(words: Words, hashes: np.ndarray) -> np.ndarray:
    """One small number per word for how it is written."""

    def count(kind: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(kind[words.buffer], dtype=np.int32)])
        return sums[words.end] - sums[words.start]

    size = words.end - words.start
    upper, digit, symbol = (np.minimum(count(k), 2) for k in (_UPPER, _DIGIT, _SYMBOL))
    repeat = np.zeros(len(words), np.int64)
    repeat[1:] = hashes[1:] == hashes[:-1]
    wide = np.digitize(size, [2, 4, 8, 16, 40])
    out = upper
    for part, base in ((digit, 3), (symbol, 3), (_CLOSE[words.buffer[words.end - 1]], 7), (repeat, 2), (wide, 6)):
        out = out * base + part
    return out.astype(U64)


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, name) of every n-gram, and one for the text's length in powers of two."""
    text, whole = words.text_of(), words.hashes()
    word, shape = trimmed(words).hashes(), mix(shapes(words, whole) + U64(1))
    number = np.arange(len(words.first) - 1)
    length = mix(np.ceil(np.log2(np.diff(words.first) + 1)).astype(U64) + U64(0xABCDEF00))
    parts = [(number, length), ngram(word, text, 1, 11), ngram(word, text, 2, 12), *(ngram(shape, text, n, 20 + n) for n in (1, 2, 3))]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def dual_coordinate_descent(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, width: int, c: float, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """w that minimises |w|^2 / 2 + c * sum of hinge losses; the last column is the bias.

    One dual variable at a time, in random order, is set to its optimum given the others and
    clipped to 0 .. c; w follows (Hsieh et al., 2008)."""
    w, alpha = np.zeros(width + 1), np.zeros(len(y))
    sign = np.where(y == 1, 1.0, -1.0)
    norm = np.array([v @ v + 1.0 for _, v in x])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(y)):
            at, v = x[i]
            g = sign[i] * (w[at] @ v + w[-1]) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), c)
            if new != alpha[i]:
                d = (new - alpha[i]) * sign[i]
                w[at] += d * v
                w[-1] += d
                worst = max(worst, abs(new - alpha[i]))
                alpha[i] = new
        if worst < 1e-4 * c:
            break
    return w


def fit(vocabulary: np.ndarray, names: list[np.ndarray], y: np.ndarray, share: float, c: float = 1.0, smooth: float = 1.0) -> Model:
    """The model of a sample over a sorted vocabulary: names[i] are the distinct n-grams of a document with label y[i]."""
    if len(set(y.tolist())) < 2:
        return Model(np.empty(0, U64), np.empty(0), None, 0.0, 0.0, float(np.log(share / (1 - share))))
    rows = rows_over(vocabulary, names)
    p, q = (smooth + rows.sum_rows((y == k).astype(float), len(vocabulary)) for k in (1, 0))
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    x = []
    for a, b in zip(rows.at[:-1], rows.at[1:], strict=True):
        v = ratio[rows.column[a:b]]
        x.append((rows.column[a:b], v / max(float(np.sqrt(v @ v)), 1e-6)))
    back = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    train = np.flatnonzero(~back)
    w = dual_coordinate_descent([x[i] for i in train], y[train], len(vocabulary), c)
    held = np.flatnonzero(back) if back.any() and len(set(y[back].tolist())) == 2 else np.arange(len(y))
    margins = np.array([w[x[i][0]] @ x[i][1] + w[-1] for i in held])
    scale, shift = calibrate(margins, y[held], share)
    return Model(vocabulary, w[:-1] * ratio, ratio * ratio, float(w[-1]), scale, shift)


def train(docs: DataFrame, labels: DataFrame, label: str, learn: Column, sample: int = SAMPLE) -> Model:
    """Fits on a bounded sample of the labelled documents that `learn` allows."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    scratch = Scratch(docs.sparkSession, "quality")
    schema = f"doc_id {kind}, y int, f0 array<long>"
    encoded = scratch.keep(labelled_sample(docs, labels, label, learn, sample).mapInArrow(encode([features], False), schema), "sample")
    least = min(MIN_DOCS, encoded.count())
    often = encoded.select(F.explode("f0").alias("name")).groupBy("name").count().filter(F.col("count") >= least).select("name")
    vocabulary = np.sort(often.toArrow()["name"].to_numpy().view(U64))
    rows = encoded.mapInArrow(within(vocabulary, ("f0",)), schema).toArrow().sort_by("doc_id")
    scratch.drop("sample")
    names = [v.values.to_numpy().view(U64) for v in rows["f0"]]
    y = rows["y"].to_numpy().astype(int)
    order = np.random.default_rng(3).permutation(len(y))  # doc_id must not decide who is held back
    return fit(vocabulary, [names[i] for i in order], y[order], class_share(labels, label, learn))


def score_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, buckets: int = 4, held: int = 2, cut: float = 0.7) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted. Rows whose crc32(doc_id) modulo
    `buckets` is `held` are never learnt from."""
    learn = crc_bucket(F.col("doc_id"), buckets) != held
    labels = labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
    model = train(docs, labels, "quality", learn, sample)
    scored = score_texts(docs, model, features, False)
    return scored.select("doc_id", (~learn).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
