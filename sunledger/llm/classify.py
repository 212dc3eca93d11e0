"""What the text classifiers share: features as 64-bit names, labelled samples, calibration."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import U64, Words, blocks, mix, pair, words_of

#: Features of a block of texts: (text number, feature name) for each occurrence.
Featurizer = Callable[[Words], tuple[np.ndarray, np.ndarray]]

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b".,;:!?\"'()[]")] = True


def trimmed(words: Words) -> Words:
    """The words without up to three punctuation marks at either end; one byte at least stays."""
    start, end = words.start.copy(), words.end.copy()
    for _ in range(3):
        end -= (end - start > 1) & _PUNCTUATION[words.buffer[end - 1]]
        start += (end - start > 1) & _PUNCTUATION[words.buffer[start]]
    return Words(words.buffer, start, end, words.first)


def crc_bucket(doc_id: Column, buckets: int) -> Column:
    """crc32 of doc_id as text, modulo `buckets`; a null doc_id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(buckets))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int) -> DataFrame:
    """(doc_id, text, y): at most `per_class` labelled documents of each class among those that `learn`
    (a condition on doc_id) allows, the first by a hash of doc_id, so reruns agree. Of rows that share a
    doc_id the text with the least hash counts, so the bound holds for rows too.

    The bound keeps the fit on one machine; it is the sample's size, not a cap on what is scored.
    """
    rows = labels.filter(learn & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("y"))
    picked = None
    for y in (0, 1):
        some = rows.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    # bounded: 2 * per_class ids
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "y")


def class_share(labels: DataFrame, label: str, learn: Column) -> float:
    """The share of label 1 among the rows to learn from (0.5 without any)."""
    n, ones = labels.filter(learn & F.col(label).isin(0, 1)).agg(F.count(F.lit(1)), F.sum(label)).first()
    return ((ones or 0) + 1) / (n + 2)


def distinct(text: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature of each text once."""
    order = np.lexsort((name, text))
    text, name = text[order], name[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (name[1:] != name[:-1])
    return text[new], name[new]


def in_vocabulary(vocabulary: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which names the sorted vocabulary holds."""
    if not len(vocabulary):
        return np.zeros(len(names), bool)
    return vocabulary[np.minimum(np.searchsorted(vocabulary, names), len(vocabulary) - 1)] == names


def encode(featurizers: list[Featurizer], lower: bool, vocabulary: np.ndarray | None = None) -> Callable:
    """Rows (doc_id, text, y) to (y, and for each featurizer the distinct feature names, of the
    vocabulary alone if one is given). Where a later featurizer finds what the first does, as for most
    twins, its list is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                words = words_of(block.column("text"), lower)
                columns, lists = [block.column("doc_id"), block.column("y")], []
                for featurizer in featurizers:
                    text, name = featurizer(words)
                    if vocabulary is not None:
                        some = in_vocabulary(vocabulary, name)
                        text, name = text[some], name[some]
                    text, name = distinct(text, name)
                    at = np.searchsorted(text, np.arange(block.num_rows + 1))
                    own = [name[a:b].view(np.int64) for a, b in zip(at[:-1], at[1:], strict=True)]
                    lists.append(own if not lists else [None if np.array_equal(x, y) else x for x, y in zip(own, lists[0], strict=True)])
                    columns.append(pa.array(lists[-1], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "y", *(f"f{i}" for i in range(len(featurizers)))])

    return run


def within(vocabulary: np.ndarray, columns: tuple[str, ...]) -> Callable:
    """Encoded rows whose lists hold only names of the sorted vocabulary; null lists stay null."""

    def known(v: np.ndarray) -> np.ndarray:
        return v[in_vocabulary(vocabulary, v.view(U64))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for column in columns:
                lists = [known(v.values.to_numpy()) if v.is_valid else None for v in batch.column(column)]
                batch = batch.set_column(batch.schema.get_field_index(column), column, pa.array(lists, pa.list_(pa.int64())))
            yield batch

    return run


@dataclass
class Rows:
    """Sparse indicator rows over a vocabulary: row i has the columns at[i] .. at[i + 1]."""

    at: np.ndarray
    column: np.ndarray

    def dot(self, w: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(w[self.column])])
        return sums[self.at[1:]] - sums[self.at[:-1]]

    def sum_rows(self, r: np.ndarray, width: int) -> np.ndarray:
        """The transposed product."""
        return np.bincount(self.column, np.repeat(r, np.diff(self.at)), width)


def rows_over(vocabulary: np.ndarray, lists: list[np.ndarray]) -> Rows:
    """Rows of the names that the sorted vocabulary holds."""
    found = []
    for names in lists:
        i = np.minimum(np.searchsorted(vocabulary, names), max(len(vocabulary) - 1, 0))
        found.append(i[vocabulary[i] == names] if len(vocabulary) else i[:0])
    return Rows(np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64), np.concatenate([*found, np.empty(0, np.int64)]).astype(np.int64))


@dataclass
class Model:
    """score = sigmoid(scale * margin + shift), margin a sum of weights over distinct features;
    `squares` (if any) are summed likewise and their root divides the margin."""

    vocabulary: np.ndarray  # sorted names
    weight: np.ndarray
    squares: np.ndarray | None
    bias: float
    scale: float
    shift: float

    def __post_init__(self):
        self.maybe = np.zeros(1 << 20, bool)  # by the top 20 bits: most names are in no vocabulary
        self.maybe[(self.vocabulary >> U64(44)).astype(np.int64)] = True

    def margins(self, text: np.ndarray, name: np.ndarray, texts: int) -> np.ndarray:
        size = len(self.vocabulary)
        if not size:
            return np.full(texts, self.bias)
        some = np.flatnonzero(self.maybe[(name >> U64(44)).astype(np.int64)])
        text, name = text[some], name[some]
        i = np.minimum(np.searchsorted(self.vocabulary, name), size - 1)
        hit = self.vocabulary[i] == name
        key = text[hit] * size + i[hit]
        if texts * size <= 1 << 26:
            seen = np.zeros(texts * size, bool)
            seen[key] = True
            key = np.flatnonzero(seen)
        else:
            key = np.unique(key)
        text, i = key // size, key % size
        total = np.bincount(text, self.weight[i], texts)
        if self.squares is not None:
            total /= np.sqrt(np.maximum(np.bincount(text, self.squares[i], texts), 1e-12))
        return total + self.bias

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * margins + self.shift)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def calibrate(margins: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Platt's (scale, shift) for margins of a sample, moved to the true share of label 1."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    spread = margins.std() or 1.0
    x = np.stack([margins / spread, np.ones(len(y))], 1)
    w = np.zeros(2)
    for _ in range(100):
        p = sigmoid(x @ w)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (p - target) + 1e-6 * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    prior = (n1 + 1) / (len(y) + 2)
    return float(w[0] / spread), float(w[1] + np.log(share / (1 - share)) - np.log(prior / (1 - prior)))


def score_texts(docs: DataFrame, model: Model, featurizer: Featurizer, lower: bool) -> DataFrame:
    """(doc_id, score) of every row; the model, of bounded size, goes to the executors once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                words = words_of(block.column("text"), lower)
                score = shared.value.scores(shared.value.margins(*featurizer(words), block.num_rows))
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def filter_texts(docs: DataFrame, model: Model, featurizer: Featurizer, lower: bool, cut: float) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text scores below `cut`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                words = words_of(block.column("text"), lower)
                score = shared.value.scores(shared.value.margins(*featurizer(words), block.num_rows))
                yield block.filter(pa.array(score < cut))

    return docs.mapInArrow(run, docs.schema)


def ngram(names: np.ndarray, text: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of one name per word, within texts."""
    if len(names) < n:
        return text[:0], names[:0]
    out = mix(names[: len(names) - n + 1] ^ U64(salt))
    for k in range(1, n):
        out = pair(out, names[k : len(names) - n + 1 + k], salt)
    inside = text[: len(out)] == text[n - 1 :]
    return text[: len(out)][inside], out[inside]
