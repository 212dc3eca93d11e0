"""Vector code compression: product codes, assigned through segment-mean lower bounds.

Vectors become integers, are cut into equal parts, and each part is replaced by the number of the nearest entry
of its position's codebook. Which entries are near is found from coarse to fine: a part and an entry that are
cut into segments are at least as far apart as their segments' means and residual norms say,

    |v - c|^2  >=  sum over segments of  m (mean v - mean c)^2 + (|v - mean v| - |c - mean c|)^2,

so an entry whose bound exceeds the exact distance of a good candidate is out. Bounds are floating point with
a margin that covers their rounding, and only filter; survivors get exact integer distances, so codes,
sums and codebooks are exact, and reruns agree however rows lie.

A codebook has entries x length numbers, whatever the data: it travels with the tasks. Sums of a round are
added up in each task, then by Spark, and come to the driver as entries x length rows.

Defined results: vectors that are null or hold null or non-finite components have no row; a vector that is shorter
than the longest, or a length that the parts don't divide, is filled up with zeros at its end; null ids come
last among the first entries; with fewer vectors than entries a codebook is as short; null labels are one
label; components beyond +-65536 are an error, as sums would not fit a long; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .skew import join_counted

#: Rows compared with a codebook at once.
ROWS = 4_096
LIMIT = 1 << 24
#: Bounds are lowered by this share of the squared norms, some thousand times what rounding may cost.
MARGIN = 1e-11
#: With fewer pairs left than this share, bounds are taken pair by pair.
SPARSE = 0.1


def integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, exact; null if the vector or a component is null or not finite."""
    usable = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    fits = F.transform(scaled, lambda x: F.when(F.abs(x) <= LIMIT, x.cast("int")).otherwise(F.raise_error(F.lit("a component is too large")).cast("int")))
    return F.when(F.coalesce(usable, F.lit(False)), fits)


def segments(length: int) -> list[list[int]]:
    """From one segment on, twice as many at each level, as long as segments have two components or more:
    the first component of each."""
    levels, n = [], 1
    while 2 * n <= length:
        levels.append([i * length // n for i in range(n)])
        n *= 2
    return levels


def summary(x: np.ndarray, starts: list[int]) -> np.ndarray:
    """Per segment of each row the mean times the root of its size, then per segment the residual norm: the squared
    distance of two summaries is the bound on the rows' own."""
    size = np.diff([*starts, x.shape[1]])
    total, square = np.add.reduceat(x, starts, 1), np.add.reduceat(x * x, starts, 1)
    return np.hstack([total / np.sqrt(size), np.sqrt((size * square - total * total) / size)])


def assign(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row (ties to the lower number) and its squared distance, exact.

    At each level the entry with the lowest bound gives a distance that the answer cannot exceed. While
    many pairs are left bounds are taken for all by one product of matrices, later for those that are left."""
    x, entries = x.astype(np.int64), entries.astype(np.int64)
    k, every = len(entries), np.arange(len(x))
    near, most = np.ones((len(x), k), bool), np.full(len(x), np.iinfo(np.int64).max)
    row, entry = None, None
    for starts in segments(x.shape[1]):
        v, c = summary(x, starts), summary(entries, starts)
        of_v, of_c = (v * v).sum(1), (c * c).sum(1)
        if row is None:
            bound = np.where(near, (1 - MARGIN) * of_v[:, None] + ((1 - MARGIN) * of_c - 1e-6) - 2 * (v @ c.T), np.inf)
            guess = bound.argmin(1)
        else:
            bound = ((v[row] - c[entry]) ** 2).sum(1) - MARGIN * (of_v[row] + of_c[entry]) - 1e-6
            lowest = np.lexsort((bound, row))[np.searchsorted(row, every)]
            guess = entry[lowest]
        most = np.minimum(most, ((x - entries[guess]) ** 2).sum(1))
        if row is None:
            near = bound <= most[:, None]
            if near.mean() < SPARSE:
                row, entry = np.nonzero(near)
        else:
            left = bound <= most[row]
            row, entry = row[left], entry[left]
    if row is None:
        row, entry = np.nonzero(near)
    distance = ((x[row] - entries[entry]) ** 2).sum(1)
    best = np.minimum.reduceat(distance * k + entry, np.searchsorted(row, every))  # what gave `most` is never out
    return best % k, best // k


@dataclass(frozen=True)
class Codebooks:
    """Entries of each part position: parts x entries x length."""

    entries: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all components in decimal, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def assign(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(part, rows of the part, codes, squared distances)."""
        length = self.entries.shape[2]
        for part, book in enumerate(self.entries):
            own = x[:, part * length : (part + 1) * length]
            yield part, own, *assign(own, book)


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            block = batch.slice(at, ROWS)
            yield block, block["v"].flatten().to_numpy().reshape(-1, width)


def round_sums(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
    """What a task's vectors add to each entry: (part, entry, at, total, n) for each component."""
    parts, k, length = books.entries.shape
    totals, n = np.zeros((parts, k, length), np.int64), np.zeros((parts, k), np.int64)
    for _, x in _blocks(batches, parts * length):
        for part, own, code, _ in books.assign(x):
            n[part] += np.bincount(code, minlength=k)
            np.add.at(totals[part], code, own)
    part, entry = np.nonzero(n)
    flat = lambda a: pa.array(np.repeat(a, length), pa.int32())
    yield pa.RecordBatch.from_arrays(
        [flat(part), flat(entry), pa.array(np.tile(np.arange(length), len(part)), pa.int32()), pa.array(totals[part, entry].ravel()), pa.array(np.repeat(n[part, entry], length))],
        ["part", "entry", "at", "total", "n"],
    )


def encode_blocks(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
    """The columns of each row but its vector, with code (a byte for each part) and error."""
    parts, _, length = books.entries.shape
    for block, x in _blocks(batches, parts * length):
        codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
        for part, _, code, distance in books.assign(x):
            codes[:, part] = code
            error += distance
        ends = np.arange(0, codes.size + 1, parts, dtype=np.int32)
        code = pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(codes)])
        kept = block.drop_columns(["v"])
        yield pa.RecordBatch.from_arrays([*kept.columns, code, pa.array(error)], [*kept.schema.names, "code", "error"])


def integer_vectors(df: DataFrame, vector: str, parts: int, scratch: Scratch) -> DataFrame:
    """Rows whose vector can be used, with `v`: its integers, all of one length that the parts divide."""
    rows = scratch.keep(df.withColumn("v", integers(F.col(vector))).drop(vector).filter("v is not null"), "integers")
    shortest, longest = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    width = max(1, -(-(longest or 1) // parts)) * parts
    return rows if shortest == width else rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0), F.lit(width) - F.size("v"))))


def train(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, order: str = "vec_id") -> Codebooks | None:
    """Codebooks that begin as the parts of the first vectors by `order` and are moved to the floored means of what they
    are nearest to, `rounds` times; an entry that nothing is near stays. None if there are no vectors."""
    if entries > 256:
        raise ValueError("a code is a byte: at most 256 entries")
    first = np.array([r["v"] for r in vectors.select("v", order).orderBy(F.col(order).asc_nulls_last(), "v").limit(entries).collect()], np.int64)
    if not len(first):
        return None
    books = Codebooks(first.reshape(len(first), parts, -1).transpose(1, 0, 2).copy())
    for _ in range(rounds):
        sums = vectors.select("v").mapInArrow(lambda b, books=books: round_sums(b, books), "part int, entry int, at int, total long, n long")
        moved = books.entries.copy()
        for r in sums.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            moved[r["part"], r["entry"], r["at"]] = r["total"] // r["n"]
        books = Codebooks(moved)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """The columns of `vectors` but `v`, with code (binary, a byte for each part) and error (squared distance)."""
    kinds = [f for f in vectors.schema.fields if f.name != "v"]
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), "code binary", "error long"])
    return vectors.select(*(f"`{f.name}`" for f in kinds), "v").mapInArrow(lambda b: encode_blocks(b, books), out)


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """`codes` with `v`: the entries that the code stands for, one after another."""
    book = F.array(*(F.array(*(F.array(*(F.lit(int(x)) for x in entry)) for entry in part)) for part in books.entries))
    code = F.hex("code")
    byte = lambda i: F.conv(F.substr(code, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
    return codes.withColumn("v", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(len(books.entries) - 1)), lambda i: F.get(F.get(book, i), byte(i)))))


def compress(spark: SparkSession, df: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """Per usable vector: vec_id, code (hex), error, label_error (summed over equal labels) and codebooks_sha256."""
    scratch = Scratch(spark, "codes")
    vectors = integer_vectors(df.select(df["vec_id"], df["embedding"], df["label"]), "embedding", parts, scratch)
    books = train(vectors, parts, entries, rounds)
    if books is None:
        return spark.createDataFrame([], f"vec_id {df.schema['vec_id'].dataType.simpleString()}, code string, error long, label_error long, codebooks_sha256 string")
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    rows = scratch.keep(encode(vectors, books).withColumn("key", key), "codes")
    sums = scratch.keep(rows.groupBy("key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "labels")
    joined = join_counted(rows, sums, "key", "n", rows.count())
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
