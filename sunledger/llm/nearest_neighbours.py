"""Nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots: near vectors see the pivots in nearly
the same order. Rows are dealt to segments by a hash of their id; a segment posts each of its
vectors, with the rank, in the inverted file of each of its PREFIX nearest pivots, an eighth of
all. A query is routed to the files of its own nearest pivots alone and adds up, pivot by pivot, what
the footrule distance of the two orders lacks to its maximum; a vector that shares none of them is
not touched. Of each segment the nearest SHARE by footrule, and MORE for each neighbour asked for,
are reranked by exact inner product: one law at every size.

Pivots are a bounded sample; every row is indexed. Segments stay where they are and blocks of queries
come to them, so no task holds all queries or all rows, and what is shuffled is each segment once and
each query once for a segment. Equal vectors of a segment share one entry with all their ids, so a
vector that a third of all rows repeat takes one place among the candidates. Every query asks every
segment: the work grows with queries times rows, as with any index that leaves a share to rerank.

Defined results: null ids and vectors that are null, zero, of another length than the pivots', or
hold a null or non-finite component take no part; of several rows with one id the least vector
counts; ties go to the smaller id; with fewer candidates than asked for all are returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

PIVOTS = 512
PREFIX = 64
#: The share of a segment that is reranked, and how many more for each neighbour asked for.
SHARE = 0.15
MORE = 2
#: Rows of a segment and queries of a block, about.
SEGMENT = 8192
QUERY_BLOCK = 1024


def usable(vector: Column, size: int) -> Column:
    """Whether a vector takes part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & (F.size(vector) == size) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def choose_pivots(rows: DataFrame, number: int, pivots: int) -> np.ndarray:
    """At most `pivots` distinct vectors of `number` rows, the first by a hash of their id: unit vectors. A
    threshold on the hash leaves a few times that many before any are gathered."""
    share = min(1.0, (3 * pivots + 100) / max(number, 1))
    luck = F.shiftrightunsigned(F.xxhash64("id"), 11) / float(1 << 53)
    few = rows.select("id", "vector", luck.alias("luck")).filter(F.col("luck") <= share).orderBy("luck", "id").limit(4 * pivots).select("vector").toArrow()["vector"]
    found = np.array([v.as_py() for v in few], np.float64).reshape(len(few), -1)
    if not len(found):
        return found
    _, first = np.unique(found, axis=0, return_index=True)
    found = found[np.sort(first)[:pivots]]
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def pivot_order(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The `prefix` nearest pivots of each vector, nearest first."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :prefix].astype(np.int16)


def _pack(pivots, prefix: int) -> Callable:
    """A group of rows to one row of arrays as bytes: distinct vectors, their pivots, their ids."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        vectors = np.stack(table["vector"].to_numpy()).astype(np.float64)
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        distinct, first, of = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
        by = np.argsort(first, kind="stable")  # entries in the order of their smallest id
        number = np.empty_like(by)
        number[by] = np.arange(len(by))
        distinct, of = distinct[by], number[of.ravel()]
        members = np.argsort(of, kind="stable")
        starts = np.searchsorted(of[members], np.arange(len(distinct) + 1))
        parts = [distinct, pivot_order(distinct, pivots.value, prefix), ids[members], starts.astype(np.int64)]
        return pa.table({"at": pa.array([key[0].as_py()], pa.int32()), **{n: pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for n, p in zip(PARTS, parts, strict=True)}})

    return run


PARTS = ("vectors", "orders", "ids", "starts")
PACKED = "at int, " + ", ".join(f"{p} binary" for p in PARTS)


def _unpack(row: dict, prefix: str, size: int) -> tuple[np.ndarray, ...]:
    v, o, i, s = (np.frombuffer(row[f"{prefix}{p}"], t) for p, t in zip(PARTS, (np.float64, np.int16, np.int64, np.int64), strict=True))
    n = len(s) - 1
    return v.reshape(n, size), o.reshape(n, -1), i, s


def inverted_files(orders: np.ndarray, pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, entry, left): pivot p's file is at[p] .. at[p + 1], the entries that have p in their order, each
    with how many places its rank leaves to the prefix."""
    n, prefix = orders.shape
    flat = orders.ravel()
    by = np.argsort(flat, kind="stable")
    return np.searchsorted(flat[by], np.arange(pivots + 1)), (by // prefix).astype(np.int32), (prefix - by % prefix).astype(np.int32)


def footrule_scores(order: np.ndarray, files: tuple[np.ndarray, np.ndarray, np.ndarray], entries: int) -> np.ndarray:
    """What the footrule distance to each entry lacks to its maximum, halved.

    With l(p) the places a pivot's rank leaves to the prefix (0 beyond it), the distance is
    sum |l(p) - l'(p)| = const - 2 sum min(l(p), l'(p)), and only shared pivots add to the sum."""
    at, entry, left = files
    met = [slice(at[p], at[p + 1]) for p in order]
    least = [np.minimum(left[m], len(order) - rank) for rank, m in enumerate(met)]
    return np.bincount(np.concatenate([entry[m] for m in met]), np.concatenate(least), entries)


def _search(size: int, pivots: int, k: int, share: float, more: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_buffer() for c in batch.schema.names if c not in ("at", "block")}
                if batch.column("at")[i].as_py() != segment:  # blocks of one segment follow each other
                    segment = batch.column("at")[i].as_py()
                    vectors, orders, ids, starts = (x.copy() for x in _unpack(row, "", size))
                    files = inverted_files(orders, pivots)
                n = len(vectors)
                wanted = min(n, int(np.ceil(share * n)) + more * (k + 1))
                out: tuple[list, list, list] = ([], [], [])
                queries, query_orders, query_ids, query_starts = _unpack(row, "q_", size)
                for q, order, a, b in zip(queries, query_orders, query_starts[:-1], query_starts[1:], strict=True):
                    # equal footrules: the smaller id first, as entries are sorted by it
                    near = np.arange(n) - footrule_scores(order, files, n).astype(np.int64) * n
                    near = np.sort(np.argpartition(near, wanted - 1)[:wanted])
                    rough = vectors[near] @ q  # its last bits depend on where a row lies
                    if len(near) > k + 33:
                        near = near[np.argpartition(-rough, k + 32)[: k + 33]]
                    score = (vectors[near] * q).sum(1)
                    best = np.lexsort((ids[starts[near]], -score))[: k + 1]
                    # k + 1 ids of each entry suffice, one of which may be the query's own
                    few = [ids[starts[e] : min(starts[e + 1], starts[e] + k + 1)] for e in near[best]]
                    found, scores = np.concatenate(few), np.repeat(score[best], [len(f) for f in few])
                    top = np.lexsort((found, -scores))[: 2 * k + 2]
                    for query in query_ids[a:b]:
                        mine = top[found[top] != query][:k]
                        out[0].append(np.full(len(mine), query))
                        out[1].append(found[mine])
                        out[2].append(scores[mine])
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["query_id", "vec_id", "score"])

    return run


def nearest(
    spark: SparkSession, table: DataFrame, queries: Column, id_column: str = "vec_id", vector: str = "embedding", k: int = 20,
    pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE, more: int = MORE, segment: int = SEGMENT,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows, other than itself, of each row for
    which `queries` (a condition on column `id`) holds."""
    scratch = Scratch(spark, "nearest")
    empty = "query_id long, rank int, vec_id long, score double"
    rows = table.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).filter("id is not null and size(vector) > 0")
    size = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is None:
        return spark.createDataFrame([], empty)
    size = size["n"]
    rows = rows.filter(usable(F.col("vector"), size)).groupBy("id").agg(F.min("vector").alias("vector"))
    rows = scratch.keep(rows, "rows")
    number = rows.count()
    found = choose_pivots(rows, number, pivots)
    if not len(found):
        return spark.createDataFrame([], empty)
    prefix = min(prefix, len(found))
    shared = spark.sparkContext.broadcast(found)  # at most `pivots` vectors

    count = number // segment + 1
    segment_of = F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")

    def packed(df: DataFrame, at: Column, name: str) -> DataFrame:
        return scratch.keep(df.withColumn("at", at).groupBy("at").applyInArrow(_pack(shared, prefix), PACKED), name)

    segments = packed(rows, segment_of, "segments")
    asked = rows.filter(queries)
    many = asked.count() // QUERY_BLOCK + 1
    asked = packed(asked, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(many)).cast("int"), "blocks")
    # each block of queries comes to each segment, where that lies; one row of bytes on either side
    asked = asked.select(F.col("at").alias("block"), *(F.col(p).alias(f"q_{p}") for p in PARTS))
    asked = asked.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    met = asked.repartition(count, "at").join(segments.repartition(count, "at"), "at").select("at", "block", *PARTS, *(f"q_{p}" for p in PARTS))
    hits = met.mapInArrow(_search(size, len(found), k, share, more), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
