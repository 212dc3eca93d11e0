"""How far the sources of a language differ in their words: exact divergences by integer-dictionary encoding.

Terms are runs of letters (A to Z in any case, and all characters from U+0080 on), counted for each language
and source on the executors. The counts are range-partitioned by language and term, so each partition holds
a stretch of the sorted dictionary with all counts of its terms. A stretch is encoded against its sorted
array of kept terms: ids come by `searchsorted`, and a `bincount` per source gives dense vectors whose
positions are in UTF-8 order, so ties need no strings. Vectors of a stretch are compared on their own; partial
sums of pairs and the first terms of each stretch are merged by Spark.

Nothing passes whole through a task or the driver: a stretch has at most CELLS / sources terms, and the
vocabulary never leaves the executors. One row holds the sources of one language with their totals;
the result has a row for each pair of them anyway.

Defined results: null text, language and source are ''; a text without terms still makes its group occur;
repeated rows count as documents of their own; an empty table gives no rows. Sums are exact up to 9e15
occurrences in a language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import LOWER, blocks

#: Terms by sources that one stretch holds.
CELLS = 1 << 18
#: Texts are counted in blocks of about so many bytes; so many counts are merged, or encoded, at once.
BLOCK_BYTES, MERGED = 4_000_000, 400_000
#: Kept terms occur in so many documents of their language.
MIN_DOCS = 3
#: Shares are in units of 1 / SCALE.
SCALE_STEPS = (1000, 1000, 1000)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms_of(texts: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The terms of all texts, A to Z lower-cased, and the number of each term's text."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    if hi == lo:
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    raw, offsets = LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[lo:hi]], offsets - lo
    inside = _LETTER[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[offsets < hi - lo]
    begins[cuts] = inside[cuts]  # a term does not go on in the next text
    start = np.flatnonzero(begins)
    letters = np.concatenate([[0], np.cumsum(inside)])  # terms without what lies between them
    ends = np.concatenate([letters[start], letters[-1:]]).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(raw[inside]))
    return found, np.searchsorted(offsets, start, side="right") - 1


def _codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def count_block(block: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of a block of (lang, source, text)."""
    found, text = terms_of(block["text"].cast(pa.large_string()))
    term, terms = _codes(found)
    (lang, langs), (source, sources) = _codes(block["lang"]), _codes(block["source"])
    group = lang * max(len(sources), 1) + source
    width = max(len(terms), 1)
    key, n = np.unique(group[text] * width + term, return_counts=True)
    once = np.unique(text * width + term)
    docs = np.unique(group[once // width] * width + once % width, return_counts=True)[1]  # of the same keys
    of = key // width
    return pa.table({
        "lang": langs.take(pa.array(of // max(len(sources), 1))), "source": sources.take(pa.array(of % max(len(sources), 1))),
        "term": terms.take(pa.array(key % width)), "n": n.astype(np.int64), "docs": docs.astype(np.int64),
    }, COUNTS_ARROW)


COUNTS = "lang string, source string, term string, n long, docs long"
COUNTS_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.large_string()), ("n", pa.int64()), ("docs", pa.int64())])


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's texts, merged before they are sent on."""
    waiting: list[pa.Table] = []
    merge = lambda: pa.concat_tables(waiting).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(COUNTS_ARROW.names)
    for batch in batches:
        for block in blocks(batch, "text", BLOCK_BYTES):
            waiting.append(count_block(block))
            if sum(map(len, waiting)) > MERGED:
                merged = merge()
                if len(merged) > MERGED // 2:
                    yield from merged.to_batches(max_chunksize=50_000)
                    waiting = []
                else:
                    waiting = [merged]
    if waiting:
        yield from merge().to_batches(max_chunksize=50_000)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and documents that hold it."""
    plain = docs.select(*(F.coalesce(docs[c], F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return plain.mapInArrow(count_terms, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


STRETCH = "lang string, terms array<string>, sources array<string>, counts array<long>"


def encode_stretches(batches: Iterator[pa.RecordBatch], width: int, min_docs: int) -> Iterator[pa.RecordBatch]:
    """Sorted counts to stretches of the dictionary: the sorted kept terms and, per source, the dense vector of
    their counts. A term's counts are neighbours, but may lie in two batches: the last term waits for more."""
    waiting: list[pa.Table] = []
    for batch in batches:
        waiting.append(pa.Table.from_batches([batch]))
        if sum(map(len, waiting)) < MERGED:
            continue
        table = pa.concat_tables(waiting)
        last = pc.and_(pc.equal(table["term"], table["term"][-1]), pc.equal(table["lang"], table["lang"][-1]))
        cut = len(table) - pc.sum(last).as_py()
        yield from _encode(table.slice(0, cut), width, min_docs)
        waiting = [table.slice(cut)]
    if waiting:
        yield from _encode(pa.concat_tables(waiting), width, min_docs)


def _encode(table: pa.Table, width: int, min_docs: int) -> Iterator[pa.RecordBatch]:
    for lang in pc.unique(table["lang"]).to_pylist() if len(table) else []:
        rows = table.filter(pc.equal(table["lang"], lang)).combine_chunks()
        (code, terms), (source, sources) = (_codes(rows[c].combine_chunks()) for c in ("term", "source"))
        kept = np.flatnonzero(np.bincount(code, rows["docs"].to_numpy().astype(float)) >= min_docs)  # in the order of the rows, so sorted
        ids = np.searchsorted(kept, code)
        known = np.append(kept, -1)[ids] == code
        ids, source, n = ids[known], source[known], rows["n"].to_numpy()[known]
        for lo in range(0, len(kept), width):
            hi = min(lo + width, len(kept))
            some = (ids >= lo) & (ids < hi)
            dense = np.zeros(len(sources) * (hi - lo), np.int64)
            np.add.at(dense, source[some] * (hi - lo) + ids[some] - lo, n[some])
            out = [[lang], [terms.take(pa.array(kept[lo:hi])).to_pylist()], [sources.to_pylist()], [dense]]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, (pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64())), strict=True)], ["lang", "terms", "sources", "counts"])


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (count + 1) / total), digit by digit so that nothing overflows."""
    left, out = counts + 1, np.zeros_like(counts)
    out, left = left // total, left % total
    for step in SCALE_STEPS:
        left = left * step
        out, left = out * step + left // total, left % total
    return out + 1


def compare_stretches(batches: Iterator[pa.RecordBatch], first: int) -> Iterator[pa.RecordBatch]:
    """Partial sums of all pairs of sources, and each source's first terms, of every stretch."""
    for batch in batches:
        for row in batch.to_pylist():
            terms, group, of = row["terms"], [g["source"] for g in row["groups"]], np.array([g["n"] for g in row["groups"]], np.int64)
            at, c = {s: i for i, s in enumerate(group)}, len(terms)
            counts = np.zeros((len(group), c), np.int64)
            counts[[at[s] for s in row["sources"]]] = np.array(row["counts"], np.int64).reshape(-1, c)
            p, q = shares(counts, (of + row["v"])[:, None]), shares(counts.sum(0), of.sum() + row["v"])
            out: dict[str, list] = {"source": [], "part": [], "item": [], "value": []}
            for j, other in enumerate(group):
                off = p - p[j]
                out["source"] += group[:j] + group[j + 1 :]
                out["part"] += ["pair"] * (len(group) - 1)
                out["item"] += [other] * (len(group) - 1)
                out["value"] += np.delete((off * off // p[j]).sum(1), j).tolist()
            for i, source in enumerate(group):
                over = np.flatnonzero((counts[i] > 0) & (p[i] > q))
                off = p[i][over] - q[over]
                value = off * off // q[over]
                best = np.argsort(-value, kind="stable")[:first]  # ids are in UTF-8 order, so ties are too
                out["source"] += [source] * len(best)
                out["part"] += ["term"] * len(best)
                out["item"] += [terms[k] for k in over[best]]
                out["value"] += value[best].tolist()
            arrays = [pa.array([row["lang"]] * len(out["source"]), pa.string()), *(pa.array(out[k], pa.string()) for k in ("source", "part", "item")), pa.array(out["value"], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "source", "part", "item", "value"])


def audit_sources(spark: SparkSession, docs: DataFrame, first: int = 200, min_docs: int = MIN_DOCS, cells: int = CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank): for every source its distance to each other source of its language
    (part `pair`), and the terms it uses more than its language does, the first by their divergence (part `term`)."""
    scratch = Scratch(spark, "audit")
    groups = scratch.keep(docs.select(*(F.coalesce(docs[c], F.lit("")).alias(c) for c in ("lang", "source"))).distinct(), "groups")
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    width = max(1, cells // most)
    counts = scratch.keep(term_counts(docs), "counts")
    sorted_counts = counts.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    stretches = scratch.keep(sorted_counts.mapInArrow(lambda b: encode_stretches(b, width, min_docs), STRETCH), "stretches")
    scratch.drop("counts")

    size = F.size("terms")
    totals = stretches.select("lang", F.posexplode("sources").alias("i", "source"), "counts", size.alias("c")).select(
        "lang", "source", F.aggregate(F.slice("counts", F.col("i") * F.col("c") + 1, F.col("c")), F.lit(0).cast("long"), lambda a, x: a + x).alias("n")
    )
    known = groups.join(totals.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").fillna(0, ["n"])
    known = known.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("groups"))
    langs = scratch.keep(known.join(stretches.groupBy("lang").agg(F.sum(size).alias("v")), "lang", "left").fillna(0, ["v"]), "langs")

    # a language may have nearly all stretches: they are dealt by a salt, and its row goes along with each
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stretches.withColumn("salt", F.pmod(F.xxhash64("terms"), F.lit(salts)).cast("int"))
    spread = langs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    parts = dealt.join(spread, ["lang", "salt"]).drop("salt")
    parts = scratch.keep(parts.mapInArrow(lambda b: compare_stretches(b, first), "lang string, source string, part string, item string, value long"), "parts")

    others = langs.select("lang", F.explode("groups.source").alias("source"), "groups").select("lang", "source", F.explode("groups.source").alias("item"))
    pairs = parts.filter("part = 'pair'").drop("part").unionByName(others.filter("source <> item").withColumn("value", F.lit(0).cast("long")))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    columns = ("lang", "source", "part", "item", "value", "rank")
    ranked = pairs.select("*", F.lit("pair").alias("part"), rank).select(*columns)
    return ranked.unionByName(parts.filter("part = 'term'").select("*", rank).filter(F.col("rank") <= first).select(*columns))
