"""Substring dedup by recompression.

Recompression replaces a text by ever shorter sequences of symbols: first every maximal run of
one word gets a name, then, round by round, neighbouring symbols a b are merged into one named
symbol wherever a falls in the left and b in the right half of the alphabet. Which half a symbol
falls in and what a run or pair is called are functions of the symbol alone (64-bit names), so all
tasks of a round name alike without talking to each other, and equal passages get equal symbols
in their interior, wherever they lie. For each symbol the parse also keeps the stretch of words
that decides it; a window that holds this whole stretch holds the symbol in each of its copies.

1. The documents are parsed; symbols decided within one window's length are written and counted
   with map-side partial sums. Symbols that occur once are out.
2. A window is a candidate if all symbols decided inside it are shared (a window without such a
   symbol, as in long runs, is always one). This reveals long repeats and is never a miss.
3. Candidate windows are verified: named by 96 bits of two rolling hashes over the whole
   window and counted exactly. Words under windows that occur twice or more go.

What a shuffle carries is symbols, candidates and, twice, the texts; partial sums and skew-split
joins take the edge off passages that very many documents share. All sets that meet in one row are
those of one document.

Defined results: a null text has no words; a text of fewer words than the window loses nothing;
an exact copy of a text of at least the window's length loses all words, as does the original;
repeated rows are documents of their own and get equal results; windows never cross documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch
from .words import U64, Words, blocks, mix, pair, words_of

WINDOW = 35
_FAR = 1 << 40
_BASES = (0xD1342543DE82EF95, 0xAEF17502108EF2D9)
_POWERS: dict[int, np.ndarray] = {}


def rounds_for(window: int) -> int:
    """Rounds of pair naming: symbols shrink to 3/4 a round, a stretch must fit the window."""
    return max(0, int(np.log(max(window, 1) / 6) / np.log(4 / 3)))


def _name_runs(sym: np.ndarray, lo: np.ndarray, hi: np.ndarray, doc: np.ndarray):
    """Maximal runs a^k become (a, k). Both neighbours decide where a run ends."""
    n = len(sym)
    new = np.ones(n, bool)
    new[1:] = (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])
    i = np.flatnonzero(new)
    j = np.append(i[1:], n) - 1
    before, after = np.maximum(i - 1, 0), np.minimum(j + 1, n - 1)
    left = np.where((i > 0) & (doc[before] == doc[i]), lo[before], -_FAR)
    right = np.where((j < n - 1) & (doc[after] == doc[j]), hi[after], _FAR)
    k = j - i + 1
    name = np.where(k > 1, pair(sym[i], k.astype(U64), 77), sym[i])
    return name, np.minimum(left, lo[i]), np.maximum(right, hi[j]), doc[i]


def _name_pairs(sym: np.ndarray, lo: np.ndarray, hi: np.ndarray, doc: np.ndarray, salt: int):
    """Every left-half symbol before a right-half one merges with it. A pair decides itself; a
    symbol left alone is decided together with the neighbour that it could have merged with."""
    n = len(sym)
    right_half = ((mix(sym ^ U64(salt * 7919 + 1)) >> U64(17)) & U64(1)).astype(bool)
    same = doc[1:] == doc[:-1]
    merge = np.zeros(n, bool)
    merge[:-1] = ~right_half[:-1] & right_half[1:] & same
    lo2, hi2 = np.where(right_half, -_FAR, lo), np.where(right_half, hi, _FAR)
    a = np.flatnonzero(same & ~right_half[:-1])  # looks to its right
    lo2[a], hi2[a] = np.minimum(lo[a], lo[a + 1]), np.maximum(hi[a], hi[a + 1])
    b = np.flatnonzero(same & right_half[1:]) + 1  # looks to its left
    lo2[b], hi2[b] = np.minimum(lo[b], lo[b - 1]), np.maximum(hi[b], hi[b - 1])
    at = np.flatnonzero(merge)
    name = sym.copy()
    name[at] = pair(sym[at], sym[at + 1], 1000 + salt)
    keep = np.ones(n, bool)
    keep[at + 1] = False
    return name[keep], lo2[keep], hi2[keep], doc[keep]


def recompress(hashes: np.ndarray, doc: np.ndarray, window: int):
    """(symbol, lo, hi, doc) of the symbols that words lo .. hi - 1, at most `window`, decide."""
    at = np.arange(len(hashes))
    state = _name_runs(hashes, at, at + 1, doc) if len(hashes) else (hashes, at, at + 1, doc)
    for salt in range(rounds_for(window)):
        state = _name_pairs(*state, salt) if len(state[0]) else state
    fits = state[2] - state[1] <= window
    return tuple(x[fits] for x in state)


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    if len(_POWERS.get(base, ())) < n:
        steps = np.full(max(n, 1 << 16), base, U64)
        steps[0] = 1
        _POWERS[base] = np.cumprod(steps)
    return _POWERS[base][:n]


def window_names(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit and a further 32-bit name of each `window` consecutive words."""
    n = len(hashes) - window + 1
    names = []
    for base, h in zip(_BASES, (hashes, mix(hashes ^ U64(0x5851F42D4C957F2D))), strict=True):
        sums = np.zeros(len(h) + 1, U64)
        np.cumsum(h * _powers(base, len(h)), out=sums[1:])
        names.append(mix((sums[window:] - sums[:-window]) * _powers(pow(base, -1, 1 << 64), n)))
    return names[0], (names[1] >> U64(32)).astype(np.uint32)


def _starts(words: Words, window: int) -> np.ndarray:
    """Whether a window of one document starts at each word."""
    end = np.repeat(words.first[1:], np.diff(words.first))
    return np.arange(len(words)) + window <= end


def _flat(column: pa.Array) -> np.ndarray:
    """All entries of a list column, sorted and distinct."""
    return np.unique(pa.compute.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.int64)).view(U64) if len(column) else np.empty(0, U64)


def _symbols(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                words = words_of(block.column("text"))
                sym, _, _, doc = recompress(words.hashes(), words.text_of(), window)
                keys = block.column("_key").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(keys[doc], pa.int64()), pa.array(sym.view(np.int64))], ["_key", "sym"])

    return run


def _candidates(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                keys = block.column("_key").to_numpy(zero_copy_only=False)
                # copies that lie side by side are named once, with their number
                first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                number = np.diff(np.append(first, len(keys)))
                block = block.take(pa.array(first))
                keys = keys[first]
                words = words_of(block.column("text"))
                if len(words) < window:
                    continue
                hashes, text_of = words.hashes(), words.text_of()
                sym, lo, hi, _ = recompress(hashes, text_of, window)
                once = ~np.isin(sym, _flat(block.column("_shared")))
                # a symbol decided by lo .. hi lies in the windows that start at hi - window .. lo
                spoilt = np.zeros(len(words) + 1, np.int64)
                np.add.at(spoilt, np.maximum(hi[once] - window, 0), 1)
                np.add.at(spoilt, lo[once] + 1, -1)
                at = np.flatnonzero(_starts(words, window) & (np.cumsum(spoilt)[:-1] == 0))
                name, more = window_names(hashes, window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[text_of[at]], pa.int64()), pa.array(name[at].view(np.int64)), pa.array(more[at].view(np.int32)), pa.array(number[text_of[at]].astype(np.int32))],
                    ["_key", "name", "more", "n"],
                )

    return run


def join_words(words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    size = words.end - words.start
    at = np.flatnonzero(keep)
    text_of = words.text_of()[at]
    last = np.append(text_of[1:] != text_of[:-1], True) if len(at) else np.empty(0, bool)
    wide = size[at] + ~last
    stop = np.cumsum(wide)
    out = words.buffer[np.arange(int(stop[-1]) if len(at) else 0) + np.repeat(words.start[at] - (stop - wide), wide)]
    out[stop[~last] - 1] = 0x20
    offsets = np.concatenate([[0], stop])[np.searchsorted(at, words.first)].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(words.first) - 1, pa.py_buffer(offsets), pa.py_buffer(out))


def _remove(window: int, names: list[str], arrow: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "_sd_text"):
                words = words_of(block.column("_sd_text"))
                n, texts = len(words), len(words.first) - 1
                gone = np.zeros(n, bool)
                repeated = _flat(block.column("_repeated"))
                if n >= window and len(repeated):
                    name, _ = window_names(words.hashes(), window)
                    at = np.flatnonzero(np.append(np.isin(name, repeated), np.zeros(window - 1, bool)) & _starts(words, window))
                    depth = np.zeros(n + 1, np.int64)
                    depth[at] += 1
                    depth[at + window] -= 1
                    gone = np.cumsum(depth)[:-1] > 0
                total = np.concatenate([[0], np.cumsum(gone)])
                edge = np.ones(n, bool)  # a stretch of removed words begins
                edge[1:] = ~gone[:-1]
                edge[words.first[:-1][words.first[:-1] < n]] = True
                begin = np.flatnonzero(gone & edge)
                ends = np.ones(n, bool)
                ends[:-1] = ~gone[1:] | edge[1:]
                base = np.repeat(words.first[:-1], np.diff(words.first))
                end = np.flatnonzero(gone & ends) + 1
                spans = pa.StructArray.from_arrays([pa.array((begin - base[begin]).astype(np.int32)), pa.array((end - base[end - 1]).astype(np.int32))], ["start", "end"])
                columns = [block.column(c) for c in names]
                columns += [
                    pa.array(np.diff(words.first)), pa.array(total[words.first[1:]] - total[words.first[:-1]]),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, words.first).astype(np.int32)), spans), join_words(words, ~gone),
                ]
                assert len(columns[-1]) == texts
                yield pa.RecordBatch.from_arrays([c.cast(t) if c.type != t else c for c, t in zip(columns, arrow.types, strict=True)], arrow.names)

    return run


ADDED = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
    T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    T.StructField("kept", T.StringType()),
])


def remove_repeats(spark: SparkSession, docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """`docs` (without columns of these names) with n_words, n_removed, removed (spans of words,
    end exclusive) and kept (the kept words, joined by one space)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    scratch = Scratch(spark, "repeats")
    scratch.release()
    docs = docs.drop(*ADDED.names)
    key = F.xxhash64(F.col(text)).alias("_key")  # a collision only merges two lists of true facts
    keyed = docs.select(key, F.col(text).alias("text"))
    symbols = scratch.keep(keyed.mapInArrow(_symbols(window), "_key long, sym long"), "symbols")
    shared = scratch.keep(symbols.groupBy("sym").count().filter("count > 1").select("sym"), "shared")
    lists = symbols.join(shared, "sym").groupBy("_key").agg(F.collect_set("sym").alias("_shared"))
    windows = keyed.join(lists, "_key", "left").mapInArrow(_candidates(window), "_key long, name long, more int, n int")
    windows = scratch.keep(windows, "windows")
    scratch.drop("symbols", "shared")
    repeated = scratch.keep(windows.groupBy("name", "more").agg(F.sum("n").alias("n")).filter("n > 1").select("name", "more"), "repeated")
    found = windows.join(repeated, ["name", "more"]).groupBy(F.col("_key").alias("_sd_key")).agg(F.collect_set("name").alias("_repeated"))
    found = scratch.keep(found, "found")
    scratch.drop("windows", "repeated")
    named = docs.withColumn("_sd_text", F.col(text)).join(found, F.xxhash64(F.col(text)) == F.col("_sd_key"), "left").drop("_sd_key")
    schema = T.StructType([*docs.schema.fields, *ADDED.fields])
    return named.mapInArrow(_remove(window, docs.columns, to_arrow_schema(schema)), schema)


def cut_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` with repeated passages cut out of their texts. A text that loses nothing stays as it
    is, one that loses words becomes its kept words; n_chars, where there is one, follows. The other
    columns travel as one struct, so none of them can clash with those of the operator."""
    rest = [c for c in docs.columns if c != "text"]
    cleaned = remove_repeats(spark, docs.select(F.struct(*(docs[c] for c in rest)).alias("row"), "text"), "text", window)
    cut = F.col("n_removed") > 0
    out = {c: F.col("row")[c] for c in rest}
    out["text"] = F.when(cut, F.col("kept")).otherwise(F.col("text"))
    if "n_chars" in out:
        out["n_chars"] = F.when(cut, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return cleaned.select(*(out[c].alias(c) for c in docs.columns))
