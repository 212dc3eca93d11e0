"""Packing tokenised documents into windows by non-negative least squares.

1. Documents are tokenised once. A document longer than the window gives full windows and one
   rest; nothing else is cut. Each piece is written with its length and CRC.
2. The lengths' histogram, at most `window` numbers however large the corpus, goes to the
   driver. Lengths are put in coarse bins; shallow combinations of bins that fill a window are
   the columns of A, and min |A x - h|, x >= 0, gives their repeat counts (Lawson-Hanson, so few
   combinations are in use). Counts are rounded down.
3. Pieces left over go, longest first, to the window whose gap fits best, all pieces of one
   length at a time; gaps of the combinations are filled in the same way.
4. The plan says, for each length, which of its pieces go where. Pieces are numbered within
   their length (pre-aggregated, see `number_within`), and so find their place without any
   piece passing through the driver.

Defined results: a null text is an empty one and gives the end id alone; repeated rows are
packed as often as they occur; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .sharding import number_within
from .words import LOWER, Words, blocks, words_of

WINDOW = 4096
END_ID = 2
BIN = 32
DEPTH = 3
#: Words whose ids a Python worker remembers.
MEMO = 500_000

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_CLOSING = np.zeros(256, bool)
_CLOSING[list(b".,;:!?")] = True


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_closing(words: Words) -> Words:
    """Closing marks after an ASCII letter or digit as words of their own: the tokenizer parts them
    anyway, and there are far fewer distinct words without them."""
    cut = words.end.copy()
    for _ in range(3):
        cut -= (cut - words.start > 1) & _CLOSING[words.buffer[cut - 1]]
    parts = (cut < words.end) & _ALNUM[words.buffer[cut - 1]]
    at = np.arange(len(words)) + np.concatenate([[0], np.cumsum(parts)])[:-1]
    n = len(words) + int(parts.sum())
    start, end = np.empty(n, np.int64), np.empty(n, np.int64)
    start[at], end[at] = words.start, np.where(parts, cut, words.end)
    start[at[parts] + 1], end[at[parts] + 1] = cut[parts], words.end[parts]
    return Words(words.buffer, start, end, np.append(at, n)[words.first])


class WordTokenizer:
    """Ids of whole texts from ids of words.

    The tokenizer splits at white space before all else, so the ids of a text are those of its
    words one after another; each distinct word is encoded once and remembered. It lower-cases
    before it looks words up (where it does), so A-Z may be lowered first.
    """

    _of: dict[str, WordTokenizer] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        normalizer = json.loads(self.tokenizer.to_str())["normalizer"] or {}
        self.lowers = any(x["type"] == "Lowercase" for x in normalizer.get("normalizers", [normalizer]) if x)
        self._clear()

    @classmethod
    def at(cls, path: str) -> WordTokenizer:
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def lowered(self, words: Words) -> Words:
        """The words with a-z for A-Z, where that cannot make a special token of any text."""
        b = words.buffer
        if self.lowers and not ((b[:-1] == 0x3C) & (b[1:] == 0x7C)).any():  # "<|"
            words.buffer = LOWER[b]
        return words

    def _clear(self) -> None:
        self.known: dict[int, int] = {}
        self.pool = np.empty(1 << 16, np.uint32)
        self.used = 0
        self.where, self.many = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64)

    def _learn(self, words: Words, hashes: np.ndarray, at: np.ndarray) -> None:
        encoded = self.tokenizer.encode([words.bytes_of(i).decode() for i in at], is_pretokenized=True, add_special_tokens=False)
        ids = np.array(encoded.ids, np.uint32)
        of = np.array(encoded.word_ids, np.int64) if len(ids) else np.empty(0, np.int64)
        many = np.bincount(of, minlength=len(at))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        n = len(self.known)
        while n + len(at) > len(self.where):
            self.where, self.many = np.concatenate([self.where] * 2), np.concatenate([self.many] * 2)
        self.pool[self.used : self.used + len(ids)] = ids
        self.where[n : n + len(at)] = self.used + np.cumsum(many) - many
        self.many[n : n + len(at)] = many
        self.used += len(ids)
        self.known.update(zip(hashes.tolist(), range(n, n + len(at)), strict=True))

    def encode(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and for each text where its ids begin (and one more)."""
        hashes = words.hashes()
        coded = pa.array(hashes).dictionary_encode()
        number, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        if len(self.known) > MEMO:
            self._clear()
        index = np.fromiter((self.known.get(h, -1) for h in distinct.tolist()), np.int64, len(distinct))
        new = np.flatnonzero(index < 0)
        if len(new):
            first = np.empty(len(distinct), np.int64)
            first[number[::-1]] = np.arange(len(number) - 1, -1, -1)
            n = len(self.known)
            self._learn(words, distinct[new], first[new])
            index[new] = np.arange(n, n + len(new))
        many = self.many[index][number]
        stop = np.cumsum(many)
        flat = np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(self.where[index][number] - (stop - many), many)
        return self.pool[flat], np.concatenate([[0], stop])[words.first]


def _pieces(path: str, window: int, end_id: int, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.at(path)
        for batch in batches:
            for block in blocks(batch, "text"):
                ids, first = tokenizer.encode(split_closing(tokenizer.lowered(words_of(block.column("text")))))
                total = np.diff(first) + 1
                at = first[:-1] + np.arange(len(total))  # with the end ids before it
                ids = np.insert(ids, first[1:], end_id).astype("<u4")
                count = -(-total // window)
                doc = np.repeat(np.arange(len(total)), count)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * window
                length = np.minimum(total[doc] - start, window)
                begin = at[doc] + start
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * b : 4 * (b + n)]) for b, n in zip(begin.tolist(), length.tolist(), strict=True)]
                columns = [block.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(total[doc])]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([begin, [len(ids)]]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(columns)])

    return run


def combinations(bins: int, depth: int) -> list[tuple[int, ...]]:
    """Multisets of 1 .. bins, at most `depth` of them, that add up to `bins`, largest first."""
    out: list[tuple[int, ...]] = []

    def extend(chosen: tuple[int, ...], left: int) -> None:
        if not left:
            out.append(chosen)
        elif len(chosen) < depth:
            for part in range(min(left, chosen[-1] if chosen else bins), 0, -1):
                if part * (depth - len(chosen)) < left:
                    break
                extend((*chosen, part), left - part)

    extend((), bins)
    return out


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 2000, tolerance: float = 1e-9) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method of Lawson and Hanson."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    gram, target = a.T @ a, a.T @ b
    floor = tolerance * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(steps):
        w = target - gram @ x
        w[passive] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= floor:
            break
        passive[j] = True
        while True:
            p = np.flatnonzero(passive)
            z = np.linalg.lstsq(a[:, p], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[p] = z
                break
            bad = z <= 0
            gap = x[p][bad] - z[bad]
            alpha = np.min(np.where(gap > 0, x[p][bad] / np.where(gap > 0, gap, 1), 0))
            x[p] += alpha * (z - x[p])
            drop = p[(x[p] <= 1e-12) & bad]
            x[drop] = 0
            passive[drop if len(drop) else p[bad]] = False
    return x


def plan(histogram: dict[int, int], window: int = WINDOW, width: int = BIN, depth: int = DEPTH) -> np.ndarray:
    """Rows (length, lo, hi, sequence, offset): pieces lo .. hi - 1 of a length lie at `offset`
    of the sequences sequence, sequence + 1, ... Its size depends on the window, not the corpus."""
    left = dict(sorted(histogram.items()))
    bins = -(-window // width)
    bin_of = lambda length: -(-length // width)
    # groups of sequences filled alike: (how many, lengths in order), by the gap that is left
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)

    counts = np.zeros(bins)
    queues: dict[int, list[list[int]]] = defaultdict(list)  # of each bin: [length, pieces], ascending
    for length, n in left.items():
        counts[bin_of(length) - 1] += n
        queues[bin_of(length)].append([length, n])
    mixes = [c for c in combinations(bins, depth) if all(counts[k - 1] for k in c)]
    if mixes:
        a = np.zeros((bins, len(mixes)))
        for j, c in enumerate(mixes):
            for k in c:
                a[k - 1, j] += 1
        for j in np.argsort(-(x := np.floor(nnls(a, counts) + 1e-6)), kind="stable"):
            times = int(min([x[j], *(counts[k - 1] // mixes[j].count(k) for k in set(mixes[j]))]))
            for k in mixes[j]:
                counts[k - 1] -= times
            while times > 0:  # long pieces of the first bin go with short ones of the others
                ends = [0 if i else -1 for i in range(len(mixes[j]))]
                for k, e in zip(mixes[j], ends, strict=True):
                    while not queues[k][e][1]:
                        queues[k].pop(e)
                chosen = [queues[k][e] for k, e in zip(mixes[j], ends, strict=True)]
                use = [sum(c is q for c in chosen) for q in chosen]
                n = min([times, *(q[1] // u for q, u in zip(chosen, use, strict=True))])
                if not n:  # one piece short for all its places: take what single sequences can
                    n, chosen = 1, []
                    for k, e in zip(mixes[j], ends, strict=True):
                        q = next(q for q in (queues[k] if e == 0 else reversed(queues[k])) if q[1])
                        q[1] -= 1
                        chosen.append(q)
                else:
                    for q in chosen:
                        q[1] -= n
                lengths = tuple(q[0] for q in chosen)
                open_[window - sum(lengths)].append((n, lengths))
                times -= n

    gaps = np.zeros(window + 1, bool)
    gaps[[g for g in open_ if g]] = True
    rest: list[tuple[int, int]] = []
    for q in sorted((q for group in queues.values() for q in group if q[1]), reverse=True):
        heappush(rest, (-q[0], q[1]))
    while rest:
        minus, n = heappop(rest)
        length = -minus
        fit = length + int(np.argmax(gaps[length:]))
        if not gaps[fit]:
            each = window // length
            if n >= each:
                open_[window - each * length].append((n // each, (length,) * each))
                gaps[window - each * length] |= window > each * length
            if n % each:
                open_[window - n % each * length].append((1, (length,) * (n % each)))
                gaps[window - n % each * length] = True
            continue
        many, lengths = open_[fit].pop()
        use = min(n, many)
        if many > use:
            open_[fit].append((many - use, lengths))
        gaps[fit] = bool(open_[fit])
        open_[fit - length].append((use, (*lengths, length)))
        gaps[fit - length] = fit > length
        if n > use:
            heappush(rest, (minus, n - use))

    rows, sequence, next_of = [], 0, defaultdict(int)
    for gap in sorted(open_):
        for many, lengths in open_[gap]:
            offset = 0
            for length in lengths:
                rows.append((length, next_of[length], next_of[length] + many, sequence, offset))
                next_of[length] += many
                offset += length
            sequence += many
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _place(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        key = rows[:, 0] * (1 << 48) + rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            at = np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1
            names = [c for c in batch.schema.names if c != "_rank"]
            columns = [batch.column(c) for c in names] + [pa.array(rows[at, 3] + rank - rows[at, 1]), pa.array(rows[at, 4])]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    return run


def pack_documents(
    spark: SparkSession, docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, path: str | None = None, with_ids: bool = False
) -> DataFrame:
    """Per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, ids (if asked for),
    sequence_id and offset. Only doc_id and text are read."""
    scratch = Scratch(spark, "packing")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    pieces = scratch.keep(texts.mapInArrow(_pieces(path or tokenizer_path(), window, end_id, with_ids), schema), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `window` rows
    shared = spark.sparkContext.broadcast(plan(histogram, window))
    numbered = number_within(pieces, "length", ["doc_id", "start", "ids_crc32"], "_rank", scratch)
    return numbered.mapInArrow(_place(shared), schema + ", sequence_id long, offset long")
