"""Word arrays of whole texts, held as numpy columns.

A *word* is a maximal run of characters other than U+0020 and U+0009..U+000D, unchanged
(``[^\\x20\\x09-\\x0D]+``). These bytes never occur inside a multi-byte UTF-8 sequence, so
words are cut on the UTF-8 buffer that Arrow already holds, with no Python string per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Texts are worked on in blocks of about so many bytes; a longer text is a block of its own.
BLOCK_BYTES = 500_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (wraps around, elementwise)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def pair(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """The 64-bit name of an ordered pair; `salt` keeps the names of different uses apart."""
    return mix(mix(a + U64(salt)) * U64(0x9E3779B97F4A7C15) + b)


@dataclass
class Words:
    """Words of consecutive texts: text i has the words first[i] to first[i + 1]."""

    buffer: np.ndarray  # uint8, UTF-8 bytes, padded
    start: np.ndarray  # int64 per word
    end: np.ndarray
    first: np.ndarray  # int64 per text, and one more

    def __len__(self) -> int:
        return len(self.start)

    def text_of(self) -> np.ndarray:
        """The number of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        at_any = np.lib.stride_tricks.as_strided(self.buffer[:8].view("<u8"), (len(self.buffer) - 8,), (1,))
        size = self.end - self.start
        h = mix(size.astype(U64) + U64(0x632BE59BD9B4E019 + seed))
        at, left, rows = self.start, size, None
        while len(at):
            part = mix((h if rows is None else h[rows]) ^ (at_any[at] & _MASK[np.minimum(left, 8)]))
            if rows is None:
                h, rows = part, np.arange(len(part))
            else:
                h[rows] = part
            more = left > 8
            at, left, rows = at[more] + 8, left[more] - 8, rows[more]
        return h

    def bytes_of(self, i: int) -> bytes:
        return self.buffer[self.start[i] : self.end[i]].tobytes()


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """The words of an Arrow string array; null has none. `lower`: A-Z become a-z first."""
    texts = texts.fill_null("") if texts.null_count else texts
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    buffer = np.full(hi - lo + 16, 0x20, np.uint8)
    if hi > lo:
        buffer[: hi - lo] = np.frombuffer(texts.buffers()[2], np.uint8)[lo:hi]
    if lower:
        buffer = LOWER[buffer]
    offsets = offsets - lo
    inside = ~_SPACE[buffer[: hi - lo + 1]]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[offsets] = inside[offsets]  # a word does not go on in the next text
    ends = inside[:-1] & (~inside[1:] | begins[1:])
    start = np.flatnonzero(begins)
    return Words(buffer, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with at most about `limit` bytes of text each, so memory stays bounded."""
    texts = batch.column(column)
    texts = texts if pa.types.is_large_string(texts.type) else texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j
