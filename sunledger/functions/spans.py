"""Where literals, figures and addresses stand in a text: half-open (start, end) in characters, from 0.

An Aho-Corasick automaton finds all literals in one pass over a text, whatever their number, and what a rule asks of the
surroundings are tests on offsets. Each function goes over a text once, so it is linear in the text: the same rules as
patterns try every alternative at every character, and start anew inside each long run of letters or digits. Texts come
to Python as Arrow arrays, alone; other columns stay in the JVM. A null text is an empty one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

SPANS = "array<struct<literal:int,start:int,end:int>>"
CONTEXTS = "array<struct<email:string,start:int,end:int,context:string>>"


def folded(text: str) -> str:
    """The text in lower case, with as many characters as before (a letter whose lower case is two stays)."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


@lru_cache(maxsize=64)
def automaton(literals: tuple[str, ...]) -> ahocorasick.Automaton:
    """Of literals in lower case; each occurrence gives the literal's number."""
    found = ahocorasick.Automaton()
    for i, literal in enumerate(literals):
        found.add_word(literal, i)
    found.make_automaton()
    return found


def occurrences(low: str, literals: tuple[str, ...]) -> Iterator[tuple[int, int, int]]:
    """(number, start, end) of every occurrence in a folded text, overlapping ones too, by where they end."""
    for last, i in automaton(literals).iter(low):
        yield i, last + 1 - len(literals[i]), last + 1


def _per_text(kind: str, arrow: pa.DataType, of: Callable[[str], object]) -> Callable:
    def run(texts: pa.Array) -> pa.Array:
        return pa.array((of(x.as_py() or "") for x in texts), arrow, size=len(texts))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)


def literal_spans(text: Column, literals: tuple[str, ...]) -> Column:
    """Every occurrence of every literal, in any case: (literal, its number; start; end), by end, longer ones first."""
    lower = tuple(folded(x) for x in literals)
    if len(set(lower)) != len(lower) or "" in lower:
        raise ValueError("literals must differ and have characters")
    arrow = pa.list_(pa.struct([("literal", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    return _per_text(SPANS, arrow, lambda x: [dict(zip(("literal", "start", "end"), o, strict=True)) for o in occurrences(folded(x), lower)])(text)


def literals_in(text: Column, literals: tuple[str, ...]) -> Column:
    """The numbers of the literals that occur, in any case, ascending."""
    lower = tuple(folded(x) for x in literals)
    return _per_text("array<int>", pa.list_(pa.int32()), lambda x: sorted({i for _, i in automaton(lower).iter(folded(x))}))(text)


def figures_of(low: str) -> tuple[list[int], list[tuple[int, int]]]:
    """Where the capacities of a folded text begin, and those of a market: from the last digit before the unit to the
    end of the phrase after it. Both are in order, and neither has two that overlap."""
    begins, markets, last_digit = [], [], {}
    literals = P.UNITS + P.MARKET_PHRASES
    for i, start, end in occurrences(low, literals):
        at = start
        while at and low[at - 1] in P.WHITE:
            at -= 1
        if i >= len(P.UNITS):
            if at < start and at in last_digit:
                markets.append((last_digit[at], end))
            continue
        if not at or low[at - 1] not in P.DIGITS:
            continue
        last_digit[end] = at - 1
        begins.append(_number_before(low, at))
    return begins, markets


def _number_before(low: str, end: int) -> int:
    """Where the number begins that ends here: digits, and a point with digits before it."""
    at = end
    while at and low[at - 1] in P.DIGITS:
        at -= 1
    if at > 1 and low[at - 1] == "." and low[at - 2] in P.DIGITS:
        at -= 1
        while at and low[at - 1] in P.DIGITS:
            at -= 1
    return at


def all_of_markets(text: str, before: int = 60, after: int = 80) -> bool:
    """Whether a text has a capacity of a market, and one stands around every capacity in it, from `before` characters
    before its start to `after` behind it (a number may be cut there, its phrase may not)."""
    begins, markets = figures_of(folded(text))
    starts = [s for s, _ in markets]

    def near(at: int) -> bool:
        k = bisect_left(starts, at - before)  # ends are in order too, so the first that begins in reach ends first
        return k < len(markets) and markets[k][1] <= at + after

    return bool(markets) and all(near(at) for at in begins)


def only_statistics(text: Column, before: int = 60, after: int = 80) -> Column:
    """`all_of_markets` of each text."""
    return _per_text("boolean", pa.bool_(), lambda x: all_of_markets(x, before, after))(text)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Mail addresses: the characters of a mailbox before each @ that no address has yet, and after it the
    longest name whose last part is two letters or more."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in P.MAILBOX:
            start -= 1
        stop = at + 1
        while stop < len(text) and text[stop] in P.DOMAIN:
            stop += 1
        end = _domain_end(text, at + 1, stop) if start < at else -1
        if end > 0:
            yield start, end
            free = end
        at = text.find("@", max(at + 1, end))


def _domain_end(text: str, start: int, stop: int) -> int:
    dot = text.rfind(".", start, stop)
    while dot > start:
        end = dot + 1
        while end < stop and text[end] in P.LETTERS:
            end += 1
        if end - dot > 2:
            return end
        dot = text.rfind(".", start, dot)
    return -1


def email_contexts(text: Column, around: int = 200) -> Column:
    """Each address, lower-cased, with its place and the text up to `around` characters before and after it."""

    def of(x: str) -> list[dict]:
        return [{"email": x[s:e].lower(), "start": s, "end": e, "context": x[max(s - around, 0) : e + around]} for s, e in addresses(x)]

    arrow = pa.list_(pa.struct([("email", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("context", pa.string())]))
    return _per_text(CONTEXTS, arrow, of)(text)
