"""Quality rules with thresholds that follow each language and source, in DataFrame functions only.

Fixed cutoffs suit one language or one crawl and fail the next. Here every measure is sketched per
language and source: a sketch counts values in the cells of a fixed logarithmic grid, so its
quantiles are off by 0.1 % of their value at most, sketches merge by adding counts, and as nothing is drawn
at random, reruns agree. Sketches of sources merge into those of their language and of the whole
corpus. A source's quantiles are blended with its language's, and those with the corpus's, by its
number of documents n against PRIOR documents of the parent: n / (n + PRIOR) is its own. A document
passes when each of its measures lies inside the fences of its group.

Quantiles and fences are of logarithms, so a fence is as many times the group's spread away whatever the
measure's unit. Shares that are zero in most documents say nothing in quantiles; they are taken with half a
case more, (count + 1/2) / (size + 1), so they have a spread in every group, that of its documents' sizes.

Defined results: a null or empty text has no words and fails the base rules; null languages and
sources form groups of their own; repeated rows count as often as they occur. The arrays of one
text (words, hashes, windows) lie in one row, some 60 bytes a word: texts of tens of millions of
words need executors to match.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Fence:
    """A document fails above q75 * (q75 / q25) ** reach (and, if `low`, below q25 * (q25 / q75) ** reach)."""

    measure: str
    reach: float
    low: bool = False


#: See `measures`.
FENCES = (
    Fence("mark_share", 4.0),
    Fence("dup_line_share", 4.0),
    Fence("repeat_share", 4.0),
    Fence("mean_word_chars", 5.0, low=True),
    Fence("word_variety", 4.0, low=True),
)
#: So many documents of the parent (language, corpus) weigh as much as the group's own.
PRIOR = 50
#: Cells of the sketches' grid grow by this factor; the cell of values up to 0 comes before all.
GAMMA = 1.002
ZERO = -1_000_000
#: q75 / q25 counts as at least this: only for groups whose documents agree to a hundredth.
TIE = 1.01


def split_words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array."""
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t-\\r]+"))


def repeated_words(windows: Column, width: int) -> Column:
    """How many words lie in windows that occur twice or more in the array of window hashes.

    Windows are sorted with their positions, so equal ones are neighbours; then the union of
    [position, position + width) is summed over the sorted positions. All of it stays in the row.
    """
    tagged = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def positions(s: Column) -> Column:
        n = F.size(s)
        twin = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda k: ((k > 0) & (F.get(s, k - 1)["h"] == F.get(s, k)["h"])) | ((k < n - 1) & (F.get(s, k + 1)["h"] == F.get(s, k)["h"])),
        )
        return F.sort_array(F.transform(twin, lambda k: F.get(s, k)["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(width)), F.lit(width)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    # single-element arrays bind an intermediate array once instead of expanding it at each use
    at = F.get(F.transform(F.array(tagged), positions), F.lit(0))
    return F.get(F.transform(F.array(at), covered), F.lit(0))


def base_statistics(docs: DataFrame, text: str = "text", width: int = 5) -> DataFrame:
    """`docs` with n_words, n_distinct, word_chars, n_symbols, n_marks (characters that are no letters, digits or
    white space), n_lines, n_dup_lines and n_repeat_words (longs)."""
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_words", split_words(body))
    df = df.withColumns({"n_words": F.size("_words").cast("long"), "_hashes": F.transform("_words", lambda w: F.xxhash64(w))})
    window = lambda i: F.xxhash64(*(F.get(F.col("_hashes"), i + k) for k in range(width)))
    df = df.withColumn("_windows", F.when(F.col("n_words") >= width, F.transform(F.sequence(F.lit(0), F.size("_hashes") - width), window)))
    df = df.withColumns({
        "word_chars": F.length(F.translate(body, SPACE, "")).cast("long"),
        "n_marks": (F.length(body) - F.length(F.regexp_replace(body, "[^\\p{L}\\p{M}\\p{N}\\s]+", ""))).cast("long"),
        "n_distinct": F.size(F.array_distinct("_hashes")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
        "_lines": F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""),
    })
    some = F.col("_windows").isNotNull() & (F.size(F.array_distinct("_windows")) < F.size("_windows"))
    df = df.withColumns({
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.when(some, repeated_words(F.col("_windows"), width)).otherwise(F.lit(0).cast("long")),
    })
    return df.drop("_words", "_hashes", "_windows", "_lines")


def measures(stats: DataFrame) -> DataFrame:
    """The measures that the fences speak of: shares with half a case more, characters per word, and how much of the
    logarithm of the number of words that of distinct words is (1 if none occurs twice, whatever the length)."""
    share = lambda n, of: (F.col(n) + 0.5) / (F.col(of) + 1)
    words = F.greatest(F.col("n_words"), F.lit(1))
    return stats.withColumns({
        "mark_share": share("n_marks", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "mean_word_chars": F.col("word_chars") / words,
        "word_variety": F.when(words > 1, F.log(F.col("n_distinct").cast("double")) / F.log(words.cast("double"))).otherwise(1.0),
    })


def cell(x: Column) -> Column:
    """The grid's cell of a value."""
    return F.when(x > 0, F.floor(F.log(x) / F.log(F.lit(GAMMA)))).otherwise(F.lit(ZERO)).cast("int")


def log_of(at: Column) -> Column:
    """The logarithm of a cell's middle; that of the cell of zero is far below all others."""
    return (at + 0.5) * math.log(GAMMA)


def sketch_groups(measured: DataFrame, fences: tuple[Fence, ...] = FENCES) -> DataFrame:
    """(lang, source, measure, cell, n). Counts are added up before the shuffle, so a source with a third
    of all rows costs no more than any other."""
    entries = F.array(*(F.struct(F.lit(f.measure).alias("measure"), cell(F.col(f.measure)).alias("cell")) for f in fences))
    rows = measured.select("lang", "source", F.explode(entries).alias("e")).select("lang", "source", "e.measure", "e.cell")
    return rows.groupBy("lang", "source", "measure", "cell").agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], tag: str, fences: tuple[Fence, ...]) -> DataFrame:
    """Per group of `keys`: {tag}_n documents and the logarithms {tag}_a_<measure>, {tag}_b_<measure> of the quartiles, from merged sketches."""
    merged = sketches.groupBy(*keys, "measure", "cell").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")  # as many rows as a sketch has cells
    merged = merged.withColumns({"upto": F.sum("n").over(group.orderBy("cell")), "all": F.sum("n").over(group)})
    at = lambda f, q: F.min(F.when((F.col("measure") == f.measure) & (F.col("upto") >= q * F.col("all")), F.col("cell")))
    found = [log_of(at(f, q)).alias(f"{tag}_{x}_{f.measure}") for f in fences for x, q in (("a", 0.25), ("b", 0.75))]
    return merged.groupBy(*keys).agg(F.max("all").alias(f"{tag}_n"), *found).withColumnsRenamed({k: f"{tag}_{k}" for k in keys})


def thresholds(sketches: DataFrame, fences: tuple[Fence, ...] = FENCES, prior: int = PRIOR) -> DataFrame:
    """Fences per language and source, from quantiles blended with those of language and corpus."""
    source, lang, corpus = (quantiles(sketches, keys, tag, fences) for keys, tag in ((["lang", "source"], "s"), (["lang"], "l"), ([], "c")))
    both = source.join(lang, F.col("s_lang").eqNullSafe(F.col("l_lang"))).join(F.broadcast(corpus), F.lit(True))  # corpus is one row
    own, of_lang = (F.col(f"{tag}_n") / (F.col(f"{tag}_n") + prior) for tag in ("s", "l"))
    out = [F.col("s_lang").alias("t_lang"), F.col("s_source").alias("t_source")]
    for f in fences:
        parent = {x: of_lang * F.col(f"l_{x}_{f.measure}") + (1 - of_lang) * F.col(f"c_{x}_{f.measure}") for x in "ab"}
        q = {x: own * F.col(f"s_{x}_{f.measure}") + (1 - own) * parent[x] for x in "ab"}
        reach = f.reach * F.greatest(q["b"] - q["a"], F.lit(math.log(TIE)))
        out.append(F.exp(q["b"] + reach).alias(f"max_{f.measure}"))
        if f.low:
            out.append(F.exp(q["a"] - reach).alias(f"min_{f.measure}"))
    return both.select(*out)


def apply_rules(
    spark: SparkSession, docs: DataFrame, fences: tuple[Fence, ...] = FENCES, prior: int = PRIOR, min_words: int = 10, max_repeat_percent: int = 20
) -> DataFrame:
    """Per document: its base statistics, base_failed, and kept.

    Thresholds are learnt from documents that pass the base rules, so that plain junk doesn't
    widen them, and apply to all. Columns: doc_id, lang, source, the statistics, the measures,
    base_failed, kept.
    """
    scratch = Scratch(spark, "rules")
    stats = measures(base_statistics(docs.select("doc_id", "text", "lang", "source"))).drop("text")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    stats = scratch.keep(stats.withColumn("base_failed", failed), "stats")
    limits = thresholds(scratch.keep(sketch_groups(stats.filter(~F.col("base_failed")), fences), "sketches"), fences, prior)
    joined = stats.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    inside = F.lit(True)
    for f in fences:
        inside &= F.col(f.measure) <= F.col(f"max_{f.measure}")
        if f.low:
            inside &= F.col(f.measure) >= F.col(f"min_{f.measure}")
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    return joined.withColumn("kept", kept).select(*stats.columns, "kept")
