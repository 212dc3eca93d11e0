"""The best of many names for each name: a similarity join that never lists all pairs.

A score falls in three steps, and each step sees only the names that the one before it left:

* equal names score 100: an equi-join;
* one within the other scores 80: a name lies in another only if its rarest trigram does, so names meet there;
* else 60 times the shared words over the longer list, at least 40: at least two thirds of either list are
  shared. Lists of up to WORDS words meet in sets of shared words: every list has a row for each of its
  subsets of two thirds of it or more, subsets of the other side are reduced to the earliest name of each
  length before they meet, so a set of words that all names share costs one row, not all pairs. Longer lists,
  and those that repeat a word, meet in their rarest third plus one (prefix filter) and are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import join_frequent
from .staging import stage

#: Lists of up to so many words have at most 130 subsets of two thirds or more.
WORDS = 9
MIN_SCORE = 40


def word_list(key: Column) -> Column:
    """The words of three characters or more."""
    return F.filter(F.split(key, " "), lambda w: F.length(w) >= 3)


def parts_of(key: Column, size: int) -> Column:
    """All distinct parts of so many characters."""
    some = F.transform(F.sequence(F.lit(1), F.length(key) - (size - 1)), lambda i: F.substr(key, i, F.lit(size)))
    return F.when(F.length(key) >= size, F.array_distinct(some)).otherwise(F.array().cast("array<string>"))


def best_names(names: DataFrame, others: DataFrame) -> DataFrame:
    """(name, other, score): for each distinct `name` the `other` with the highest score, the least `ord` on ties.
    `others` has other and ord, each name once; it is read several times, so pass a written or staged table."""
    names = names.select("name").distinct()
    equal = names.join(others, F.col("name") == F.col("other")).select("name", "other", F.lit(100.0).alias("score"))
    left = stage(names.join(others, F.col("name") == F.col("other"), "left_anti"))
    near = stage(_first(contained(left, others), 80.0))
    left = stage(left.join(near.select("name"), "name", "left_anti"))
    shared = _best(by_subsets(left, others).unionByName(by_prefix(left, others)))
    return equal.unionByName(near).unionByName(shared)


def _first(found: DataFrame, score: float) -> DataFrame:
    return found.groupBy("name").agg(F.min(F.struct("ord", "other")).alias("m")).select("name", "m.other", F.lit(score).alias("score"))


def _best(found: DataFrame) -> DataFrame:
    best = F.max(F.struct("score", (-F.col("ord")).alias("o"), "other")).alias("m")
    return found.groupBy("name").agg(best).select("name", "m.other", "m.score")


def contained(names: DataFrame, others: DataFrame) -> DataFrame:
    """(name, other, ord) where one lies within the other. Names of one or two characters meet all parts of that
    size; of those only the earliest other is kept, so they don't make rows for all that hold them."""
    inside = _holders(others.select(F.col("other").alias("inner")), names.select(F.col("name").alias("outer")))
    inside = inside.join(others, F.col("inner") == F.col("other")).select(F.col("outer").alias("name"), "other", "ord")
    around = _holders(names.select(F.col("name").alias("inner")), others.select(F.col("other").alias("outer")))
    around = around.join(others, F.col("outer") == F.col("other")).select(F.col("inner").alias("name"), "other", "ord")
    short = F.explode(F.concat(parts_of(F.col("long"), 1), parts_of(F.col("long"), 2))).alias("part")
    small = others.filter(F.length("other") < 3)
    held = names.select(F.col("name"), F.col("name").alias("long")).select("name", short).join(small, F.col("part") == F.col("other")).select("name", "other", "ord")
    first = others.select("other", "ord", F.col("other").alias("long")).select("other", "ord", short).groupBy("part").agg(F.min(F.struct("ord", "other")).alias("m"))
    holding = names.filter(F.length("name") < 3).join(first, F.col("name") == F.col("part")).select("name", "m.other", "m.ord")
    return inside.unionByName(around).unionByName(held).unionByName(holding)


def _holders(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner, outer) where `inner`, of three characters or more, is part of `outer`: they meet at the trigram of
    `inner` that fewest of `outer` have; an inner with a trigram that none has lies in none."""
    posted = outer.select("outer", F.explode(parts_of(F.col("outer"), 3)).alias("g"))
    frequency = posted.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    asked = inner.select("inner", F.explode(parts_of(F.col("inner"), 3)).alias("g")).join(frequency, "g", "left")
    rarest = asked.groupBy("inner").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g")).alias("m")).filter("m.df > 0")
    met = rarest.select("inner", F.col("m.g").alias("g")).join(posted, "g")
    return met.filter(F.col("outer").contains(F.col("inner"))).select("inner", "outer")


def _subsets(words: Column) -> Column:
    """All sets of two thirds or more of sorted distinct words, each as one text."""
    n = F.size(words)
    masks = F.filter(F.sequence(F.lit(1), F.pow(F.lit(2), n).cast("int") - 1), lambda m: F.bit_count(m) * 3 >= n * 2)
    return F.transform(masks, lambda m: F.array_join(F.filter(words, lambda w, i: F.getbit(m, i) == 1), " "))


def by_subsets(names: DataFrame, others: DataFrame) -> DataFrame:
    """(name, other, ord, score) of shared words between lists of up to WORDS words, none twice in a name's: for every
    set of words and every length of the other list the earliest other."""
    listed = names.withColumns({"w": word_list(F.col("name"))}).filter(plain())
    posted = others.withColumn("w", F.array_sort(F.array_distinct(word_list(F.col("other"))))).filter(F.size("w").between(1, WORDS))
    first = posted.select("other", "ord", F.size("w").alias("o"), F.explode(_subsets(F.col("w"))).alias("s")).groupBy("s", "o").agg(F.min(F.struct("ord", "other")).alias("m"))
    asked = listed.select("name", F.size("w").alias("d"), F.explode(_subsets(F.array_sort("w"))).alias("s"))
    size = F.size(F.split("s", " "))
    # of each set, all lengths of others in one row, at most WORDS
    first = first.groupBy("s").agg(F.collect_list(F.struct("o", "m")).alias("firsts"))
    counted = asked.groupBy("s").agg(F.count(F.lit(1)).alias("_n")).join(first, "s")
    met = join_frequent(asked, counted, "s", "_n", F.col("name")).filter("firsts is not null")
    met = met.select("name", "d", size.alias("shared"), F.explode("firsts").alias("f"))
    score = F.col("shared") / F.greatest("d", "f.o") * 60
    return met.select("name", "f.m.other", "f.m.ord", score.alias("score")).filter(F.col("score") >= MIN_SCORE)


def plain() -> Column:
    return F.size("w").between(1, WORDS) & (F.size(F.array_distinct("w")) == F.size("w"))


def by_prefix(names: DataFrame, others: DataFrame) -> DataFrame:
    """The same where a list is longer, or a name repeats a word (it counts each time): of a name's words, by how many
    others have them, the rarest third plus one meets the words of the others."""
    listed = names.withColumn("w", word_list(F.col("name"))).withColumn("plain", plain()).filter(F.size("w") > 0)
    posted = others.withColumn("v", F.array_distinct(word_list(F.col("other")))).filter(F.size("v") > 0)
    words = posted.select("other", "ord", "v", F.explode("v").alias("word"))
    frequency = words.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    # only long others can meet a plain name here, and none is longer than half as much again
    longest = listed.filter(~F.col("plain") | (F.size("w") * 3 > 2 * WORDS))
    asked = longest.select("name", "w", "plain", F.posexplode("w").alias("i", "word")).join(frequency, "word", "left").groupBy("name", "w", "plain").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word", "i"))).alias("by")
    )
    prefix = F.array_distinct(F.transform(F.slice("by", F.lit(1), F.floor(F.size("w") / 3).cast("int") + 1), lambda x: x["word"]))
    met = asked.select("name", "w", "plain", F.explode(prefix).alias("word")).join(words, "word").filter(~F.col("plain") | (F.size("v") > WORDS))
    shared = F.size(F.filter("w", lambda x: F.array_contains(F.col("v"), x)))
    score = shared / F.greatest(F.size("w"), F.size("v")) * 60
    return met.select("name", "other", "ord", score.alias("score")).filter(F.col("score") >= MIN_SCORE).distinct()
