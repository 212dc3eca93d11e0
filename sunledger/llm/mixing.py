"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Every document gets a rate r >= 0, its expected number of copies. Among all rates up to `cap` whose
tokens meet each source's target, the ones nearest to 1 in relative entropy are wanted:

    minimise  sum_i w_i (r_i log r_i - r_i + 1)   so that   sum_{i in s} size_i r_i = T_s.

The reference measure counts a document half as a document and half by its tokens,
w_i = (m_s + size_i) / 2 with m_s the mean size of its source. The optimum is an exponential tilt
with a multiplier for each token constraint and a coefficient for each document:

    r_i = min(cap, exp(lambda_s c_i)),   c_i = size_i / w_i = 2 size_i / (m_s + size_i).

So what a source gains or loses comes from its longer documents first, but no document is tilted
more than twice as much as one of mean size, and short ones stay near one copy. The dual is convex
and its Hessian diagonal, as constraints of different sources share no document. A Newton step is
one distributed aggregate over all documents, which enter as exact counts by source and size; the
multipliers are a table with a row per source, and steps that leave the known bracket are bisected.

Rates become whole copies: floor(r) of them, and one more where u < r - floor(r), u a fixed draw from
a hash of the document. As sources must meet their targets, the draws' level is moved a little:
with v = u / (r - floor(r)) one more copy goes to those with v below the source's level, found from
token counts in fine bins of v. What is still missing is made up by single copies of documents near that
level, from ever smaller size classes. Nothing depends on how rows lie, so reruns agree.

Defined results: a null text has size 0; documents of size 0 keep one copy and are taken 0 words;
null is a source of its own, last in order; repeated rows are documents of their own (which of
them gets how many copies is open, how often each number occurs is not); no document is copied more
than `cap` times; a source whose target is `cap` times its size gives all documents `cap` copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .quality_rules import split_words
from .scratch import Scratch
from .sharding import number_within

NEWTON_STEPS = 80
#: A multiplier's bound on either side, and how near the tokens must come to the target, relatively.
FAR, NEAR = 500.0, 1e-9
#: Bins of v below 2 in which the level of a source is looked for.
BINS = 1 << 16
#: Documents of each size class that stand by to make up for rounding.
SPARE = 4


def source_targets(totals: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """`totals` (source, source_size) with `target`.

    Sources by code point, null last, weigh weights[0], weights[1], ..., repeating, and share the
    sum of all sizes. A target stops at cap times its source's size; the excess goes to the others
    by weight. Sorted by cap over weight, the capped sources are a prefix, so the level that all
    others share is found from running sums. One row per source: small.
    """
    everyone = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.get(F.array(*(F.lit(float(x)) for x in weights)), (F.row_number().over(order) - 1) % len(weights))
    df = totals.withColumns({"_w": w, "_cap": F.col("source_size") * float(cap)})
    by = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({
        "_left": F.sum("source_size").over(everyone) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
        "_wleft": F.sum("_w").over(everyone) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)),
    })
    free = F.col("_left") / F.col("_wleft") <= F.col("_cap") / F.col("_w")
    level = F.min(F.when(free, F.struct(F.col("_cap") / F.col("_w"), (F.col("_left") / F.col("_wleft")).alias("level")))).over(everyone)["level"]
    return df.withColumn("target", F.least(F.col("_cap"), F.coalesce(level * F.col("_w"), F.col("_cap")))).drop("_w", "_cap", "_left", "_wleft")


def tilted(lam: Column, size: Column, mean: Column, cap: int) -> tuple[Column, Column]:
    """(rate, coefficient) of a document."""
    c = 2 * size / (mean + size)
    return F.when(size > 0, F.least(F.exp(lam * c), F.lit(float(cap)))).otherwise(F.lit(1.0)), c


def newton_step(counts: DataFrame, state: DataFrame, cap: int) -> DataFrame:
    """The next `state` (a row per source): the tokens and the curvature that its multipliers give,
    summed over all documents, and Newton's step kept inside the bracket low .. high."""
    joined = counts.join(state, counts["source"].eqNullSafe(state["s_source"]))
    rate, c = tilted(F.col("lam"), F.col("size"), F.col("mean"), cap)
    weight = F.col("n") * F.col("size") * rate
    sums = joined.groupBy(*state.columns).agg(F.sum(weight).alias("mass"), F.sum(F.when(rate < cap, weight * c).otherwise(0.0)).alias("slope"))
    over = F.col("mass") > F.col("target")
    sums = sums.withColumns({"low": F.when(over, F.col("low")).otherwise(F.col("lam")), "high": F.when(over, F.col("lam")).otherwise(F.col("high"))})
    newton = F.col("lam") - (F.col("mass") - F.col("target")) / F.col("slope")
    inside = (F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
    near = F.abs(F.col("mass") - F.col("target")) <= NEAR * F.col("target")
    after = F.when(near, F.col("lam")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
    return sums.withColumns({"lam": after, "settled": near | (F.col("high") - F.col("low") < 1e-12)}).select(*state.columns)


def multipliers(counts: DataFrame, weights: tuple[float, ...], cap: int, scratch: Scratch) -> DataFrame:
    """(s_source, source_size, target, mean, lam) of each source, from `counts` (source, size, n)."""
    totals = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).cast("double").alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("docs"))
    state = source_targets(totals, weights, cap).select(
        F.col("source").alias("s_source"), "source_size", "target", F.coalesce(F.col("source_size") / F.col("docs"), F.lit(1.0)).alias("mean"),
        # at the cap, or without any tokens, there is nothing to solve
        ((F.col("source_size") <= 0) | (F.col("target") >= cap * F.col("source_size"))).alias("settled"),
    )
    at = F.when(F.col("source_size") <= 0, F.lit(0.0)).when(F.col("settled"), F.lit(FAR)).otherwise(F.log(F.col("target") / F.col("source_size")))
    state = scratch.keep(state.withColumns({"lam": at, "low": F.lit(-FAR), "high": F.lit(FAR)}), "newton-0")
    for step in range(1, NEWTON_STEPS + 1):
        if state.filter(~F.col("settled")).isEmpty():
            break
        # what is settled stays as it is
        moved = newton_step(counts, state.filter(~F.col("settled")), cap)
        state = scratch.keep(moved.unionByName(state.filter("settled")), f"newton-{step}")
        scratch.drop(f"newton-{step - 1}")
    else:
        if not state.filter(~F.col("settled")).isEmpty():
            raise RuntimeError(f"the rates of some sources have not settled after {NEWTON_STEPS} steps")
    return state.select("s_source", "source_size", "target", "mean", "lam", (F.col("target") >= cap * F.col("source_size")).alias("full"))


def _numbered(docs: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """`docs` with _mix_no: 0, and 1, 2, ... for further rows of the same key."""
    again = docs.groupBy(F.col(key).alias("_mix_again")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_mix_again")
    again = scratch.keep(again, "again")
    if again.isEmpty():
        return docs.withColumn("_mix_no", F.lit(0).cast("long"))
    same = F.col(key) == F.col("_mix_again")
    rows = scratch.keep(docs.join(again, same, "left_semi"), "repeated")
    return docs.join(again, same, "left_anti").withColumn("_mix_no", F.lit(0).cast("long")).unionByName(number_within(rows, key, [key], "_mix_no", scratch))


def entropy_balance(
    spark: SparkSession, docs: DataFrame, size: str, source: str, key: str, weights: tuple[float, ...] = (1, 2, 3), cap: int = 3
) -> DataFrame:
    """`docs` with _mix_size (of the source), _mix_target, _mix_rate and _mix_copies, all other columns as
    they are. `key` is a 64-bit hash that tells documents apart. `docs` must be a written table."""
    scratch = Scratch(spark, "mix")
    counts = scratch.keep(docs.groupBy(F.col(source).alias("source"), F.col(size).alias("size")).agg(F.count(F.lit(1)).alias("n")), "counts")
    solved = multipliers(counts, weights, cap, scratch).select(F.col("s_source").alias("_mix_source"), F.col("source_size").alias("_mix_size"), F.col("target").alias("_mix_target"), "mean", "lam", "full")
    solved = scratch.keep(solved, "solved")
    rate = F.when(F.col("full"), F.lit(float(cap))).otherwise(tilted(F.col("lam"), F.col(size), F.col("mean"), cap)[0])
    draw = (F.shiftrightunsigned(F.xxhash64(F.col(key), F.col("_mix_no"), F.lit(17)), 11) + 0.5) / float(1 << 53)
    rated = _numbered(docs, key, scratch).join(solved, F.col(source).eqNullSafe(F.col("_mix_source"))).withColumn("_mix_rate", rate).drop("mean", "lam", "full")
    whole = F.floor("_mix_rate").cast("int")
    # rates within rounding of a whole number have nothing to draw
    part = F.when((F.col("_mix_rate") - whole) * (whole + 1 - F.col("_mix_rate")) > 1e-9, F.col("_mix_rate") - whole)
    rated = rated.withColumns({"_mix_whole": F.when(part.isNull(), F.round("_mix_rate")).otherwise(whole).cast("int"), "_mix_v": draw / part})
    rated = scratch.keep(rated, "rated")

    level = _levels(rated, source, size)
    rounded = rated.join(level, F.col(source).eqNullSafe(F.col("_l_source")), "left").drop("_l_source")
    above = F.col("_mix_v") - F.coalesce(F.col("_mix_level"), F.lit(1.0))  # below the level: one copy more
    rounded = rounded.withColumns({"_mix_copies": F.col("_mix_whole") + F.when(above < 0, 1).otherwise(0), "_mix_off": F.coalesce(F.abs(above), F.lit(9.0))})
    rounded = scratch.keep(rounded.drop("_mix_whole", "_mix_v", "_mix_level"), "rounded")
    scratch.drop("rated")
    fixes = scratch.keep(_corrections(rounded, source, size, key, cap), "fixes")
    fixed = rounded.join(fixes, (F.col(key) == F.col("_fix_key")) & (F.col("_mix_no") == F.col("_fix_no")), "left")
    fixed = fixed.withColumn("_mix_copies", (F.col("_mix_copies") + F.coalesce(F.col("_fix_by"), F.lit(0))).cast("int"))
    return fixed.select(*docs.columns, "_mix_size", "_mix_target", "_mix_rate", "_mix_copies")


def _levels(rated: DataFrame, source: str, size: str) -> DataFrame:
    """(_l_source, _mix_level): v below which a document gets one copy more. Tokens are counted in bins of v;
    the level is where they come to what the whole copies lack."""
    bin_ = F.least(F.floor(F.col("_mix_v") * (BINS // 2)), F.lit(BINS)).cast("int")
    bins = rated.groupBy(F.col(source).alias("_l_source"), bin_.alias("bin")).agg(
        F.sum(F.when(F.col("_mix_v").isNotNull(), F.col(size))).alias("tokens"), F.sum(F.col("_mix_whole") * F.col(size)).alias("whole"), F.first("_mix_target").alias("target")
    )
    everyone = Window.partitionBy("_l_source")
    upto = Window.partitionBy("_l_source").orderBy(F.col("bin").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lack = F.col("target") - F.sum("whole").over(everyone)
    bins = bins.withColumns({"lack": lack, "upto": F.sum(F.coalesce("tokens", F.lit(0))).over(upto)}).filter("bin is not null")
    fits = F.when(F.col("upto") <= F.col("lack"), F.col("bin") + 1).otherwise(F.lit(0))
    return bins.groupBy("_l_source").agg((F.max(fits) / (BINS // 2)).alias("_mix_level"))


def _corrections(rounded: DataFrame, source: str, size: str, key: str, cap: int) -> DataFrame:
    """(_fix_key, _fix_no, _fix_by): documents that get one copy more or less, so each source comes to its target.

    Each source and size class (powers of two) names at most SPARE documents that can take one copy more,
    and as many that can lose one, the nearest to the level. From large to small, those that still fit
    what is missing are taken; what then remains is less than the smallest spare document.
    """
    taken = rounded.groupBy(F.col(source).alias("_s")).agg((F.first("_mix_target") - F.sum(F.col("_mix_copies") * F.col(size))).alias("missing"))
    entry = F.struct(F.col(size).cast("long").alias("size"), F.col(key).alias("key"), F.col("_mix_no").alias("no"), "by")
    spare = None
    for by, able in ((1, F.col("_mix_copies") < cap), (-1, F.col("_mix_copies") > 0)):
        nearest = Window.partitionBy(F.col(source), F.floor(F.log2(F.col(size)))).orderBy("_mix_off", key, "_mix_no")
        some = rounded.filter(able & (F.col(size) > 0)).withColumn("_k", F.row_number().over(nearest)).filter(F.col("_k") <= SPARE)
        some = some.withColumn("by", F.lit(by)).select(F.col(source).alias("_s2"), entry.alias("e"))
        spare = some if spare is None else spare.unionByName(some)
    lists = spare.groupBy("_s2").agg(F.sort_array(F.collect_list("e"), asc=False).alias("few"))  # 2 * SPARE for each power of two
    state = F.struct(F.lit(0.0).alias("done"), F.array().cast("array<struct<size:bigint,key:bigint,no:bigint,by:int>>").alias("picked"))

    def take(a: Column, x: Column) -> Column:
        left = F.col("missing") - a["done"]
        fits = (F.signum(left) == x["by"]) & (x["size"] <= F.abs(left)) & ~F.exists(a["picked"], lambda p: (p["key"] == x["key"]) & (p["no"] == x["no"]))
        return F.when(fits, F.struct((a["done"] + x["size"] * x["by"]).alias("done"), F.array_append(a["picked"], x).alias("picked"))).otherwise(a)

    joined = taken.join(lists, F.col("_s").eqNullSafe(F.col("_s2")))
    picked = joined.select(F.explode(F.aggregate("few", state, take)["picked"]).alias("p"))
    return picked.select(F.col("p.key").alias("_fix_key"), F.col("p.no").alias("_fix_no"), F.col("p.by").alias("_fix_by"))


def mix_documents(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Per document: doc_id, source, size (words), source_size, target, rate, copies and taken (words)."""
    scratch = Scratch(spark, "mixdocs")
    body = F.coalesce(F.col("text"), F.lit(""))
    key = F.xxhash64("doc_id", "source", "text")
    sized = scratch.keep(docs.select("doc_id", "source", F.size(split_words(body)).cast("long").alias("size"), key.alias("_mix_key")), "sizes")
    mixed = entropy_balance(spark, sized, "size", "source", "_mix_key", weights, cap)
    return mixed.select(
        "doc_id", "source", "size", F.col("_mix_size").cast("long").alias("source_size"), F.col("_mix_target").alias("target"), F.col("_mix_rate").alias("rate"),
        F.col("_mix_copies").alias("copies"), (F.col("_mix_copies") * F.col("size")).cast("long").alias("taken"),
    )


def mix_corpus(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """`docs` with every document as often as the mix copies it; a document with no copies goes. The input's
    columns travel as one struct, so none of them can clash with those of the mix."""
    scratch = Scratch(spark, "mixcorpus")
    words = F.size(split_words(F.coalesce(F.col("text"), F.lit("")))).cast("long")
    packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), words.alias("words"), F.col("source").alias("of"), F.xxhash64("doc_id", "source", "text").alias("key"))
    mixed = entropy_balance(spark, scratch.keep(packed, "docs"), "words", "of", "key", weights, cap)
    scratch.drop("docs")  # the mix has written its own
    return mixed.filter("_mix_copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select("row.*")
