"""Exact Jaccard join of shingle sets by vertical partitioning.

Shingles have a global order (that of their 64-bit names, in which every range is as full as any
other), which cuts into fragments: contiguous ranges of it. Two sets with Jaccard similarity of at
least p % differ in at most d = (100 - p) / (100 + p) * (|x| + |y|) elements, and an element lies in
one fragment; so with more than d fragments one fragment at least is the same in both. The join

1. collapses equal sets to a node (64 bits; sets whose further 64 bits differ get nodes of their own)
   and writes a signature per fragment, with so many fragments as the sizes at hand need;
2. keeps signatures that two nodes share, and compares every node with one of its group, the
   lead: a byte per fine fragment bounds the overlap from above; what it doesn't rule out is
   counted vertically: every set is cut into the same FRAGMENTS fragments, the overlap of a pair is
   counted in one fragment after the other and summed per pair, and a pair goes as soon as its sum
   and what is left of its sets cannot reach p %. What is linked becomes one component, and while
   links are found there is a turn with other leads, in which only nodes outside the lead's
   component are compared;
3. looks at what is left, all pairs of different components inside a group, in blocks of bounded
   size, in the same way.

So copies cost nothing, tight clusters cost a link per member, and no link between components is
lost. Sets whose fragments are so empty that step 1 could miss a partner add each shingle as a
signature. Shingles are compared by 64-bit hashes: two that differ share one with probability 2^-64.

Defined results: A-Z count as a-z; a text of fewer words than a shingle is one shingle; a text
without words, or null, has no shingles and is linked with nothing; repeated rows are linked;
null doc_ids take part, and the smallest doc_id of a component is that of its other rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .classify import distinct
from .components import connected_components
from .scratch import Scratch
from .words import U64, Words, blocks, mix, pair, words_of

#: Size classes: sizes of one class differ by this factor at most.
RATIO = 1.5
#: Members of a block of a group, in step 3.
BLOCK = 256
#: Turns of comparing groups with a lead, at most, and how many leads a set of nodes may get in one
#: (the first turn has one).
TURNS, LEADS = 3, 16
#: Vertical fragments of every set where overlaps are counted; each is shuffled on its own.
FRAGMENTS = 4


def size_limits(percent: int, top: int = 1 << 40) -> np.ndarray:
    """Where size classes begin. Linked sets lie in the same or in neighbouring classes."""
    ratio = max(RATIO, 105 / percent)
    limits = [1]
    while limits[-1] < top:
        limits.append(max(limits[-1] + 1, int(limits[-1] * ratio)))
    return np.array(limits, np.int64)


def most_different(size_sum: np.ndarray | int, percent: int):
    """The most elements in which two linked sets with this sum of sizes differ."""
    return size_sum * (100 - percent) // (100 + percent)


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, name) of each text's distinct shingles, sorted."""
    hashes, text = words.hashes(), words.text_of()
    names = mix(hashes + U64(n))
    for k in range(1, n):
        names = pair(names[: len(hashes) - k], hashes[k:], k) if len(hashes) > k else names[:0]
    keep = text[: len(names)] == text[n - 1 :][: len(names)]
    text_n, names = text[: len(names)][keep], names[keep]
    many = np.diff(words.first)
    for i in np.flatnonzero((many > 0) & (many < n)):  # the whole sequence is its only shingle
        h = mix(hashes[words.first[i] : words.first[i] + 1] + U64(n + 1000 * int(many[i])))
        for k in range(words.first[i] + 1, words.first[i + 1]):
            h = pair(h, hashes[k : k + 1], 1)
        text_n, names = np.append(text_n, i), np.append(names, h)
    return distinct(text_n, names)


def _fragments(text: np.ndarray, name: np.ndarray, fragments: np.ndarray):
    """(text, fragment, first element, sum of elements) of each non-empty fragment; `fragments`
    has the number for each element. Elements are sorted, so fragments are ranges."""
    at = ((name >> U64(32)) * fragments.astype(U64)) >> U64(32)
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (at[1:] != at[:-1])
    first = np.flatnonzero(new)
    sums = np.add.reduceat(mix(name), first) if len(first) else name[:0]
    return text[first], at[first], first, sums


def _set_names(text: np.ndarray, name: np.ndarray, texts: int, seed: int = 0x1234567) -> np.ndarray:
    """A 64-bit name of each text's set (0 if empty)."""
    first = np.searchsorted(text, np.arange(texts + 1))
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(name ^ U64(seed)))])
    size = np.diff(first)
    return np.where(size > 0, mix((sums[first[1:]] - sums[first[:-1]]) ^ mix(size.astype(U64))), U64(0))


def _nodes(text: np.ndarray, name: np.ndarray, texts: int) -> list[pa.Array]:
    """Both halves of the sets' 128-bit names."""
    return [pa.array(_set_names(text, name, texts, seed).view(np.int64)) for seed in (0x1234567, 0x7654321)]


def _signatures(text: np.ndarray, name: np.ndarray, size: np.ndarray, percent: int):
    """(text, class, signature): one per non-empty fragment in the text's own size class, and in
    the next if a linked set could lie there."""
    limits = size_limits(percent)
    own = np.searchsorted(limits, np.maximum(size, 1), side="right") - 1
    out = []
    for up in (0, 1):
        level = own + up
        takes = np.ones(len(size), bool) if not up else size * 100 >= percent * limits[level]
        some = np.flatnonzero(takes[text])
        t, h = text[some], name[some]
        top = limits[level + 1] - 1
        number = most_different(2 * top, percent) + 2
        ft, at, _, sums = _fragments(t, h, number[t])
        out.append((ft, level[ft], pair(sums, at + level[ft].astype(U64) * U64(1 << 32), 5)))
        full = np.bincount(ft, minlength=len(size))
        partner = np.minimum(size * 100 // percent, top)
        sparse = np.flatnonzero((full <= most_different(size + partner, percent))[t])
        out.append((t[sparse], level[t[sparse]], pair(h[sparse], level[t[sparse]].astype(U64), 6)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def sketch(name: np.ndarray, level: int, percent: int) -> bytes:
    """A byte for each of some fine fragments of a set: sets differ in at least as many elements
    as their sketches differ in bytes."""
    cells = int(4 * most_different(2 * (int(size_limits(percent)[level + 1]) - 1), percent) + 16)
    at = (((name >> U64(32)) * U64(cells)) >> U64(32)).astype(np.int64)
    return (np.bincount(at, (mix(name ^ U64(99)) & U64(0xFF)).astype(np.float64), cells).astype(np.int64) & 0xFF).astype(np.uint8).tobytes()


def _parse(n: int, percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                texts = block.num_rows
                text, name = shingle_sets(words_of(block.column("text"), lower=True), n)
                size = np.bincount(text, minlength=texts)
                of, level, signature = _signatures(text, name, size, percent)
                order = np.argsort(of, kind="stable")
                at = pa.array(np.searchsorted(of[order], np.arange(texts + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (level[order].astype(np.int32), signature[order].view(np.int64))]
                yield pa.RecordBatch.from_arrays(
                    [block.column("doc_id"), block.column("text_key"), pa.array(size), *_nodes(text, name, texts), *lists],
                    ["doc_id", "text_key", "n_shingles", "node", "more", "levels", "signatures"],
                )

    return run


def _sets(n: int, percent: int) -> Callable:
    """Texts to their sets: a sketch for each size class that a set takes part in (its own and, if a
    linked set could lie there, the next), and its vertical fragments, a column each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = size_limits(percent)
        for batch in batches:
            for block in blocks(batch, "text"):
                texts = block.num_rows
                text, name = shingle_sets(words_of(block.column("text"), lower=True), n)
                first = np.searchsorted(text, np.arange(texts + 1))
                size = np.diff(first)
                own = np.searchsorted(limits, np.maximum(size, 1), side="right") - 1
                two: tuple[list, list] = ([], [])
                for i in range(texts):
                    mine = name[first[i] : first[i + 1]]
                    two[0].append(sketch(mine, own[i], percent))
                    two[1].append(sketch(mine, own[i] + 1, percent) if size[i] * 100 >= percent * limits[own[i] + 1] else None)
                # elements are sorted within a text, so a fragment is a range of them
                part = (name >> U64(64 - FRAGMENTS.bit_length() + 1)).astype(np.int64)
                cut = np.searchsorted(text * FRAGMENTS + part, np.arange(texts * FRAGMENTS + 1)).astype(np.int32)
                lists = []
                for p in range(FRAGMENTS):
                    a, b = cut[:-1][p::FRAGMENTS], cut[1:][p::FRAGMENTS]
                    at = np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) + np.arange(int((b - a).sum()))
                    lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(b - a)]).astype(np.int32)), pa.array(name[at].view(np.int64))))
                yield pa.RecordBatch.from_arrays(
                    [*_nodes(text, name, texts), pa.array(size.astype(np.int32)), pa.array(own.astype(np.int32)), *(pa.array(x, pa.binary()) for x in two), *lists],
                    ["node", "more", "size", "own", "look0", "look1", *(f"e{p}" for p in range(FRAGMENTS))],
                )

    return run


SETS = "node long, more long, size int, own int, look0 binary, look1 binary, " + ", ".join(f"e{p} array<long>" for p in range(FRAGMENTS))


def _plausible(a: np.ndarray, b: np.ndarray, size_sum: np.ndarray, percent: int) -> np.ndarray:
    return (a != b).sum(-1) <= most_different(size_sum, percent)


def _filter_pairs(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [
                bool(_plausible(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8), m + n, percent))
                for x, y, m, n in zip(*(batch.column(c).to_pylist() for c in ("sketch_a", "sketch_b", "size_a", "size_b")), strict=True)
            ]
            yield batch.select(["a", "b", "level", "size_a", "size_b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _block_pairs(percent: int) -> Callable:
    """Members of two blocks of a group to the pairs that differ in component and may be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = []
            for i, level, same, members in zip(*(batch.column(c).to_pylist() for c in ("bi", "level", "same")), batch.column("members"), strict=True):
                m = members.values
                node, comp, size, block = (m.field(c).to_numpy() for c in ("node", "comp", "size", "block"))
                look = np.frombuffer(b"".join(m.field("sketch").to_pylist()), np.uint8).reshape(len(node), -1)
                left = np.arange(len(node)) if same else np.flatnonzero(block == i)
                right = np.arange(len(node)) if same else np.flatnonzero(block != i)
                found = []
                for k in left:
                    other = right[(comp[right] != comp[k]) & ((node[right] > node[k]) if same else True)]
                    good = other[_plausible(look[k], look[other], size[other].astype(np.int64) + size[k], percent)]
                    found.append(np.stack([np.full(len(good), k), good]))
                at = np.concatenate(found, 1) if found else np.empty((2, 0), np.int64)
                a, b = at[0].astype(np.int64), at[1].astype(np.int64)
                flip = node[a] > node[b]
                a, b = np.where(flip, b, a), np.where(flip, a, b)
                pairs.append(np.stack([node[a], node[b], np.full(len(a), level), size[a], size[b]]))
            if pairs:
                found = np.unique(np.concatenate(pairs, 1), axis=1)  # groups overlap
                columns = [pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "level", "size_a", "size_b"])

    return run


PAIR = "a long, b long, level int, size_a int, size_b int"


def _once(pairs: DataFrame) -> DataFrame:
    """Pairs that met at two levels, at the higher of them."""
    return pairs.groupBy("a", "b", "size_a", "size_b").agg(F.max("level").alias("level"))


class JaccardJoin:
    """One join: `documents` (a row each, with its node) and, on demand, links or components."""

    def __init__(self, spark: SparkSession, docs: DataFrame, n: int = 3, percent: int = 90):
        self.spark, self.n, self.percent = spark, n, percent
        self.scratch = scratch = Scratch(spark, "jaccard")
        scratch.release()
        self.texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
        kind = docs.schema["doc_id"].dataType.simpleString()
        schema = f"doc_id {kind}, text_key long, n_shingles long, node long, more long, levels array<int>, signatures array<long>"
        parsed = scratch.keep(self.texts.mapInArrow(_parse(n, percent), schema), "parsed")
        # different sets of one node: some hundred among 1e11 sets, so this table is all but always empty
        twice = parsed.groupBy("node").agg(F.min("more").alias("low"), F.max("more").alias("high")).filter("low < high").select("node", "low")
        twice = parsed.select("node", "more").join(twice, "node").filter("more > low").select("node", "more").distinct()
        self.renamed = scratch.keep(twice.select(F.col("node").alias("_node"), F.col("more").alias("_more"), F.xxhash64("node", "more").alias("_fresh")), "renamed")
        parsed = self._with_nodes(parsed)
        self.documents = scratch.keep(parsed.select("doc_id", "text_key", "n_shingles", "node"), "documents")
        rows = parsed.select("node", F.explode(F.arrays_zip("levels", "signatures")).alias("x")).select("node", F.col("x.levels").alias("level"), F.col("x.signatures").alias("sig"))
        groups = rows.groupBy("sig").agg(F.min("node").alias("_lo"), F.max("node").alias("_hi")).filter("_lo < _hi").select("sig")
        groups = scratch.keep(groups, "groups")
        shared = scratch.keep(rows.join(groups, "sig").groupBy("sig", "node").agg(F.first("level").alias("level")), "all-shared")
        scratch.drop("parsed", "groups")
        # near copies share dozens of signatures: of groups with the same members one is enough
        members = shared.groupBy("sig").agg(F.bit_xor(F.xxhash64("node")).alias("x"), F.count(F.lit(1)).alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"))
        one = members.groupBy("x", "n", "lo", "hi").agg(F.min("sig").alias("sig")).select("sig")
        self.shared = scratch.keep(shared.join(one, "sig", "left_semi"), "shared")
        scratch.drop("all-shared")
        self._keep_sets()

    def _with_nodes(self, df: DataFrame) -> DataFrame:
        """`df` (node, more and others) with node told apart where two sets shared it."""
        both = (F.col("node") == F.col("_node")) & (F.col("more") == F.col("_more"))
        return df.join(self.renamed, both, "left").withColumn("node", F.coalesce("_fresh", "node")).drop("more", "_node", "_more", "_fresh")

    def _keep_sets(self) -> None:
        """Sketches and fragments of the nodes that share a signature, from one document each."""
        active = self.shared.select("node").distinct()
        # partial minima first: a node that a third of all rows share is one row then
        one = self.documents.groupBy("node").agg(F.min(F.struct("text_key", "doc_id")).alias("x")).join(active, "node", "left_semi")
        one = one.select(F.col("x.text_key").alias("text_key"), F.col("x.doc_id").alias("_id"))
        # repeated rows give a text once
        texts = self.texts.join(one, "text_key").filter(F.col("doc_id").eqNullSafe(F.col("_id"))).groupBy("text_key").agg(F.first("text").alias("text")).select("text")
        self.sets = self.scratch.keep(self._with_nodes(texts.mapInArrow(_sets(self.n, self.percent), SETS)), "sets")
        looks = [self.sets.select("node", (F.col("own") + up).alias("level"), "size", F.col(f"look{up}").alias("sketch")) for up in (0, 1)]
        self.sketches = looks[0].unionByName(looks[1].filter("sketch is not null"))

    def count_overlaps(self, pairs: DataFrame, name: str) -> DataFrame:
        """Links among `pairs` (a, b and their sizes, each pair once): overlaps are counted in one vertical
        fragment after the other and summed per pair. What a fragment's turn shuffles is that fragment alone,
        and pairs that cannot reach the limit any more are not in the next turn."""
        state = pairs.select("a", "b", "size_a", "size_b", F.lit(0).alias("n"), F.col("size_a").alias("left_a"), F.col("size_b").alias("left_b"))
        for p in range(FRAGMENTS):
            part = [self.sets.select(F.col("node").alias(x), F.col(f"e{p}").alias(f"e_{x}")) for x in ("a", "b")]
            met = state.join(part[1], "b").join(part[0], "a")  # the lead's, a, meets its partners last: once per lead
            met = met.withColumns({
                "n": F.col("n") + F.size(F.array_intersect("e_a", "e_b")),
                "left_a": F.col("left_a") - F.size("e_a"), "left_b": F.col("left_b") - F.size("e_b"),
            })
            most = F.col("n") + F.least("left_a", "left_b")
            met = met.filter(100 * most.cast("long") >= self.percent * (F.col("size_a").cast("long") + F.col("size_b") - most))
            state = self.scratch.keep(met.select(*state.columns), f"{name}-{p}")
            self.scratch.drop(f"{name}-{p - 1}")
        return state.select("a", "b")

    def _rows(self, comps: DataFrame | None) -> DataFrame:
        """Members of shared signatures with their component (without components, themselves)."""
        rows = self.shared.select("sig", "level", "node")
        if comps is None:
            return rows.withColumn("comp", F.col("node"))
        return rows.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    def star_links(self, comps: DataFrame | None, turn: int) -> tuple[DataFrame, int]:
        """Links between the nodes of a group and one of them, its lead, where their components
        differ, and how many pairs were counted. Every turn has other leads, a few for all groups."""
        rows = self.scratch.keep(self._rows(comps), f"rows-{turn}")
        luck = F.xxhash64("node", F.lit(turn), F.pmod("sig", F.lit(LEADS if turn else 1)))
        leads = rows.groupBy("sig").agg(F.min(F.struct(luck, "node", "comp")).alias("x"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi"))
        leads = leads.filter("_lo < _hi").select("sig", F.col("x.node").alias("lead"), F.col("x.comp").alias("lead_comp"))
        met = rows.join(leads, "sig").filter("comp <> lead_comp")
        pairs = met.select(F.col("lead").alias("a"), F.col("node").alias("b"), "level").distinct()
        look = lambda x: self.sketches.select(F.col("node").alias(x), "level", F.col("size").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}"))
        pairs = pairs.join(look("a"), ["a", "level"]).join(look("b"), ["b", "level"])
        pairs = self.scratch.keep(_once(pairs.mapInArrow(_filter_pairs(self.percent), PAIR)), f"star-pairs-{turn}")
        return self.count_overlaps(pairs, f"star-links-{turn}"), pairs.count()

    def other_links(self, comps: DataFrame | None) -> DataFrame:
        """Links between nodes of different components (all links, without components)."""
        rows = self.scratch.keep(self._rows(comps), "rows")
        mixed = rows.groupBy("sig").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.count(F.lit(1)).alias("many")).filter("_lo < _hi").select("sig", "many")
        number = F.ceil(F.col("many") / BLOCK).cast("int")
        rows = rows.join(mixed, "sig").withColumns({"number": number, "block": F.pmod(F.xxhash64("node"), number).cast("int")})
        rows = rows.join(self.sketches, ["node", "level"])
        placed = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("number") - 1))).withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")})
        lists = placed.groupBy("sig", "level", "bi", "bj").agg(F.collect_list(F.struct("node", "comp", "size", "block", "sketch")).alias("members"))
        pairs = lists.select("bi", "level", (F.col("bi") == F.col("bj")).alias("same"), "members").mapInArrow(_block_pairs(self.percent), PAIR)
        return self.count_overlaps(self.scratch.keep(_once(pairs), "other-pairs"), "other-links")

    def links(self) -> DataFrame:
        """All links (a, b) between nodes; copies are in `documents`, by node."""
        return self.other_links(None)

    def components(self) -> DataFrame:
        """(node, comp) of the nodes that have a link."""
        links, comps = None, None
        for turn in range(TURNS):
            found, counted = self.star_links(comps, turn)
            links = found if links is None else links.unionByName(found)
            comps = connected_components(links, self.scratch, f"turn-{turn}")
            if found.count() * 4 <= counted:  # what remains is mostly no link
                break
        links = links.unionByName(self.other_links(comps))
        return connected_components(links, self.scratch, "all")

    def placed(self) -> DataFrame:
        """`documents` with comp, null where there are no shingles."""
        rows = self.documents.join(self.components(), "node", "left")
        return rows.withColumn("comp", F.when(F.col("n_shingles") > 0, F.coalesce("comp", "node")))

    def grouped(self) -> DataFrame:
        """`documents` with component_id, the smallest doc_id reachable by links."""
        rows = self.placed()
        least = rows.filter("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
        least = self.scratch.keep(least, "least")  # a plain table, so that a large component can be split in the join
        return rows.join(least, "comp", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))


def component_of_documents(spark: SparkSession, docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id."""
    return JaccardJoin(spark, docs, n, percent).grouped().select("doc_id", "n_shingles", "component_id")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one row of each group of linked documents, the one with the smallest doc_id (null
    last), then the smallest hash of its text. Texts without shingles all stay."""
    join = JaccardJoin(spark, docs, n, percent)
    rows = join.placed()
    named = lambda df, id_, key, once: df.select(F.col(id_).alias("_jj_id"), F.col(key).alias("_jj_key"), F.lit(once).alias("_jj_once"))
    least = rows.filter("comp is not null").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("x"))
    bare = named(rows.filter("comp is null"), "doc_id", "text_key", False).distinct()
    chosen = join.scratch.keep(named(least, "x.doc_id", "x.text_key", True).unionByName(bare), "chosen")
    join.scratch.drop_but("chosen")
    key = F.xxhash64("text")
    kept = docs.withColumn("_jj_text", key).join(chosen, F.col("doc_id").eqNullSafe(F.col("_jj_id")) & (F.col("_jj_text") == F.col("_jj_key")))
    # one row where a document is repeated
    first = F.row_number().over(Window.partitionBy("doc_id", "_jj_text").orderBy(F.lit(0)))
    return kept.withColumn("_jj_row", first).filter(~F.col("_jj_once") | (F.col("_jj_row") == 1)).select(*docs.columns)
