"""Exact deduplication against a persistent digest index, in DataFrame functions only.

The index is a table of digests, bucketed and sorted by digest. New data is reduced to one row for each
digest (partial aggregates, so a text with a third of all rows costs no more than any other), meets the
index in a sort-merge anti-join for which only the new data is shuffled, and what is left is appended to
the buckets. Adding the same rows again appends nothing, so a batch that was cut off can be run again.

Two texts are equal when their normalised forms are; `normalise` deletes white space. Defined results: null
is an empty text, and empty texts are equal; a null doc_id comes after all others; of rows that agree in
text, length and doc_id one stays; columns of the input other than doc_id and text are never read by name.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .skew import join_counted

SPACE = " \t\n\x0b\f\r"


def normalise(text: Column) -> Column:
    """A text without its white space; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def digest(text: Column, norm: Callable[[Column], Column] = normalise) -> Column:
    """The SHA-256 of the normalised text's UTF-8 bytes, 32 bytes."""
    return F.unhex(F.sha2(norm(text).cast("binary"), 256))


class DigestIndex:
    """A digest index in a folder that all executors see.

    A generation is a bucketed table in a folder of its own, named after its number and its buckets, so
    that any later session can open the index. Rows are (digest, chars, keep_id, batch, row): the document
    that stands for a digest, how long it is, and which row of which batch it was.
    """

    COLUMNS = "digest binary, chars long, keep_id long, batch string, row long"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        """Opens the index in `path`, or makes one with so many buckets (else as many as the session shuffles into)."""
        self.spark, self.path = spark, path.rstrip("/")
        found = self._generations()
        if found:
            self._open(*found[-1])
        else:
            self._open(0, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))

    def _generations(self) -> list[tuple[int, int]]:
        make = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = make(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(make(self.path))] if fs.exists(make(self.path)) else []
        found = [(int(m[1]), int(m[2]), m[0]) for m in (re.fullmatch(r"g(\d+)-of-(\d+)", n) for n in names) if m]
        # a later generation counts once its compaction has finished
        return sorted((g, b) for g, b, name in found if g == 0 or fs.exists(make(f"{self.path}/{name}/_SUCCESS")))

    def _create(self, generation: int, buckets: int) -> str:
        name = f"digest_index_{uuid.uuid4().hex}"
        self.spark.sql(
            f"create table {name} ({self.COLUMNS}) using parquet clustered by (digest) sorted by (digest) into {buckets} buckets location '{self.path}/g{generation}-of-{buckets}'"
        )
        return name

    def _open(self, generation: int, buckets: int) -> None:
        self.generation, self.buckets, self.name = generation, buckets, self._create(generation, buckets)

    def table(self) -> DataFrame:
        """All that was ever appended."""
        return self.spark.table(self.name)

    def entries(self) -> DataFrame:
        """The best entry of each digest. Buckets are by digest, so this needs no shuffle."""
        return best(self.table())

    def add(self, digests: DataFrame, batch: str, prefer_longest: bool = False) -> None:
        """Appends the digests that the index doesn't have; with `prefer_longest` also entries that are better
        than what it has (longer, then of a smaller id). `digests` has digest, chars, doc_id and row."""
        new = best(digests.select("digest", "chars", F.col("doc_id").alias("keep_id"), F.lit(batch).alias("batch"), "row")).alias("new")
        old, same = self.table().alias("old").hint("merge"), F.col("new.digest") == F.col("old.digest")
        if prefer_longest:
            same &= order("old") <= order("new")
        new.join(old, same, "left_anti").select("digest", "chars", "keep_id", "batch", "row").write.mode("append").insertInto(self.name)

    def compact(self, buckets: int | None = None) -> None:
        """A new generation with one file for each bucket, and with other buckets if asked for."""
        rows, buckets = self.entries(), buckets or self.buckets
        name = self._create(self.generation + 1, buckets)
        rows.repartition(buckets, "digest").write.mode("append").insertInto(name)
        self.generation, self.buckets, self.name = self.generation + 1, buckets, name


def order(of: str | None = None) -> Column:
    """What of equal texts comes first: the longest, then the smallest id."""
    c = lambda name: F.col(f"{of}.{name}" if of else name)
    return F.struct((-c("chars")).alias("a"), c("keep_id").isNull().alias("b"), F.coalesce(c("keep_id"), F.lit(0)).alias("c"))


def best(entries: DataFrame) -> DataFrame:
    """The first entry of each digest by `order`, by partial minima."""
    first = F.min(F.struct(order().alias("o"), "batch", "row", "chars", "keep_id")).alias("x")
    return entries.groupBy("digest").agg(first).select("digest", "x.chars", "x.keep_id", "x.batch", "x.row")


def digest_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, chars, row) of every document; write it before use, rows are numbered as they lie."""
    return docs.select(
        docs["doc_id"], digest(docs["text"]).alias("digest"), F.length(F.coalesce(docs["text"], F.lit(""))).cast("long").alias("chars"),
        F.monotonically_increasing_id().alias("row"),
    )


def keep_new(spark: SparkSession, docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """The documents of a batch whose text no earlier batch had, one of each text, with all their columns; the
    index then has them too. What a batch kept it keeps: later copies, longer ones too, are dropped."""
    scratch = Scratch(spark, "batch")
    whole = F.struct(*(docs[c] for c in docs.columns)).alias("doc")
    rows = scratch.keep(docs.select(whole, digest(docs["text"]).alias("digest"), F.monotonically_increasing_id().alias("row")), "rows")
    index.add(rows.select("digest", F.length(F.coalesce("doc.text", F.lit(""))).cast("long").alias("chars"), F.col("doc.doc_id").alias("doc_id"), "row"), batch)
    own = index.table().filter(F.col("batch") == batch).select("row")
    return rows.join(own, "row").select("doc.*")


def dedup_documents(spark: SparkSession, docs: DataFrame, batches: int = 3) -> DataFrame:
    """Per document: doc_id, keep_id (of the row that stays: the longest, then the smallest id), group_size,
    kept and text_sha256. Documents arrive in `batches`, by a hash of their id."""
    scratch = Scratch(spark, "digests")
    rows = scratch.keep(digest_rows(docs).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")), "rows")
    index = DigestIndex(spark, scratch.path("index"))
    for i in range(batches):
        index.add(rows.filter(F.col("batch") == i), str(i), prefer_longest=True)
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    keepers = index.entries().select("digest", "keep_id", F.col("row").alias("keep_row"))
    groups = scratch.keep(sizes.join(keepers, "digest"), "groups")
    joined = join_counted(rows.select("doc_id", "digest", "row"), groups, "digest", "group_size", rows.count())
    return joined.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
