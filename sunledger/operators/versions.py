"""Stored tables that change by commits.

A table is a folder with Parquet files, dealt into buckets by a hash of its key, and a log of manifests. A
manifest names the files of one version, so a reader has a snapshot that no writer can change. A change
rewrites the buckets that its keys fall into and nothing else: files of other buckets keep their names
and go into the next manifest as they are. Versions are committed by creating the next manifest if it
doesn't exist: of two writers of one version one fails. It may go on by itself if the winner touched other
buckets, or else raises `Conflict`, and its files are never named by any manifest.

Files carry the least and greatest value of chosen columns, so a reader opens only those that may
have what it looks for. A table may be clustered by some columns: the rows of a bucket are then cut into files
along an order in which neighbours are close in all of them. A change may carry the name of the batch it came from; a batch that was
committed once is not applied again.
"""

from __future__ import annotations

import datetime
import decimal
import json
import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from . import sinks
from .clustering import column_cuts, z_order
from .referrals import upsert

#: Values that a manifest can hold; other columns (but for decimals) have no bounds.
BOUNDED = ("string", "date", "tinyint", "smallint", "int", "bigint", "double", "float")
#: So many rows has a file of a clustered table at most.
FILE_ROWS = 1_000_000


class Conflict(RuntimeError):
    """Another writer changed the same buckets first."""


@dataclass(frozen=True)
class File:
    path: str
    bucket: int
    rows: int
    #: Per column the least and greatest value, as text in JSON.
    bounds: dict[str, list]


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str
    key: str
    buckets: int
    files: list[File]
    #: Columns whose least and greatest values are kept.
    bounds: list[str] = field(default_factory=list)
    #: Buckets that this version rewrote.
    touched: list[int] = field(default_factory=list)
    batches: list[str] = field(default_factory=list)
    #: Columns that rows are clustered by, and where their cells begin.
    cluster: dict[str, list] = field(default_factory=dict)
    file_rows: int = FILE_ROWS


def _plain(value: object) -> object:
    return value.isoformat() if isinstance(value, datetime.date) else value


def _bound(value: object, towards: float) -> object:
    """A bound as JSON holds it; of a decimal the next number outwards, as it may be no floating-point number."""
    return math.nextafter(float(value), towards) if isinstance(value, decimal.Decimal) else _plain(value)


class VersionedTable:
    """A table in a folder that all executors see, with one row a key."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._make = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._make(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    @classmethod
    def create(
        cls, spark: SparkSession, path: str, rows: DataFrame, key: str, buckets: int = 16, bounds: tuple[str, ...] = (), cluster: tuple[str, ...] = (), file_rows: int = FILE_ROWS
    ) -> VersionedTable:
        """A new table with `rows`; fails where there is one. With `cluster` (these columns have bounds too) files have
        at most `file_rows` rows, or more where there would be more files than cells: rows of a cell have no order, so smaller
        files would be no narrower. `rows` are read three times then, first for the quantiles of these columns, then for the ranges
        of the order that tasks sort and write."""
        table = cls(spark, path)
        cuts, count = column_cuts(rows, cluster) if cluster else ({}, 0)
        file_rows = max(file_rows, -(-count // math.prod(len(at) + 1 for at in cuts.values())))
        empty = Manifest(-1, rows.schema.json(), key, buckets, [], list(dict.fromkeys((key, *bounds, *cluster))), cluster=cuts, file_rows=file_rows)
        files = table._write(rows, empty)
        table._put(replace(empty, version=0, files=files, touched=list(range(buckets))))
        return table

    # The log.

    def _log(self, version: int) -> str:
        return f"{self.path}/_log/{version:012d}.json"

    def versions(self) -> list[int]:
        folder = self._make(f"{self.path}/_log")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()[:12]) for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """The manifest of a version, the last if none is given."""
        version = self.versions()[-1] if version is None else version
        text = self.spark.read.text(self._log(version), wholetext=True).first()[0]
        read = json.loads(text)
        return Manifest(**(read | {"files": [File(**f) for f in read["files"]]}))

    def _put(self, manifest: Manifest) -> None:
        """Creates the manifest's file, whole, or raises where its version exists."""
        path = self._make(self._log(manifest.version))
        draft = self._make(f"{self.path}/_log/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(json.dumps(manifest, default=lambda x: x.__dict__).encode())
        out.close()
        # unlike a plain rename this one fails where the name is taken
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._make(self.path).toUri(), self.spark._jsc.hadoopConfiguration())
        never = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, path, never)
        except Exception as error:
            self._fs.delete(draft, False)
            if self._fs.exists(path):
                raise Conflict(f"version {manifest.version} exists") from error
            raise

    # Reading.

    def bucket(self, key: Column, manifest: Manifest) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(manifest.buckets)).cast("int")

    def files(self, manifest: Manifest, buckets: set[int] | None = None, **ranges: tuple) -> list[File]:
        """Files that may have rows of these buckets and, for a column, of the range (least, greatest; None is open)."""

        def may(f: File) -> bool:
            for column, (least, greatest) in ranges.items():
                low, high = f.bounds.get(column, [None, None])
                if low is None:
                    if column in f.bounds:
                        return False  # all null
                    continue
                if (least is not None and high < _plain(least)) or (greatest is not None and low > _plain(greatest)):
                    return False
            return True

        return [f for f in manifest.files if (buckets is None or f.bucket in buckets) and may(f)]

    def read(self, manifest: Manifest, files: list[File]) -> DataFrame:
        """All rows of some files."""
        schema = StructType.fromJson(json.loads(manifest.schema))
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f.path}" for f in files))

    def snapshot(self, version: int | None = None, **ranges: tuple) -> DataFrame:
        """All rows of a version; with ranges, the rows inside, from the files that may have some."""
        manifest = self.manifest(version)
        df = self.read(manifest, self.files(manifest, None, **ranges))
        for column, (least, greatest) in ranges.items():
            if least is not None:
                df = df.filter(F.col(column) >= F.lit(least))
            if greatest is not None:
                df = df.filter(F.col(column) <= F.lit(greatest))
        return df

    # Writing.

    def _write(self, rows: DataFrame, manifest: Manifest) -> list[File]:
        """New files with `rows`, one for each bucket that has some. Of a clustered table tasks write ranges of the order, however few
        buckets there are, each in files of a limited number of rows."""
        name = uuid.uuid4().hex
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        dealt = rows.withColumn("_bucket", self.bucket(F.col(manifest.key), manifest))
        if manifest.cluster:
            # a column of its own, or else each comparison works it out; equal places are cut by key
            order = ("_bucket", "_place", manifest.key)
            placed = dealt.withColumn("_place", z_order(manifest.cluster, kinds)).repartitionByRange(*order).sortWithinPartitions(*order)
            writer = placed.drop("_place").write.option("maxRecordsPerFile", manifest.file_rows)
        else:
            writer = dealt.repartition(manifest.buckets, "_bucket").write
        writer.partitionBy("_bucket").parquet(f"{self.path}/data/{name}")
        columns = [c for c in manifest.bounds if kinds[c] in BOUNDED or kinds[c].startswith("decimal")]
        # what is kept of a file is a row, whatever its size
        written = self.spark.read.schema(StructType([*rows.schema.fields, StructField("_bucket", IntegerType())])).parquet(f"{self.path}/data/{name}")
        of = written.groupBy(F.col("_metadata.file_path").alias("_path"), "_bucket").agg(
            F.count(F.lit(1)).alias("_rows"), *(x for c in columns for x in (F.min(c).alias(f"_min_{c}"), F.max(c).alias(f"_max_{c}")))
        )
        return [
            File(f"data/{name}/" + r["_path"].split(f"/data/{name}/")[1], r["_bucket"], r["_rows"], {c: [_bound(r[f"_min_{c}"], -math.inf), _bound(r[f"_max_{c}"], math.inf)] for c in columns})
            for r in of.collect()
        ]

    def commit(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame], base: Manifest | None = None, batch: str | None = None) -> Manifest:
        """Rewrites the buckets of `keys` (a column of the key's name) as `change` of their rows, as the version after `base`
        (the last). At most as many numbers as there are buckets come to the driver."""
        base = base or self.manifest()
        if batch is not None and batch in self.manifest().batches:
            return self.manifest()
        touched = {r[0] for r in keys.select(self.bucket(F.col(base.key), base)).distinct().collect()}
        columns = StructType.fromJson(json.loads(base.schema)).names
        changed = change(self.read(base, self.files(base, touched))).select(*columns)
        new = self._write(changed, base) if touched else []
        return self._settle(base, touched, new, batch)

    def _settle(self, base: Manifest, touched: set[int], new: list[File], batch: str | None) -> Manifest:
        while True:
            files = [f for f in base.files if f.bucket not in touched] + new
            batches = base.batches + ([batch] if batch is not None else [])
            manifest = replace(base, version=base.version + 1, files=files, touched=sorted(touched), batches=batches)
            try:
                self._put(manifest)
                return manifest
            except Conflict:
                base = self.manifest(base.version + 1)
                if touched & set(base.touched) or (batch is not None and batch in base.batches):
                    raise

    def upsert(self, incoming: DataFrame, updates: tuple[str, ...], order: list[Column | str], base: Manifest | None = None, batch: str | None = None) -> Manifest:
        """New keys come in, known ones take the incoming values of `updates`."""
        key = (base or self.manifest()).key
        return self.commit(incoming.select(key), lambda rows: upsert(rows, incoming, key, updates, order), base, batch)

    def update(self, changes: DataFrame, columns: tuple[str, ...], order: str | None = None, now: Column | None = None, base: Manifest | None = None) -> Manifest:
        """Values of known keys."""
        key = (base or self.manifest()).key
        return self.commit(changes.select(key), lambda rows: sinks.update_by_key(rows, changes, key, columns, order, now), base)

    def delete(self, keys: DataFrame, base: Manifest | None = None) -> Manifest:
        key = (base or self.manifest()).key
        return self.commit(keys.select(key), lambda rows: sinks.delete_by_key(rows, keys, key), base)

    def reload(self, rows: DataFrame, base: Manifest | None = None) -> Manifest:
        """All rows anew; any change since `base` is a conflict."""
        base = base or self.manifest()
        return self._settle(base, set(range(base.buckets)), self._write(rows.select(*StructType.fromJson(json.loads(base.schema)).names), base), None)
