"""Stored datasets with keyed upsert and purge.

A dataset is a folder of Parquet files cut into hash buckets of its key. Its rows never
change in place: a write makes new files for the buckets it touches and then commits a
manifest, a small table that names the folder of each bucket's current rows. Readers take
the latest committed manifest, so a write that fails or is still running changes nothing
for them, and the files of untouched buckets stay the very same.

    <path>/data/version=<v>/bucket=<b>/*.parquet    rows written by version v
    <path>/manifest/version=<v>/*.parquet           one row a bucket: where its rows are

One writer at a time works on a dataset.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from forumlens.sources.store import latest_per_key

MANIFEST = "bucket int, data_version int, keys string, row_schema string"


@dataclass
class Keyed:
    """A dataset as its latest manifest names it."""
    spark: SparkSession
    path: str
    version: int
    keys: list[str]
    schema: StructType
    folders: dict[int, int | None]  # bucket -> version of its rows (None: it has none)

    @property
    def buckets(self) -> int:
        return len(self.folders)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The current rows (of some buckets)."""
        wanted = self.folders if only is None else only
        paths = [f"{self.path}/data/version={self.folders[b]}/bucket={b}" for b in wanted if self.folders[b] is not None]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def fetch(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys; only the buckets that hold them are read."""
        return self.read(self._touched(keys)).join(keys.select(*self.keys).distinct(), self.keys, "left_semi")

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())  # at most one a bucket

    def _commit(self, rows: DataFrame, touched: list[int]) -> Keyed:
        """``rows`` become all rows of the touched buckets."""
        new = self.version + 1
        data = f"{self.path}/data/version={new}"
        rows.select(*self.schema.names).withColumn("bucket", self.bucket()).repartition(
            max(1, min(len(touched), self.buckets)), "bucket").write.partitionBy("bucket").parquet(data)
        left = {int(f.split("=")[1]) for f in _folders(self.spark, data) if f.startswith("bucket=")}
        folders = {b: (new if b in left else None) if b in set(touched) else v for b, v in self.folders.items()}
        return _put_manifest(Keyed(self.spark, self.path, new, self.keys, self.schema, folders))

    def upsert(self, updates: DataFrame, order_cols: list[str]) -> Keyed:
        """A row of ``updates`` replaces the row of its key or is added; of several updates
        of a key the last by ``order_cols`` counts. Only the buckets of their keys are rewritten."""
        upd = latest_per_key(updates.select(*self.schema.names), self.keys, order_cols)
        touched = self._touched(updates)
        if not touched:
            return self
        kept = self.read(touched).join(upd.select(*self.keys), self.keys, "left_anti")
        return self._commit(kept.unionByName(upd), touched)

    def purge(self, doomed: Column) -> Keyed:
        """The rows for which ``doomed`` is true go; only the buckets that hold one are rewritten."""
        gone = F.coalesce(doomed, F.lit(False))
        touched = self._touched(self.read().where(gone))
        return self._commit(self.read(touched).where(~gone), touched) if touched else self


def _put_manifest(d: Keyed) -> Keyed:
    rows = [(b, v, json.dumps(d.keys), d.schema.json()) for b, v in d.folders.items()]
    d.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{d.path}/manifest/version={d.version}")
    return d


def create(rows: DataFrame, path: str, keys: list[str], order_cols: list[str], buckets: int = 64) -> Keyed:
    """A new dataset of ``rows``, one for each key (the last by ``order_cols``). Choose ``buckets``
    so that one fits a task well: it is the unit that an upsert rewrites."""
    empty = Keyed(rows.sparkSession, path, 0, list(keys), rows.schema, dict.fromkeys(range(buckets)))
    return empty._commit(latest_per_key(rows, list(keys), order_cols), list(range(buckets)))


def open_dataset(spark: SparkSession, path: str) -> Keyed:
    """The dataset as its last committed manifest names it."""
    m = spark.read.parquet(f"{path}/manifest")
    last = m.agg(F.max("version")).first()[0]
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest/version={last}").orderBy("bucket").collect()  # one a bucket
    return Keyed(spark, path, last, json.loads(rows[0]["keys"]), StructType.fromJson(json.loads(rows[0]["row_schema"])),
                 {r["bucket"]: r["data_version"] for r in rows})


def _folders(spark: SparkSession, path: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory()) if fs.exists(at) else []


def purge_everywhere(spark: SparkSession, root: str, column: str, value) -> dict[str, bool]:
    """A9 over a store: rows with this value of ``column`` go from every dataset below ``root``
    that has the column. Returns, by dataset, whether it was changed."""
    out = {}
    for name in _folders(spark, root):
        d = open_dataset(spark, f"{root}/{name}")
        if column in d.schema.names:
            out[name] = d.purge(F.col(column) == value).version != d.version
    return out


def vacuum(d: Keyed) -> int:
    """Delete the files that the current manifest doesn't name; returns how many folders went.
    For when no reader holds an earlier version."""
    named = {f"version={v}/bucket={b}" for b, v in d.folders.items() if v is not None}
    gone = 0
    for version in _folders(d.spark, f"{d.path}/data"):
        for bucket in _folders(d.spark, f"{d.path}/data/{version}"):
            if f"{version}/{bucket}" not in named:
                at = d.spark._jvm.org.apache.hadoop.fs.Path(f"{d.path}/data/{version}/{bucket}")
                gone += bool(at.getFileSystem(d.spark._jsc.hadoopConfiguration()).delete(at, True))
    return gone
