"""Dataset store: write, keyed fetch, upsert, purge, export.

One Parquet dataset per record class, partitioned by ``step`` and
``step_label`` so a step scan prunes partitions. All operations are set-based
(joins, anti-joins, windows) -- never per-row lookups.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forumlens.session import ensure_checkpoint_dir

PARTITION_COLS = ("step", "step_label")


def write_dataset(df: DataFrame, path: str, mode: str = "append", partition_cols=PARTITION_COLS) -> None:
    """Write records of one class; partitioned by step/step_label."""
    cols = [c for c in partition_cols if c in df.columns]
    w = df.write.mode(mode)
    if cols:
        w = w.partitionBy(*cols)
    w.parquet(path)


def write_bucketed(df: DataFrame, key_cols, name: str = "steps", buckets: int | None = None, path: str | None = None) -> str:
    """A5/F1: write records hashed and sorted by their keys; returns the table's name.

    Joins and groupings by all of the keys read the table without a shuffle of the stored side,
    as long as it has no fewer buckets than the session has shuffle partitions (the default
    number). One file a bucket. The files lie at ``path`` (a new folder of the shared
    checkpoint folder if none is given); the table's name is known to this session's catalog.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    (df.repartition(buckets, *key_cols).write.format("parquet").bucketBy(buckets, *key_cols).sortBy(*key_cols)
     .option("path", path or f"{ensure_checkpoint_dir(spark)}/{table}").saveAsTable(table))
    return table


def scan_step(spark: SparkSession, path: str, step: str, step_label: str | None = None,
              ml_tags=None, columns=None) -> DataFrame:
    """A2/A4: scan one step (partition pruning), optional split and field list."""
    df = spark.read.parquet(path).filter(F.col("step") == step)
    if step_label is not None:
        df = df.filter(F.col("step_label") == step_label)
    if ml_tags:
        df = df.filter(F.col("ml_tag").isin(list(ml_tags)))
    return df.select(*columns) if columns else df


def fetch_by_keys(docs: DataFrame, keys: DataFrame, key_cols) -> tuple[DataFrame, DataFrame]:
    """A5/F1: batch fetch of records for a key set -> (found, missing keys).

    The reference raises on a missing key; here the missing keys come back as
    a left-anti report so the caller decides."""
    key_cols = list(key_cols)
    k = keys.select(*key_cols).distinct()
    return docs.join(k, key_cols, "inner"), k.join(docs.select(*key_cols), key_cols, "left_anti")


def latest_per_key(df: DataFrame, key_cols, order_cols) -> DataFrame:
    """H6: current record per key (last writer wins by ``order_cols`` desc)."""
    w = Window.partitionBy(*key_cols).orderBy(*[F.col(c).desc() for c in order_cols])
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")


def upsert(base: DataFrame, updates: DataFrame, key_cols, order_cols) -> DataFrame:
    """Keyed upsert: an update replaces every field of an existing key,
    new keys are inserted. Updates are deduplicated first (last wins)."""
    key_cols = list(key_cols)
    upd = latest_per_key(updates, key_cols, order_cols)
    return base.join(upd.select(*key_cols), key_cols, "left_anti").unionByName(upd)


def purge(df: DataFrame, cond) -> DataFrame:
    """Delete-by-query: the rows that remain once ``cond`` rows are gone.
    Write the result to a new path (Parquet files are immutable)."""
    return df.filter(~F.coalesce(cond, F.lit(False)))


def purge_keys(df: DataFrame, doomed: DataFrame, key_cols) -> DataFrame:
    """A9 by key: left-anti join against the keys to delete."""
    return df.join(doomed.select(*key_cols).distinct(), list(key_cols), "left_anti")


def export_csv(df: DataFrame, path: str, sep: str = ";") -> None:
    """CSV export (arrays/structs as JSON text, header, ';')."""
    out = df.select(*[F.to_json(F.col(f.name)).alias(f.name)
                      if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name)
                      for f in df.schema.fields])
    out.write.mode("overwrite").option("sep", sep).option("header", True).csv(path)


def save_table(df: DataFrame, path: str) -> None:
    """Vocabulary / phrase tables are plain Parquet datasets."""
    df.write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
