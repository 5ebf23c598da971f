"""Landed HTML scans (A1) and multi-class document scans.

Downloading is not part of the engine: pages arrive as files or tables and
are read with a declared schema; only successful downloads
(``request_code = 0``) go on to the parse jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlens.schemas import PAGE_RAW, POST_RAW


def scan_landed(spark: SparkSession, path: str, kind: str = "post", fmt: str = "parquet",
                successful_only: bool = True) -> DataFrame:
    """A1: read landed pages/posts (parquet or json) with the declared schema.
    ``fmt='text'`` reads one HTML file per row (whole file) and derives the
    key from the file name (``<post_id>.html``); fields that a file cannot give are null."""
    schema = POST_RAW if kind == "post" else PAGE_RAW
    if fmt == "text":
        raw = spark.read.text(path, wholetext=True)
        key = F.regexp_extract("_metadata.file_name", r"([0-9]+)\.html?$", 1).try_cast("long")
        known = {"post_id": key, "page_nr": key, "ord_key": key, "request_code": F.lit(0), "content_raw": F.col("value")}
        df = raw.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
    else:
        df = spark.read.schema(schema).format(fmt).load(path)
    if successful_only:
        df = df.filter(F.col("request_code") == 0)
    return df


def scan_classes(frames: dict[str, DataFrame], step: str, step_label: str | None = None,
                 training_only: bool = False, fields=None) -> DataFrame:
    """A4: one scan over several record classes: filter step/label (and
    ``ml_tag = 0``), optional field list, union by name with missing columns
    as null and a ``record_class`` column. A class without ``ml_tag`` has no training
    records."""
    out = None
    for name, df in frames.items():
        d = df.filter(F.col("step") == step)
        if step_label is not None:
            d = d.filter(F.col("step_label") == step_label)
        if training_only:
            d = d.filter(F.col("ml_tag") == 0 if "ml_tag" in d.columns else F.lit(False))
        if fields:
            d = d.select(*[c for c in fields if c in d.columns])
        d = d.withColumn("record_class", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def term_filter(df: DataFrame, terms: dict) -> DataFrame:
    """AND of term queries. On a text column a term matches one
    whitespace-separated token (case-sensitive); other columns compare equal."""
    cond = F.lit(True)
    for col, value in terms.items():
        if df.schema[col].dataType.typeName() == "string":
            cond = cond & F.array_contains(F.split(F.col(col), r"\s+"), F.lit(str(value)))
        else:
            cond = cond & (F.col(col) == F.lit(value))
    return df.filter(cond)
