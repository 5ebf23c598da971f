"""Document formats and record shaping."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlens.operators.outcomes import split_filter


def doc_format(df: DataFrame, fmt: str, ml_tags=None, key_cols=("post_id", "ord_key", "ml_tag")) -> DataFrame:
    """B6 (+B4): a dataset in one of the reference's document formats:
    'tokens' -> token->count map, 'keys' -> (id, count) list,
    'unprocessed_tokens' -> token list, 'all_#n' -> the whole records of step n (of a
    frame without a ``step`` column, which is one step's own dataset, every record).
    Case-insensitive; anything else raises."""
    f = fmt.lower()
    d = split_filter(df, ml_tags) if "ml_tag" in df.columns else df
    keys = [c for c in key_cols if c in d.columns]
    if f == "tokens":
        return d.select(*keys, F.map_from_arrays("key_tokens", "values").alias("doc"))
    if f == "keys":
        return d.select(*keys, F.arrays_zip(F.col("keys").alias("id"), F.col("values").alias("cnt")).alias("doc"))
    if f == "unprocessed_tokens":
        col = "tokenized_content" if "tokenized_content" in d.columns else "tokens"
        return d.select(*keys, F.col(col).alias("doc"))
    step = re.fullmatch(r"all_(#[0-9]+)", f)
    if step:
        return d.where(F.col("step") == step[1]) if "step" in d.columns else d
    raise ValueError(f"unknown document format {fmt!r}")


def filter_map(df: DataFrame, cond: Column | None = None, *exprs: Column) -> DataFrame:
    """The filter -> map -> length iterator is a filtered projection;
    its length is ``count()``."""
    d = df.filter(cond) if cond is not None else df
    return d.select(*exprs) if exprs else d


def conform(df: DataFrame, schema, defaults: dict | None = None, overrides: dict | None = None,
            exclude=(), none_to_default: bool = True) -> DataFrame:
    """Project onto a declared schema by field name: missing fields take
    defaults, nulls optionally too, overrides win, excluded fields dropped."""
    defaults, overrides = defaults or {}, overrides or {}
    cols = []
    for f in schema.fields:
        if f.name in exclude:
            continue
        if f.name in overrides:
            c = F.lit(overrides[f.name])
        elif f.name in df.columns:
            c = F.col(f.name)
            if none_to_default and f.name in defaults:
                c = F.coalesce(c, F.lit(defaults[f.name]))
        else:
            c = F.lit(defaults.get(f.name))
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def flatten_all(col: Column | str, depth: int) -> Column:
    """Flatten nested arrays ``depth`` levels deep."""
    c = F.col(col) if isinstance(col, str) else col
    for _ in range(depth):
        c = F.flatten(c)
    return c


def row_count(df: DataFrame) -> DataFrame:
    """G15."""
    return df.select(F.count(F.lit(1)).alias("n"))
