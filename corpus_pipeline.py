"""Corpus pipeline: toxicity, quality, near duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. The
first four return the columns of ``documents``: rows rejected as toxic go, then rows
rejected for quality, then all but one of each group of near duplicates, then rows
that hold a benchmark item. The last returns what the mix takes of each document.

Every stage takes an empty table (and returns one), nulls in any column, and columns of
any further names, which it hands on unchanged; what it does with null and empty texts, ties and
repeated rows is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from forumlens.llm import decontam, lsh_forest, mixing, quality_ftrl, queries, toxicity_pu
from forumlens.llm.common import prepare, unnamed
from forumlens.sources.scratch import scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _where_score(docs: DataFrame, scorer, weights, condition: str) -> DataFrame:
    """The rows of ``docs`` whose score fits, whatever columns they have."""
    plain, (text,) = unnamed(docs, "text")
    return scorer(plain, weights, plain.columns, text).where(condition).drop("score").toDF(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: rows with a toxicity score of 0.5 or more go.

    Null and empty texts have the score of the model's constant, equal texts the same score, so
    repeated rows stay or go together. Without any label nothing is known, and all rows stay.
    """
    prepare(spark)
    weights = queries.toxicity_weights(docs, _table(spark, sf_dir, "labels"))
    if not weights.any():
        return docs
    return _where_score(docs, toxicity_pu.score, weights, "score < 0.5")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: rows with a quality score under 0.5 go.

    Null and empty texts have the score of the model's constant, equal texts the same score, so
    repeated rows stay or go together. Without any label all scores are 0.5, and all rows stay.
    """
    prepare(spark)
    weights = queries.quality_weights(docs, _table(spark, sf_dir, "labels"))
    return _where_score(docs, quality_ftrl.score, weights, "score >= 0.5")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each class of near duplicates the row with the smallest id stays.

    Of repeated rows (and of ties of the smallest id) one stays; a null id stands for a class only
    if none of its rows has an id. Empty texts are copies of each other, null texts all stay.
    """
    prepare(spark)
    return lsh_forest.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: rows that hold a benchmark item go.

    Null and empty texts hold none; repeated rows stay or go together. An empty benchmark, or one of
    null and empty items, rejects nothing.
    """
    prepare(spark)
    return decontam.clean(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the words that the mix takes of each document, a row for each row.

    Null and empty texts have size 0 and nothing taken; a null source is a source; repeated rows
    are taken separately.
    """
    prepare(spark)
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Models, MinHash and alignment are beyond SQL; tests hold run() against its parts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
