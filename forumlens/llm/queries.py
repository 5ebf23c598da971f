"""Registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlens.llm import (ann_mih, decontam, hard_negatives, lang_bitmask, license_scan, lsh_forest, mixing,
                           quality_ftrl, superminhash, token_hist, toxicity_pu, url_filter, vector_codes)
from forumlens.llm.common import fold, prepare


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(mod: int, rest: int) -> Column:
    """A null id is never held out, and never learned from."""
    return F.coalesce(fold(F.col("doc_id"), mod) == rest, F.lit(False)).alias("held_out")


def _labelled(docs: DataFrame, labels: DataFrame, column: str, how: str) -> DataFrame:
    """(doc_id, label), without texts; of repeated labels the largest counts."""
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(column).alias("label"))
    return docs.select("doc_id").join(known, "doc_id", how)


def quality_weights(docs: DataFrame, labels: DataFrame):
    learn = F.coalesce(fold(F.col("doc_id"), 3) != 1, F.lit(False))
    return quality_ftrl.train(_labelled(docs.where(learn), labels, "quality", "inner"), texts=docs)


def toxicity_weights(docs: DataFrame, labels: DataFrame):
    learn = F.coalesce(fold(F.col("doc_id"), 5) != 0, F.lit(False))
    return toxicity_pu.train(_labelled(docs.where(learn), labels, "toxic", "left"), texts=docs)


def op1_ann_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 nearest by inner product for every row whose vec_id is divisible by 20."""
    return ann_mih.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op2_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from documents with crc32(doc_id) mod 5 other than 0."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = lang_bitmask.train(lang_bitmask.sample(docs, fold(F.col("doc_id"), 5) != 0))
    got = lang_bitmask.predict(docs.select("doc_id", "text"), model, ["doc_id"])
    return got.select("doc_id", _held_out(5, 0), "lang_pred", "score")


def op3_mix_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken from every document for a mix of all words by source weights."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op4_decontaminate_qgrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents within an edit budget of 10 %."""
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_license_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License templates found in documents."""
    return license_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text, learned from labels with crc32(doc_id) mod 3 other than 1."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    got = quality_ftrl.score(docs, quality_weights(docs, _table(spark, sf_dir, "labels")), ["doc_id"])
    return got.select("doc_id", _held_out(3, 1), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of token counts with suffix sums for every context limit."""
    vocabulary = token_hist.read_vocabulary(spark, f"file://{token_hist.VOCABULARY}")
    docs = _table(spark, sf_dir, "documents").select("text")
    return token_hist.histogram(token_hist.lengths(docs, vocabulary, []))


def op8_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document under 5-word Jaccard 0.8."""
    return lsh_forest.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every text, learned from labels with crc32(doc_id) mod 5 other than 0."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    got = toxicity_pu.score(docs, toxicity_weights(docs, _table(spark, sf_dir, "labels")), ["doc_id"])
    return got.select("doc_id", _held_out(5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url: the longest fitting rule, else the classifier."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.train(url_filter.label_by_rules(pages)))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for the first 5 positives of every row whose vec_id is divisible by 100."""
    moved = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    vectors = _table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight-part codes of all vectors after six rounds, with errors by row and by label."""
    codes, books = vector_codes.compress(_table(spark, sf_dir, "embeddings"))
    codes = codes.alias("c")
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error")).alias("s")
    return codes.join(sums, F.col("c.label").eqNullSafe(F.col("s.label"))).select(
        "c.vec_id", F.lower(F.hex("c.code")).alias("code"), "c.error", "s.label_error",
        F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op13_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of near duplicates of every document under 4-word Jaccard 0.8."""
    return superminhash.near_duplicates(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    def ready(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        return run

    found = [op1_ann_mih, op2_language_bitmask, op3_mix_sainte_lague, op4_decontaminate_qgrams, op5_license_minhash,
             op6_quality_ftrl, op7_token_histogram, op8_jaccard_forest, op9_toxicity_pu, op10_url_rules,
             op11_hard_negatives, op12_vector_codes, op13_superminhash]
    return {f.__name__: ready(f) for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {}
