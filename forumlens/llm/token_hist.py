"""Token counts: exact histogram of encoded lengths with suffix sums.

Whole texts are encoded with a public byte-level BPE vocabulary; documents are counted by
length, and from suffix sums over the lengths the table answers, for every context limit,
how many documents exceed it, which quantile it is, and the total after truncation to it.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from forumlens.llm.common import batch_column
from forumlens.sources.scratch import scratch

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pre-tokenisation pattern that belongs to this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BIN = 128


def read_vocabulary(spark: SparkSession, path: str) -> bytes:
    """The vocabulary file, read by Spark (any store)."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def lengths(docs: DataFrame, vocabulary: bytes, keep: list[str], text: str = "text") -> DataFrame:
    """``docs[keep]`` with ``n_tokens`` of the whole text (null and empty: 0). Text that looks
    like a special token is ordinary text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # one vocabulary file

    def make():
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        enc = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

        def fn(col: pa.Array) -> pa.Array:
            return pa.array([len(enc.encode_ordinary(t)) if t else 0 for t in (x.as_py() for x in col)], pa.int64())
        return fn

    return batch_column(docs, text, keep, "n_tokens", LongType(), make)


def histogram(counted: DataFrame) -> DataFrame:
    """One row for each length ``n_tokens``: docs, tokens (docs of that length and their
    tokens), docs_over and tokens_over (longer ones), share_within (documents no longer) and
    truncated_total (all tokens if texts are cut to that length).

    Suffix sums run in bins of lengths and then over the bins, so that no task gets all
    lengths. An empty table gives no rows.
    """
    # Written, as it is used twice below and texts are to be encoded once.
    h = scratch(counted.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs")), "token-lengths")
    h = h.withColumn("tokens", F.col("docs") * F.col("n_tokens")).withColumn("bin", F.expr(f"n_tokens div {BIN}"))
    over = Window.partitionBy("bin").orderBy("n_tokens").rowsBetween(1, Window.unboundedFollowing)
    later = Window.orderBy("bin").rowsBetween(1, Window.unboundedFollowing)
    every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bins = h.groupBy("bin").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    bins = bins.select("bin", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_later"),
                       F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_later"),
                       F.sum("d").over(every).alias("d_all"), F.sum("t").over(every).alias("t_all"))
    h = (h.withColumn("d_in", F.coalesce(F.sum("docs").over(over), F.lit(0)))
         .withColumn("t_in", F.coalesce(F.sum("tokens").over(over), F.lit(0))).join(bins, "bin"))
    docs_over, tokens_over = F.col("d_in") + F.col("d_later"), F.col("t_in") + F.col("t_later")
    return h.select("n_tokens", "docs", "tokens", docs_over.alias("docs_over"), tokens_over.alias("tokens_over"),
                    (1 - docs_over / F.col("d_all")).alias("share_within"),
                    (F.col("t_all") - tokens_over + docs_over * F.col("n_tokens")).alias("truncated_total"))


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """(n_tokens): the smallest length within which at least the share ``q`` of documents is."""
    return hist.where(F.col("share_within") >= q - 1e-12).agg(F.min("n_tokens").alias("n_tokens"))


def truncated_total(hist: DataFrame, limit: int) -> DataFrame:
    """(total): all tokens if texts are cut to ``limit``."""
    return hist.agg(F.coalesce(F.sum(F.col("docs") * F.least("n_tokens", F.lit(limit))), F.lit(0)).alias("total"))
