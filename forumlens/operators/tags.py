"""Tag statistics and scores.

The main tag's row enters as scalar subqueries (a single value each), so no
join with the tag table is needed. Top tags per topic use a row_number filter,
which Spark plans with a partial window-group limit before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forumlens.functions.scalars import entropy, first_argmax

DEFAULT_LAMBDA = 0.3


def tag_stats(frame: DataFrame, k: int, tags_col: str = "tags") -> DataFrame:
    """Per tag: number of posts (a tag repeated in one post counts twice)
    and the sum of each ``w_topic_i``."""
    ex = frame.select(F.explode(tags_col).alias("tag"), *[f"w_topic_{i}" for i in range(k)])
    return ex.groupBy("tag").agg(F.count(F.lit(1)).alias("total_cnt"),
                                 *[F.sum(f"w_topic_{i}").alias(f"total_weight_topic_{i}") for i in range(k)])


def tag_scores(stats: DataFrame, main_tag: str, k: int, lam: float = DEFAULT_LAMBDA) -> DataFrame:
    """K3-K5 for every tag except the main one:
    n_i = (w_i / c_i) / sum_j (w_j / c_j) with c the main tag's weights;
    weight_entropy, max and first arg-max of n; score_i = lam n_i +
    (1 - lam) cnt / doc_cnt; total_count_rel = cnt / doc_cnt."""
    # The main tag's row is one row of k+1 numbers: fetch it once and use the
    # values as literals (the tag table is not joined or re-scanned per column).
    row = stats.filter(F.col("tag") == main_tag).select(
        "total_cnt", *[f"total_weight_topic_{i}" for i in range(k)]).first()
    c = [F.lit(row[f"total_weight_topic_{i}"] if row else None).cast("double") for i in range(k)]
    doc_cnt = F.lit(row["total_cnt"] if row else None).cast("double")
    rest = stats.filter(F.col("tag") != main_tag)
    ratios = [F.try_divide(F.col(f"total_weight_topic_{i}"), c[i]) for i in range(k)]
    norm = ratios[0]
    for r in ratios[1:]:
        norm = norm + r
    out = rest.select("*", *[F.try_divide(ratios[i], norm).alias(f"normed_weight_{i}") for i in range(k)])
    normed = F.array(*[F.col(f"normed_weight_{i}") for i in range(k)])
    rel = F.try_divide(F.col("total_cnt").cast("double"), doc_cnt)
    out = out.select("*", entropy(normed).alias("weight_entropy"),
                     F.array_max(normed).alias("max_normed_topic_weight"),
                     first_argmax(normed).alias("dominant_normed_topic"),
                     rel.alias("total_count_rel"))
    return out.select("*", *[(F.lit(lam) * F.col(f"normed_weight_{i}") + F.lit(1.0 - lam) * F.col("total_count_rel"))
                             .alias(f"score_{i}") for i in range(k)])


def top_tags_per_topic(scores: DataFrame, k: int, n: int = 10) -> DataFrame:
    """Per topic the n tags with the highest score (ties by tag)."""
    long = scores.select("tag", "total_cnt", F.posexplode(F.array(*[F.col(f"score_{i}") for i in range(k)]))
                         .alias("topic_id", "score"))
    w = Window.partitionBy("topic_id").orderBy(F.col("score").desc_nulls_last(), "tag")
    return (long.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
            .select(F.col("topic_id").cast("int").alias("topic_id"), "rank", "tag", "total_cnt", "score"))
