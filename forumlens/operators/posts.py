"""Post frame with topic columns.

Topic weights arrive in long form (post_id, topic_id, topic_weight); per post
there are at most k rows, so grouping by post is bounded per group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens.functions.scalars import entropy, first_argmax


def topic_cols(k: int) -> list[str]:
    return [f"w_topic_{i}" for i in range(k)]


def topic_long(vectors: DataFrame, id_col: str = "post_id", vec_col: str = "w") -> DataFrame:
    """E2 shape: one row per (post, topic) from an array column."""
    return vectors.select(id_col, F.posexplode(vec_col).alias("topic_id", "topic_weight")).select(
        id_col, F.col("topic_id").cast("int").alias("topic_id"), "topic_weight")


def topic_vector(long: DataFrame, k: int, id_col: str = "post_id") -> DataFrame:
    """(post, array of k weights), topics without a row are 0."""
    g = long.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("topic_id", "topic_weight"))).alias("m"))
    return g.select(id_col, F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                                        lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("w"))


def post_topic_frame(posts: DataFrame, long: DataFrame, k: int, id_col: str = "post_id") -> DataFrame:
    """F2 + K2 + H3: posts left-joined with ``w_topic_i`` columns (pivot over
    the known topic ids, so no extra pass to find them), numeric nulls -> 0
    (dates and strings stay null), topic entropy and dominant topic."""
    piv = long.groupBy(id_col).pivot("topic_id", list(range(k))).agg(F.first("topic_weight"))
    piv = piv.select(id_col, *[F.col(str(i)).alias(f"w_topic_{i}") for i in range(k)])
    frame = posts.join(piv, id_col, "left").fillna(0.0, subset=topic_cols(k))
    arr = F.array(*[F.col(c) for c in topic_cols(k)])
    return frame.withColumn("topic_entropy", entropy(arr)).withColumn("dominant_topic", first_argmax(arr))


def fill_numeric_nulls(df: DataFrame) -> DataFrame:
    """Zero for numeric columns only (the reference also zeroes dates)."""
    num = [f.name for f in df.schema.fields if f.dataType.typeName() in
           ("integer", "long", "double", "float", "short", "decimal")]
    return df.fillna(0, subset=num)


def weighted_metric(frame: DataFrame, metric: str, k: int) -> DataFrame:
    """K9: topic-weighted metric ``w_i * x`` per topic."""
    return frame.select("*", *[(F.col(f"w_topic_{i}") * F.col(metric).cast("double")).alias(f"{metric}_w{i}")
                               for i in range(k)])
