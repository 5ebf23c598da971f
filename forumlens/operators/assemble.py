"""Documents of any length from their pieces (B7): question, comments, answers, comments of answers.

A document may have very many pieces, so it is never one row or one group. Pieces are
range-sorted over all partitions; running sums inside a partition and the sums of a
document's earlier partitions give each piece its place in the whole text. From the places
the text is cut into pages of a fixed length, and a page is all that is ever joined together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forumlens.sources.scratch import scratch

QUESTION, QUESTION_COMMENT, ANSWER, ANSWER_COMMENT = range(4)


def with_offsets(pieces: DataFrame, group: str, order_cols: list[str], size: str) -> DataFrame:
    """``pieces`` with ``offset``: the sizes of the group's earlier pieces, summed.

    A group may lie in many partitions. Windows reach over one partition's rows of a group,
    and over one row a partition of it. Rows with equal group and order lie together.
    """
    spread = pieces.repartitionByRange(group, *order_cols).withColumn("_part", F.spark_partition_id())
    spread = scratch(spread, "offsets")
    inside = Window.partitionBy("_part", group).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = spread.groupBy(group, "_part").agg(F.sum(size).alias("_n")).select(
        group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = spread.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return placed.join(starts, [group, "_part"]).withColumn("offset", F.col("_start") + F.col("_inside")).drop(
        "_part", "_start", "_inside")


def conversation_pieces(turns: DataFrame) -> DataFrame:
    """(conv_id, part, turn, text, offset, size) of (conv_id, turn, role, text): the pieces of each
    conversation's text in order, with their places when joined by a space.

    The first turn is the question, assistant turns are answers, others are comments: on the
    question before the first answer, on answers after it. Order: question, its comments,
    answers, comments on answers, each by turn. Null texts and ids are left out, empty texts stay.
    """
    c = turns.where("conv_id is not null and turn is not null").select("conv_id", "turn", "role", "text")
    answer = F.coalesce(F.col("role") == "assistant", F.lit(False))
    first = c.groupBy("conv_id").agg(F.min("turn").alias("asked"), F.min(F.when(answer, F.col("turn"))).alias("answered"))
    part = (F.when(answer, ANSWER).when(F.col("turn") == F.col("asked"), QUESTION)
            .when(F.coalesce(F.col("turn") < F.col("answered"), F.lit(True)), QUESTION_COMMENT).otherwise(ANSWER_COMMENT))
    pieces = c.join(first, "conv_id").where("text is not null").select(
        "conv_id", part.alias("part"), "turn", "text", F.xxhash64("role", "text").alias("_tie"),
        F.length("text").cast("long").alias("size"), (F.length("text") + 1).cast("long").alias("_step"))
    placed = with_offsets(pieces, "conv_id", ["part", "turn", "_tie"], "_step")
    return placed.select("conv_id", "part", "turn", "text", "offset", "size")


def pages(pieces: DataFrame, group: str, chars: int) -> DataFrame:
    """(group, page, text): the pieces joined by spaces, cut every ``chars`` characters.

    ``pieces``: (group, offset, size, text) as from ``conversation_pieces``. A page gathers at
    most ``chars`` characters; the pages of a document in order are its whole text. A document
    of nothing but one empty piece has one empty page.
    """
    total = pieces.groupBy(group).agg(F.max(F.col("offset") + F.col("size")).alias("_total"))
    p = pieces.select(group, "offset", "size", "text").join(total, group)
    end = F.least(F.col("offset") + F.col("size") + 1, F.greatest("_total", F.lit(1).cast("long")))
    p = p.withColumn("_end", end).where(F.col("_end") > F.col("offset"))
    first, last = F.floor(F.col("offset") / chars), F.floor((F.col("_end") - 1) / chars)
    cut = p.withColumn("page", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("page") * chars, F.col("offset"))
    stop = F.least((F.col("page") + 1) * chars, "_end", "_total")
    spaced = F.concat("text", F.lit(" "))
    sub = F.substr(spaced, (start - F.col("offset") + 1).cast("int"), F.greatest(stop - start, F.lit(0).cast("long")).cast("int"))
    cut = cut.select(group, "page", F.struct(start.alias("at"), sub.alias("s")).alias("e"))
    joined = cut.groupBy(group, "page").agg(F.array_sort(F.collect_list("e")).alias("e"))
    return joined.select(group, F.col("page").cast("long").alias("page"),
                         F.array_join(F.transform("e", lambda x: x["s"]), "").alias("text"))
