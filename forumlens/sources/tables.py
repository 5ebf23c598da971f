"""Scans of the landed tables and the stand-in views built on them.

The engine's own datasets (posts, outcome log, contributor roles, topic vectors)
are DataFrames with fixed columns. On the driver's test tables they are derived
as follows (mapping documented in the README):

* ``posts``     <- documents; ``post_stats`` (votes/views) <- events
* ``outcomes``  <- events (event_type 'error' is a failed task)
* ``roles``     <- orders (asker = o_custkey) and lineitem (answerer = l_suppkey)
* ``topic_vectors`` <- embeddings (all dims folded into k sums of absolute values, normalised)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlens.functions.scalars import split_tag
from forumlens.sources.scratch import tasks_for

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

DEFAULT_TOPICS = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A2/A3: plain Parquet scan; Catalyst prunes columns and pushes filters."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str, test_fraction: float = 0.15,
          val_fraction: float = 0.15, seed: int = 0) -> DataFrame:
    """Post records: post_id, ord_key, ml_tag, text, tags, lang. ``tags`` is
    ``[source, lang]``. A plain scan: no shuffle, pruned to the columns used.
    """
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("post_id"),
        F.col("doc_id").alias("ord_key"),
        split_tag("doc_id", test_fraction, val_fraction, seed).alias("ml_tag"),
        F.col("text"),
        F.array(F.col("source"), F.col("lang")).alias("tags"),
        F.col("lang"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-task outcome log (``post_results`` shape) from ``events``.

    step_label = the event day, result_class_name = event_type,
    exit_code 1 for 'error' rows, else 0; exit_msg names the failing row.
    modus is 'test' for low-value rows, else 'prod'.
    """
    ev = table(spark, sf_dir, "events")
    failed = F.col("event_type") == "error"
    return ev.select(
        F.lit("#3").alias("step"),
        F.date_format("ts", "yyyy-MM-dd").alias("step_label"),
        F.col("event_id").alias("ord_key"),
        F.col("user_id").alias("post_id"),
        F.col("event_type").alias("result_class_name"),
        F.when(failed, 1).otherwise(0).alias("exit_code"),
        F.when(failed, F.concat(F.lit("task failed: "), F.col("props"))).otherwise(F.lit("")).alias("exit_msg"),
        F.when(F.col("value") < 5.0, "test").otherwise("prod").alias("modus"),
        F.col("ts"),
        F.col("value"),
    )


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 role table (doc, user, role): one asker row per document and one
    answerer row per answer (duplicates kept; the graph operators dedupe where
    the reference does). Users of both kinds share one id space."""
    orders = table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem")
    askers = orders.select(F.col("o_orderkey").alias("doc"), F.col("o_custkey").alias("user"),
                           F.lit("asker").alias("role"))
    answers = li.select(F.col("l_orderkey").alias("doc"), F.col("l_suppkey").alias("user"),
                        F.lit("answerer").alias("role"))
    return askers.unionByName(answers)


def topic_vectors(spark: SparkSession, sf_dir: str, k: int = DEFAULT_TOPICS) -> DataFrame:
    """Per-document topic weights (post_id, w array<double> of length k): weight i is
    the sum of |embedding[j]| over all j with j mod k = i, normalised to sum 1."""
    emb = table(spark, sf_dir, "embeddings")
    # a weight visits its own elements only, in order
    raw = F.array(*[F.when(F.size("embedding") > i, F.aggregate(
        F.sequence(F.lit(i), F.size("embedding") - 1, F.lit(k)), F.lit(0.0),
        lambda acc, j: acc + F.abs(F.get("embedding", j)).cast("double"))).when(F.col("embedding").isNotNull(), 0.0)
        for i in range(k)])
    s = F.aggregate(raw, F.lit(0.0), lambda acc, v: acc + v)
    return emb.select(F.col("vec_id").alias("post_id"),
                      F.transform(raw, lambda v: F.try_divide(v, s)).alias("w"))


def post_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per post with events (post_id = user_id): question votes (clicks), views, votes of its
    answers (purchases less errors)."""
    def n(kind: str):
        return F.count(F.when(F.col("event_type") == kind, 1))
    return table(spark, sf_dir, "events").where("user_id is not null").groupBy(F.col("user_id").alias("post_id")).agg(
        n("click").alias("votes"), n("view").alias("views"), (n("purchase") - n("error")).alias("answer_vote"))


def catalog_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run overview stand-in: one run per order."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("flow_run_id"), F.col("o_orderdate").alias("started_at_timest"),
                    F.col("o_orderpriority").alias("topic"),
                    F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("exit_code"))


def _catalog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step per distinct (order, line number), numbered 1..n in line order."""
    from pyspark.sql import Window
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy("l_orderkey", "l_linenumber").agg(
        F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("exit_code"),
        F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("price"))
    g = g.repartition(tasks_for(spark, li.count()), "l_orderkey")
    # a run has a handful of steps: the window per run is bounded
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    g = g.withColumn("k", k)
    return g.select(F.col("l_orderkey").alias("flow_run_id"), "k",
                    F.concat(F.lit("#"), F.col("k").cast("string")).alias("step"),
                    F.concat(F.lit("L"), F.col("l_orderkey").cast("string"), F.lit("_"),
                             F.col("k").cast("string")).alias("step_label"),
                    "exit_code", "quantity", "price")


def catalog_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step overview stand-in: the lines of an order are the steps of its run;
    the last step lists the labels of the earlier ones (in step order)."""
    from pyspark.sql import Window
    s = _catalog_lines(spark, sf_dir)
    w = Window.partitionBy("flow_run_id").orderBy("k")
    prev = F.collect_list("step_label").over(w.rowsBetween(Window.unboundedPreceding, -1))
    last = F.max("k").over(Window.partitionBy("flow_run_id"))
    return (s.withColumn("prev", prev).withColumn("last", last)
            .select("flow_run_id", "step", "step_label", "exit_code",
                    F.when(F.col("k") == F.col("last"), F.col("prev")).alias("prev_step_lbls")))


def catalog_artefacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artefact stand-in: a JSON value per step."""
    s = _catalog_lines(spark, sf_dir)
    return s.select("step", "step_label", F.lit("line_value").alias("artefact_key"),
                    F.to_json(F.struct("quantity", "price")).alias("artefact_value"))
