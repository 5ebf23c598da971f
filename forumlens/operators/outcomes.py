"""Outcome log roll-ups (G1-G5), batch slices (B1, B3, B4) and step guards
(F13, F14).

Every roll-up is an aggregation with partial (map-side) combine; string
concatenations only happen over bounded groups (batches of a step, steps of a
run), never over the task rows themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Default error gate and messages.
MAX_ERRORS_PER_BATCH = 20
MSG_THRESHOLD = "Error threshold for download of pages reached."
DEFAULT_DIVISOR = 10
ALL_SPLITS = (0, 1, 2)


def worker_summary(outcomes: DataFrame, by=("result_class_name",)) -> DataFrame:
    """G1: total, successful (exit_code 0) and failed rows."""
    return outcomes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(F.col("exit_code") == 0).alias("n_success"),
        F.count_if(F.col("exit_code") != 0).alias("n_failure"),
    )


def with_batch(outcomes: DataFrame, divisor: int = DEFAULT_DIVISOR) -> DataFrame:
    """B1 batch id: ``ord_key mod divisor`` (Spark partitions do the real work)."""
    return outcomes.withColumn("batch_id", F.pmod(F.col("ord_key"), F.lit(divisor)).cast("int"))


def batch_slice(outcomes: DataFrame, step: str | None = None, step_label: str | None = None,
                result_class_name: str | None = None, divisor: int = DEFAULT_DIVISOR,
                batch_id: int | None = None, successful_only: bool = True) -> DataFrame:
    """B1: successful rows of one step/label/class (optionally one batch),
    projected to post_id, ord_key, ml_tag (+ batch_id). B2 is the same slice
    on post metadata, which has no exit code (``successful_only=False``)."""
    df = with_batch(outcomes, divisor)
    if successful_only:
        df = df.filter(F.col("exit_code") == 0)
    for c, v in (("step", step), ("step_label", step_label), ("result_class_name", result_class_name)):
        if v is not None:
            df = df.filter(F.col(c) == v)
    if batch_id is not None:
        df = df.filter(F.col("batch_id") == batch_id)
    cols = [c for c in ("post_id", "ord_key", "ml_tag", "batch_id") if c in df.columns]
    return df.select(*cols)


def split_filter(df: DataFrame, ml_tags=None) -> DataFrame:
    """``ml_tag IN (...)``; None or empty means all splits. Null tags drop out."""
    tags = list(ml_tags) if ml_tags else list(ALL_SPLITS)
    return df.filter(F.col("ml_tag").isin(tags))


def successful_results(outcomes: DataFrame, class_names, training_only: bool = False) -> DataFrame:
    """Successful rows over several result classes, optionally ml_tag = 0."""
    df = outcomes.filter((F.col("exit_code") == 0) & F.col("result_class_name").isin(list(class_names)))
    if training_only:
        df = df.filter(F.col("ml_tag") == 0)
    return df


def batch_summary(outcomes: DataFrame, divisor: int = DEFAULT_DIVISOR,
                  max_errors: int = MAX_ERRORS_PER_BATCH) -> DataFrame:
    """Per (step, step_label, batch_id): counts and the G5 error gate."""
    g = with_batch(outcomes, divisor).groupBy("step", "step_label", "batch_id").agg(
        F.count_if(F.col("exit_code") == 0).alias("nr_success"),
        F.count_if(F.col("exit_code") != 0).alias("nr_failure"))
    gate = F.col("nr_failure") > F.lit(max_errors)
    return g.select("*", F.when(gate, 1).otherwise(0).alias("exit_code"),
                    F.when(gate, F.lit(MSG_THRESHOLD)).otherwise(F.lit("")).alias("msg"))


def step_summary(outcomes: DataFrame) -> DataFrame:
    """Per step: sums, exit code 1 when any task failed, message
    '{f} of {n} tasks failed.', sorted set of result class names."""
    # collect_set holds the distinct class names only (a handful) and merges
    # map-side, so a hot step does not gather its rows in one task.
    g = outcomes.groupBy("step", "step_label").agg(
        F.count_if(F.col("exit_code") == 0).alias("nr_success"),
        F.count_if(F.col("exit_code") != 0).alias("nr_failure"),
        F.array_join(F.sort_array(F.collect_set("result_class_name")), ",").alias("class_names"))
    failed = F.col("nr_failure") > 0
    return g.select(
        "step", "step_label", "nr_success", "nr_failure",
        F.when(failed, 1).otherwise(0).alias("exit_code"),
        F.when(failed, F.format_string("%d of %d tasks failed.", F.col("nr_failure"),
                                       F.col("nr_failure") + F.col("nr_success"))).otherwise(F.lit("")).alias("msg"),
        "class_names")


def download_rollup(batches: DataFrame) -> DataFrame:
    """Roll batch reports of a step up: bit-OR of exit codes, non-empty
    messages each prefixed by ';' in batch order, summed counts."""
    entry = F.when(F.length(F.coalesce(F.col("msg"), F.lit(""))) > 0, F.struct("batch_id", "msg"))
    g = batches.groupBy("step", "step_label").agg(
        F.bit_or("exit_code").alias("exit_code"),
        F.sort_array(F.collect_list(entry)).alias("m"),
        F.sum("nr_success").alias("nr_success"), F.sum("nr_failure").alias("nr_failure"))
    msg = F.aggregate(F.col("m"), F.lit(""), lambda acc, x: F.concat(acc, F.lit(";"), x["msg"]))
    return g.select("step", "step_label", "exit_code", msg.alias("msg"), "nr_success", "nr_failure")


def run_rollup(steps: DataFrame, run_col: str = "run_id", order_col: str = "step_label") -> DataFrame:
    """Per run: bit-OR of step exit codes, non-empty messages joined by ';'
    in step order."""
    entry = F.when(F.length(F.coalesce(F.col("msg"), F.lit(""))) > 0, F.struct(F.col(order_col).alias("o"), "msg"))
    g = steps.groupBy(run_col).agg(F.bit_or("exit_code").alias("exit_code"),
                                   F.sort_array(F.collect_list(entry)).alias("m"),
                                   F.count(F.lit(1)).alias("n_steps"))
    return g.select(run_col, "exit_code", F.array_join(F.transform("m", lambda x: x["msg"]), ";").alias("msg"),
                    "n_steps")


def conflicting_steps(requested: DataFrame, steps: DataFrame) -> DataFrame:
    """requested (step, step_label) pairs that already exist."""
    return requested.select("step", "step_label").join(steps.select("step", "step_label").distinct(),
                                                       ["step", "step_label"], "left_semi")


def reusable_steps(requested: DataFrame, steps: DataFrame) -> DataFrame:
    """requested steps with their stored outcome; ``reusable`` is true only
    when the step exists and ended with exit code 0."""
    s = steps.select("step", "step_label", F.col("exit_code").alias("stored_exit_code"))
    return (requested.select("step", "step_label").join(s, ["step", "step_label"], "left")
            .withColumn("reusable", F.coalesce(F.col("stored_exit_code") == 0, F.lit(False))))
