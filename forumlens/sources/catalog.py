"""Run catalog: artefacts, step lineage, latest run.

The catalog is three plain tables: runs (``job_overview``), steps
(``steps_overview``: one row per step and label, with the labels of the steps
it was built on in ``prev_step_lbls``) and artefacts (JSON text under
``(step, step_label, artefact_key)``). Every operation is a filter or a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlens.sources.scratch import tasks_for

ARTEFACT_COLS = ("step", "step_label", "artefact_key", "artefact_value")


def put_artefacts(df: DataFrame, path: str) -> None:
    """A13 put: append rows (step, step_label, artefact_key, value); a struct
    or map value is stored as JSON text."""
    v = F.col("artefact_value")
    if df.schema["artefact_value"].dataType.typeName() != "string":
        v = F.to_json(v)
    df.select("step", "step_label", "artefact_key", v.alias("artefact_value")).write.mode("append").parquet(path)


def artefacts_as_json(df: DataFrame, value_col: str = "value") -> DataFrame:
    """Rows with a struct ``value_col`` -> artefact rows with JSON text."""
    return df.withColumn("artefact_value", F.to_json(F.col(value_col))).drop(value_col)


def get_artefact(artefacts: DataFrame, step: str, step_label: str, key: str, schema) -> DataFrame:
    """A13 get: one artefact parsed with a declared schema."""
    return (artefacts.filter((F.col("step") == step) & (F.col("step_label") == step_label)
                             & (F.col("artefact_key") == key))
            .select("step", "step_label", "artefact_key", F.from_json("artefact_value", schema).alias("value")))


def artefacts_by_step(artefacts: DataFrame, step: str, step_label: str) -> DataFrame:
    """A13 list: every artefact of a step."""
    return artefacts.filter((F.col("step") == step) & (F.col("step_label") == step_label))


def latest_run(runs: DataFrame, ts_col: str = "started_at_timest", id_col: str = "flow_run_id") -> DataFrame:
    """The most recently started run (ties by id, descending)."""
    return runs.orderBy(F.col(ts_col).desc(), F.col(id_col).desc()).limit(1)


def by_step(df: DataFrame, rows: int | None) -> DataFrame:
    """Rows dealt by (step, step_label) to as many tasks as ``rows`` ask for; unchanged without a number."""
    return df if rows is None else df.repartition(tasks_for(df.sparkSession, rows), "step", "step_label")


def lineage(steps: DataFrame, final_step: str | None = None, run_col: str = "flow_run_id",
            rows: int | None = None) -> DataFrame:
    """F5 + J2: for each final step row, its ``prev_step_lbls[i]`` joined with
    the step ``#(i+1)`` of that label: (run, pos, step, step_label, ...). ``rows``, the number
    of steps or of lineage entries, sets the number of the join's tasks."""
    fin = steps if final_step is None else steps.filter(F.col("step") == final_step)
    ex = fin.select(F.col(run_col).alias("run"), F.posexplode("prev_step_lbls").alias("pos", "lbl"))
    ex = ex.select("run", "pos", F.concat(F.lit("#"), (F.col("pos") + 1).cast("string")).alias("step"),
                   F.col("lbl").alias("step_label"))
    ex = by_step(ex, rows).distinct()  # grouped where the rows are
    return ex.join(by_step(steps.drop("prev_step_lbls"), rows), ["step", "step_label"])


def lineage_artefacts(lin: DataFrame, artefacts: DataFrame, rows: int | None = None) -> DataFrame:
    """artefacts of every step in a lineage; ``rows`` as for :func:`lineage`."""
    return lin.join(by_step(artefacts, rows), ["step", "step_label"])


def distinct_steps(steps: DataFrame) -> DataFrame:
    """Distinct (step, step_label) pairs."""
    return steps.select("step", "step_label").distinct()


def read_catalog(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """A3: full scans of the three catalog tables under ``base``."""
    return {name: spark.read.parquet(f"{base}/{name}") for name in ("runs", "steps", "artefacts")}
