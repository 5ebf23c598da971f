"""Queries over the outcome log: summaries, roll-ups, slices, upsert, purge."""

from __future__ import annotations

from pyspark.sql import functions as F

from forumlens.operators import outcomes as O
from forumlens.plans.registry import register
from forumlens.sources import store
from forumlens.sources.scratch import scratch
from forumlens.sources.tables import outcomes

UPSERT_SPLIT_DAY = "2024-01-16"

OUTCOMES_CTE = """outcomes AS (
  SELECT '#3' AS step, strftime(ts, '%Y-%m-%d') AS step_label, event_id AS ord_key, user_id AS post_id,
         event_type AS result_class_name,
         CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS INTEGER) AS exit_code,
         CASE WHEN event_type = 'error' THEN 'task failed: ' || props ELSE '' END AS exit_msg,
         CASE WHEN value < 5.0 THEN 'test' ELSE 'prod' END AS modus, ts, value
  FROM events)"""

BATCH_CTE = """batches AS (
  SELECT step, step_label, CAST(ord_key % 10 AS INTEGER) AS batch_id,
         CAST(count_if(exit_code = 0) AS BIGINT) AS nr_success,
         CAST(count_if(exit_code <> 0) AS BIGINT) AS nr_failure
  FROM outcomes GROUP BY ALL),
gated AS (
  SELECT *, CAST(CASE WHEN nr_failure > 20 THEN 1 ELSE 0 END AS INTEGER) AS exit_code,
         CASE WHEN nr_failure > 20 THEN 'Error threshold for download of pages reached.' ELSE '' END AS msg
  FROM batches)"""

STEPS_CTE = """steps AS (
  SELECT step, step_label,
         CAST(count_if(exit_code = 0) AS BIGINT) AS nr_success,
         CAST(count_if(exit_code <> 0) AS BIGINT) AS nr_failure,
         array_to_string(list_sort(list_distinct(list(result_class_name))), ',') AS class_names
  FROM outcomes GROUP BY ALL),
step_rep AS (
  SELECT step, step_label, nr_success, nr_failure,
         CAST(CASE WHEN nr_failure > 0 THEN 1 ELSE 0 END AS INTEGER) AS exit_code,
         CASE WHEN nr_failure > 0 THEN printf('%d of %d tasks failed.', nr_failure, nr_failure + nr_success)
              ELSE '' END AS msg,
         class_names
  FROM steps)"""


@register("outcome_summary", sql=f"""
WITH {OUTCOMES_CTE}
SELECT result_class_name, CAST(count(*) AS BIGINT) AS n_total,
       CAST(count_if(exit_code = 0) AS BIGINT) AS n_success,
       CAST(count_if(exit_code <> 0) AS BIGINT) AS n_failure
FROM outcomes GROUP BY result_class_name""")
def outcome_summary(spark, sf_dir):
    """G1: total / successful / failed tasks per result class."""
    return O.worker_summary(outcomes(spark, sf_dir))


@register("batch_summary", sql=f"""
WITH {OUTCOMES_CTE}, {BATCH_CTE}
SELECT step, step_label, batch_id, nr_success, nr_failure, exit_code, msg FROM gated""")
def batch_summary(spark, sf_dir):
    """B1 + G5: per batch counts and the error gate (more than 20 failures)."""
    return O.batch_summary(outcomes(spark, sf_dir))


@register("step_summary", sql=f"""
WITH {OUTCOMES_CTE}, {STEPS_CTE}
SELECT * FROM step_rep""")
def step_summary(spark, sf_dir):
    """Step report with message and result class set."""
    return O.step_summary(outcomes(spark, sf_dir))


@register("download_rollup", sql=f"""
WITH {OUTCOMES_CTE}, {BATCH_CTE}
SELECT step, step_label, CAST(bit_or(exit_code) AS INTEGER) AS exit_code,
       coalesce(string_agg(';' || msg, '' ORDER BY batch_id) FILTER (WHERE msg <> ''), '') AS msg,
       CAST(sum(nr_success) AS BIGINT) AS nr_success, CAST(sum(nr_failure) AS BIGINT) AS nr_failure
FROM gated GROUP BY step, step_label""")
def download_rollup(spark, sf_dir):
    """Batch reports rolled up per step."""
    return O.download_rollup(O.batch_summary(outcomes(spark, sf_dir)))


@register("run_rollup", sql=f"""
WITH {OUTCOMES_CTE}, {STEPS_CTE}
SELECT substr(step_label, 1, 7) AS run_id, CAST(bit_or(exit_code) AS INTEGER) AS exit_code,
       coalesce(string_agg(msg, ';' ORDER BY step_label) FILTER (WHERE msg <> ''), '') AS msg,
       CAST(count(*) AS BIGINT) AS n_steps
FROM step_rep GROUP BY 1""")
def run_rollup(spark, sf_dir):
    """Step reports rolled up per run (a run is one month of steps)."""
    steps = O.step_summary(outcomes(spark, sf_dir)).withColumn("run_id", F.substring("step_label", 1, 7))
    return O.run_rollup(steps)


@register("batch_slices", sql=f"""
WITH {OUTCOMES_CTE}
SELECT post_id, ord_key, CAST(ord_key % 10 AS INTEGER) AS batch_id FROM outcomes WHERE exit_code = 0""")
def batch_slices(spark, sf_dir):
    """B1: every successful row with its batch id (all batches)."""
    return O.batch_slice(outcomes(spark, sf_dir))


@register("upsert_latest", sql=f"""
WITH {OUTCOMES_CTE},
base AS (SELECT * FROM outcomes WHERE step_label < '{UPSERT_SPLIT_DAY}'
         QUALIFY row_number() OVER (PARTITION BY post_id, result_class_name ORDER BY ts DESC, ord_key DESC) = 1),
upd AS (SELECT * FROM outcomes WHERE step_label >= '{UPSERT_SPLIT_DAY}'
        QUALIFY row_number() OVER (PARTITION BY post_id, result_class_name ORDER BY ts DESC, ord_key DESC) = 1),
merged AS (SELECT * FROM base WHERE NOT EXISTS (
             SELECT 1 FROM upd WHERE upd.post_id = base.post_id AND upd.result_class_name = base.result_class_name)
           UNION ALL SELECT * FROM upd)
SELECT post_id, result_class_name, ord_key, step_label, exit_code FROM merged""")
def upsert_latest(spark, sf_dir):
    """A keyed store (user, class) from the first half of the month,
    upserted with the second half (last writer wins)."""
    o = outcomes(spark, sf_dir)
    keys, order = ["post_id", "result_class_name"], ["ts", "ord_key"]
    base = store.latest_per_key(o.filter(F.col("step_label") < UPSERT_SPLIT_DAY), keys, order)
    upd = o.filter(F.col("step_label") >= UPSERT_SPLIT_DAY)
    return store.upsert(base, upd, keys, order).select(
        "post_id", "result_class_name", "ord_key", "step_label", "exit_code")


@register("purge_mode", sql=f"""
WITH {OUTCOMES_CTE}
SELECT ord_key, modus, result_class_name FROM outcomes WHERE NOT (modus = 'test')""")
def purge_mode(spark, sf_dir):
    """Purge every 'test' row from the outcome dataset."""
    o = outcomes(spark, sf_dir)
    return store.purge(o, F.col("modus") == "test").select("ord_key", "modus", "result_class_name")


# ------------------------------------------------------------------ catalog

from forumlens.sources import catalog as C  # noqa: E402
from forumlens.sources.tables import catalog_artefacts, catalog_runs, catalog_steps  # noqa: E402


@register("latest_run", sql="""
SELECT o_orderkey AS flow_run_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS started_at, o_orderpriority AS topic
FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1""")
def latest_run(spark, sf_dir):
    """The most recently started run."""
    r = C.latest_run(catalog_runs(spark, sf_dir))
    return r.select("flow_run_id", F.date_format("started_at_timest", "yyyy-MM-dd HH:mm:ss").alias("started_at"),
                    "topic")


@register("run_lineage", sql="""
WITH g AS (SELECT l_orderkey, l_linenumber, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS exit_code,
                  sum(l_quantity) AS quantity, sum(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2),
st AS (SELECT l_orderkey AS run, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k, *
       FROM g),
st2 AS (SELECT run, k, '#' || k AS step, 'L' || run || '_' || k AS step_label,
               CAST(exit_code AS INTEGER) AS exit_code, quantity, price FROM st),
fin AS (SELECT run, list(step_label ORDER BY k) FILTER (WHERE k < mx) AS prev
        FROM (SELECT *, max(k) OVER (PARTITION BY run) AS mx FROM st2) GROUP BY run),
ex AS (SELECT DISTINCT run, CAST(unnest(range(len(prev))) AS INTEGER) AS pos, unnest(prev) AS lbl FROM fin
       WHERE prev IS NOT NULL)
SELECT ex.run, ex.pos, st2.step, st2.step_label, st2.exit_code,
       round(CAST(st2.quantity AS DOUBLE), 6) AS quantity, round(CAST(st2.price AS DOUBLE), 6) AS price
FROM ex JOIN st2 ON st2.step = '#' || (ex.pos + 1) AND st2.step_label = ex.lbl""")
def run_lineage(spark, sf_dir):
    """F5 + F6 + A13 + J2: for every run's final step, the earlier steps named
    in its lineage list, joined with their stored artefacts (JSON parsed)."""
    steps = scratch(catalog_steps(spark, sf_dir), "run-steps")  # read three times
    rows = steps.agg(F.greatest(F.count(F.lit(1)), F.sum(F.greatest(F.size("prev_step_lbls"), F.lit(0))))).first()[0]
    fin = steps.filter(F.col("prev_step_lbls").isNotNull())
    lin = C.lineage(fin.unionByName(steps.filter(F.col("prev_step_lbls").isNull())), run_col="flow_run_id",
                    rows=rows)
    art = C.lineage_artefacts(lin, catalog_artefacts(spark, sf_dir).filter(F.col("artefact_key") == "line_value"), rows)
    v = F.from_json("artefact_value", "quantity double, price double")
    return art.select("run", "pos", "step", "step_label", "exit_code",
                      F.round(v["quantity"], 6).alias("quantity"), F.round(v["price"], 6).alias("price"))
