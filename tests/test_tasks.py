"""The number of tasks of large joins follows the rows (lineage)."""

import re

from forumlens.sources import catalog as C
from forumlens.sources import scratch as S


def _tasks(df, column: str) -> set[int]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {int(n) for n in re.findall(rf"hashpartitioning\({column}#[^)]*, (\d+)\), REPARTITION_BY_NUM", plan)}


def test_lineage_is_dealt_by_the_number_of_its_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "TASK_ROWS", 1)
    steps = spark.createDataFrame(
        [(r, f"#{k}", f"L{r}_{k}", 0, [f"L{r}_{i}" for i in range(1, 3)] if k == 3 else None) for r in range(20) for k in (1, 2, 3)]
        + [(None, "#1", None, 1, None)], "flow_run_id long, step string, step_label string, exit_code int, prev_step_lbls array<string>")
    plain = C.lineage(steps)
    lin = C.lineage(steps, rows=61)
    assert sorted(map(tuple, lin.collect())) == sorted(map(tuple, plain.collect()))
    assert lin.count() == 40
    art = steps.select("step", "step_label", "exit_code")
    both = C.lineage_artefacts(lin.drop("exit_code"), art, 61)
    assert _tasks(both, "step") == {61} and both.count() == 40
