"""Bucketed step tables (A5, F1) and quantile sketches."""

import numpy as np
from pyspark.sql import functions as F

from forumlens.operators import stats as S
from forumlens.sources import store


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _shuffles_over_scan(plan: str, table: str) -> bool:
    """Whether an Exchange lies above the scan of the table, by the indentation of the plan's tree."""
    path = []
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        path = [x for x in path if x[0] < depth] + [(depth, line)]
        if "Scan parquet" in line and table in line:
            return any("Exchange" in text for _, text in path)
    raise AssertionError(f"no scan of {table} in {plan}")


def test_fetch_does_not_shuffle_the_store(spark):
    records = spark.range(5000).select((F.col("id") % 700).alias("run"), F.concat(F.lit("#"), (F.col("id") % 7).cast("string")).alias("step"),
                                       F.col("id").alias("value"))
    keys = spark.createDataFrame([("#1", 1), ("#1", 1), ("#3", 3), ("#1", 9999), (None, 1)], "step string, run long")
    cols = ["step", "run"]
    name = store.write_bucketed(records, cols)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = store.fetch_by_keys(records, keys, cols)
        got = store.fetch_by_keys(spark.table(name), keys, cols)
        for a, b in zip(plain, got):
            assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
            assert not _shuffles_over_scan(_plan(b), name)
        assert _shuffles_over_scan(_plan(spark.table(name).repartition(3)), name)
        path = spark.table(name).inputFiles()[0].rsplit("/", 1)[0]
        unbucketed = spark.read.parquet(path)
        again = store.fetch_by_keys(unbucketed, keys, cols)[0]
        assert "Exchange" in _plan(again)
        per_key = spark.table(name).groupBy(*cols).count()
        assert "Exchange" not in _plan(per_key)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sketch_quantiles_keep_the_rank_error(spark):
    r = np.random.default_rng(1)
    v = np.concatenate([r.lognormal(0, 2, 60000), np.full(20000, 1.5)])  # a quarter of the rows is one value
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "x double").repartition(7)
    got = {q.p: q.value for q in S.sketch_quantiles(df, "x").collect()}
    assert list(got) == list(S.SUMMARY_PROBS)
    exact = S.exact_quantiles(df.where("not isnan(x)"), "x").first()
    for p, x in got.items():
        below, up_to = (v < x).mean(), (v <= x).mean()
        assert below - 2 * S.rank_error() <= p <= up_to + 2 * S.rank_error(), p
        near = np.quantile(v, [max(0, p - 2 * S.rank_error()), min(1, p + 2 * S.rank_error())])
        assert near[0] <= exact[S.prob_label(p)] <= near[1] and near[0] <= x <= near[1]
    none = S.sketch_quantiles(df.where("x is null"), "x").collect()
    assert len(none) == len(S.SUMMARY_PROBS) and all(q.value is None for q in none)
