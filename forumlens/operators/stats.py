"""Distribution statistics.

* moments use Spark's partial aggregates (count/avg/stddev/skewness/kurtosis);
* exact percentiles avoid gathering all values in one task: rows are first counted by
  value (so a frequent value is one row), the values are range-partitioned and sorted,
  every value gets its range of global ranks from per-partition sums, and only the few
  values at the needed ranks are kept;
* where a sort of all values is too dear, quantiles may come from a mergeable sketch of
  fixed size with a stated error of rank (opt-in);
* histograms bucket arithmetically against scalar subqueries for min/max.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forumlens.sources.scratch import scratch

# The percentile set of the distribution summary.
SUMMARY_PROBS = (0.001, 0.01, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99, 0.999)


def prob_label(p: float) -> str:
    return "p" + format(p * 100, "g").replace(".", "_")


def with_global_rank(df: DataFrame, col: str) -> DataFrame:
    """(v, first, cnt): each different value with the 0-based rank of its first row in
    ascending order and its number of rows, fully distributed.

    The sorted values are checkpointed to the shared checkpoint folder so the two passes
    (per-partition sums, ranks) see the same partitioning and a lost executor recomputes
    from the checkpoint, not from the sort.
    """
    values = (df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull())
              .groupBy("v").agg(F.count(F.lit(1)).alias("cnt")))
    placed = scratch(values.orderBy("v").select("v", "cnt", F.spark_partition_id().alias("pid")), "ranked")
    w = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition: a bounded table, so the single-partition window
    # and the broadcast are safe.
    offsets = placed.groupBy("pid").agg(F.sum("cnt").alias("n")).select(
        "pid", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("pid").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.join(F.broadcast(offsets), "pid")
    return ranked.select("v", (F.col("offset") + F.coalesce(F.sum("cnt").over(inside), F.lit(0))).alias("first"), "cnt")


def _quantile_exprs(n, probs):
    """Aggregate expressions over ranked values (columns v, first, cnt)."""
    def at(rank):
        return F.max(F.when((F.col("first") <= rank) & (rank < F.col("first") + F.col("cnt")), F.col("v")))

    aggs = []
    for p in probs:
        h = F.lit(float(p)) * (n - 1)
        lo, frac = F.floor(h), h - F.floor(h)
        v_lo = at(lo)
        v_hi = F.coalesce(at(lo + 1), v_lo)
        aggs.append((v_lo + frac * (v_hi - v_lo)).alias(prob_label(p)))
    return aggs


def exact_quantiles(df: DataFrame, col: str, probs=SUMMARY_PROBS) -> DataFrame:
    """Linear-interpolated quantiles (the usual 'linear' definition):
    h = p (n-1); q = v[floor h] + (h - floor h) (v[floor h + 1] - v[floor h]).
    Returns one row with a column per probability."""
    ranked = with_global_rank(df, col)
    n = ranked.select(F.coalesce(F.sum("cnt"), F.lit(0))).first()[0]  # one number to the driver
    return ranked.agg(*_quantile_exprs(F.lit(n), probs))


SKETCH_K = 2000


def rank_error(k: int = SKETCH_K) -> float:
    """Error of a sketch quantile's rank as a share of the rows, held with probability 0.99."""
    return 2.296 / k ** 0.9723


def sketch_quantiles(df: DataFrame, col: str, probs=SUMMARY_PROBS, k: int = SKETCH_K) -> DataFrame:
    """G10 without a sort: (p, value), a row for each probability, from one KLL sketch of the
    not null values. Tasks send a sketch each, whatever their rows; ``value`` is a value of
    the column whose rank is within :func:`rank_error` of p; it may differ from run to run.
    Null without any value."""
    sketch = df.where(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double"))).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(col).cast("double"), F.lit(k)).alias("s"))
    asked = F.array(*[F.lit(float(p)) for p in probs])
    values = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("s", asked))
    return sketch.select(F.explode(F.arrays_zip(asked.alias("p"), F.coalesce(
        values, F.array_repeat(F.lit(None).cast("double"), len(probs))).alias("value"))).alias("q")).select("q.p", "q.value")


def describe(df: DataFrame, col: str, probs=SUMMARY_PROBS, digits: int | None = 6) -> DataFrame:
    """G10 + G11: one summary row: count, mean, sample std, min, max, exact
    percentiles, population skewness and excess kurtosis -- one aggregation over the rows;
    the percentiles (one row) come from the ranked values."""
    q = exact_quantiles(df, col, probs).first()
    v = F.col(col).cast("double")
    out = df.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                 F.min(v).alias("min"), F.max(v).alias("max"),
                 *[F.lit(q[prob_label(p)]).cast("double").alias(prob_label(p)) for p in probs],
                 F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"))
    if digits is None:
        return out
    return out.select(*[F.round(F.col(c), digits).alias(c) if c != "n" else F.col(c) for c in out.columns])


def histogram(df: DataFrame, col: str, bins: int = 100) -> DataFrame:
    """G12 + H4: equal-width bins between min and max (last bin closed; a
    constant column uses [v-0.5, v+0.5]); counts, cumulative counts, density.
    Empty bins are listed too (the bin table is ``spark.range(bins)``)."""
    spark = df.sparkSession
    c = F.col(col).cast("double")
    vals = df.select(c.alias("v")).filter(F.col("v").isNotNull())
    # one small aggregate to the driver: min, max and count
    st = vals.agg(F.min("v"), F.max("v"), F.count(F.lit(1))).first()
    mn, mx = F.lit(st[0]).cast("double"), F.lit(st[1]).cast("double")
    lo = F.when(mx > mn, mn).otherwise(mn - 0.5)
    hi = F.when(mx > mn, mx).otherwise(mx + 0.5)
    width = (hi - lo) / F.lit(float(bins))
    b = F.least(F.floor((F.col("v") - lo) / width).cast("int"), F.lit(bins - 1))
    counts = vals.select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("cnt"))
    n = F.lit(st[2])
    allb = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    h = allb.join(counts, "bin", "left").fillna(0, ["cnt"])
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return h.select(
        "bin",
        (lo + F.col("bin") * width).alias("lo"),
        (lo + (F.col("bin") + 1) * width).alias("hi"),
        "cnt",
        F.sum("cnt").over(w).alias("cum_cnt"),
        F.try_divide(F.col("cnt").cast("double"), n * width).alias("density"),
    )


def ecdf_at(df: DataFrame, col: str, x) -> DataFrame:
    """Share of values <= x (x a number or a scalar Column)."""
    xv = x if not isinstance(x, (int, float)) else F.lit(float(x))
    return df.agg(F.avg((F.col(col) <= xv).cast("double")).alias("ecdf"))


def ecdf_at_group_mean(df: DataFrame, col: str, group: str) -> DataFrame:
    """G13 per group: ECDF of ``col`` inside each group at the group's mean.
    Group means are aggregated first and joined back (no window over a hot
    group)."""
    means = df.groupBy(group).agg(F.avg(col).alias("x"))
    j = df.select(group, col).join(means, group)
    return j.groupBy(group).agg(F.first("x").alias("x"),
                                F.avg((F.col(col) <= F.col("x")).cast("double")).alias("ecdf"))
