"""Time bins over the ask date and topic share per bin.

The bin of a date is arithmetic: with D whole days between the minimum and
maximum date and n bins, edge_i = min + floor(i*D/n) days and a date d days
after the minimum falls in bin ceil(n*d/D) (the minimum itself in bin 0).
No range join and no bin table are needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_BINS = 40


def with_time_bin(df: DataFrame, date_col: str = "asked_date", n_bins: int = DEFAULT_BINS) -> DataFrame:
    """Keep rows with a date (B12) and add ``bin`` and ``bin_label``."""
    d = df.filter(F.col(date_col).isNotNull()).withColumn("__d", F.to_date(date_col))
    st = d.agg(F.min("__d"), F.max("__d")).first()  # two dates to the driver
    mn, mx = F.lit(st[0]), F.lit(st[1])
    d = d.withColumn("__off", F.datediff(F.col("__d"), mn)).withColumn("__span", F.datediff(mx, mn))
    # integer ceil(n * off / span); the minimum (off = 0) is bin 0
    b = F.when(F.col("__off") <= 0, F.lit(0)).otherwise(
        F.expr(f"cast(({n_bins} * __off + __span - 1) div __span as int)"))

    def edge(i):
        return F.date_add(mn, F.expr(f"cast(({i} * __span) div {n_bins} as int)"))

    lbl = F.when(F.col("bin") == 0, F.concat(F.lit("[0] <="), F.date_format(mn, "yyyy-MM-dd"))).otherwise(
        F.concat(F.lit("["), F.col("bin").cast("string"), F.lit("] "),
                 F.date_format(edge("(bin - 1)"), "yyyy-MM-dd"), F.lit("-"),
                 F.date_format(edge("bin"), "yyyy-MM-dd")))
    d = d.withColumn("bin", b)
    return d.withColumn("bin_label", lbl).drop("__d", "__off", "__span")


def posts_per_bin(binned: DataFrame) -> DataFrame:
    """Number of posts per bin."""
    return binned.groupBy("bin", "bin_label").agg(F.count(F.lit(1)).alias("n_posts"))


def topic_share_per_bin(binned: DataFrame, k: int) -> DataFrame:
    """Summed topic weights per bin and their row-normalised shares
    (a bin whose weights sum to 0 gets null shares). Long form (bin, topic)."""
    g = binned.groupBy("bin", "bin_label").agg(*[F.sum(f"w_topic_{i}").alias(f"s{i}") for i in range(k)])
    tot = F.lit(0.0)
    for i in range(k):
        tot = tot + F.col(f"s{i}")
    g = g.withColumn("__tot", tot)
    long = g.select("bin", "bin_label", "__tot",
                    F.posexplode(F.array(*[F.col(f"s{i}") for i in range(k)])).alias("topic_id", "weight"))
    return long.select("bin", "bin_label", F.col("topic_id").cast("int").alias("topic_id"), "weight",
                       F.try_divide(F.col("weight"), F.col("__tot")).alias("share"))
