"""Connected components by alternating large-star and small-star steps.

Each step joins every node's edges with the node's smallest neighbour, so that the
number of rounds grows with the logarithm of the nodes, not with the diameter. A hot
node's rows are only aggregated and joined (both of which Spark can split), never
gathered. Edges are written after each round, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens.sources.scratch import scratch


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    joined = e.join(least, "u")
    return (joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))))


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); a component's name is its
    smallest node. Loops, repeated edges and null ends are allowed and add nothing, but a
    node with only a loop is its own component. Raises if ``most_rounds`` rounds are not enough.
    """
    clean = edges.where("u is not null and v is not null")
    loops = clean.where("u = v").select(F.col("u").alias("node")).distinct()
    e = scratch(clean.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                "components-0")

    def mark(x: DataFrame):
        return x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()

    before = mark(e)
    for i in range(1, most_rounds + 1):
        e = scratch(_small_star(_large_star(e).distinct()).distinct(), f"components-{i}")
        now = mark(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    found = stars.unionByName(roots)
    alone = loops.join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(alone)
