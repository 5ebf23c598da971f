"""Mixing sources to target weights by Sainte-Lague apportionment (DataFrame operations only).

Sizes are counted in words. Targets are a water level: source ``s`` gets
``min(3 * size, weight * level)``, the level being the one at which all targets
sum to the wished total. The mix is dealt out in blocks of ``block_words`` words:

1. blocks go to sources by highest quotients ``votes / (2k + 1)`` of their targets;
2. each source's blocks go the same way to its racks of ``RACK`` shards, and a rack's to
   its shards (a source's documents are hashed into shards of about ``shard_words`` of its
   words). A quota is at most three rounds of the words; what is over goes word by word to
   the source's other racks and shards with room;
3. in each shard the documents form a ring in seeded order, cut into blocks from a
   seeded start; the quota takes the ring's words from there on, round after round, so
   no document is taken over 3 times.

No group is larger than a shard of one source, however large a source is. Only step 1
rounds: a source takes its blocks in whole, or all three rounds of its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forumlens.llm.common import WORD
from forumlens.sources.scratch import scratch

CAP = 3  # rounds of a source, and of a document
RACK = 1024  # shards, so that no apportionment ranks all shards at once


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, total: Column | None = None) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source.

    Weights 1, 2, 3, 1, ... by code point of the source, null last. The window runs
    over the table of sources, which has one row for each, not over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    w = (sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
         .withColumn("cap", F.col("source_size").cast("double") * CAP)
         .withColumn("ratio", F.col("cap") / F.col("weight"))
         .withColumn("total", F.sum("source_size").over(every).cast("double") if total is None else total))
    # With the sources before a row at their caps, this is the level of the others;
    # the first row whose own cap is not below it gives the answer. Levels fall from there
    # on, so it is the largest of those rows.
    w = w.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                     / F.sum("weight").over(after))
    w = w.withColumn("level", F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(every))
    return w.select("source", "source_size", F.least(
        "cap", F.col("weight") * F.coalesce("level", F.lit(float("inf")))).alias("target"))


def apportion(votes: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Adds ``quota``: Sainte-Lague seats of each row in its group, by ``vote`` and the
    group's ``seats``; equal quotients go to the first by ``order``.

    A row's seats differ from its exact share ``q`` by at most ``q n / (2 seats) + 1``
    (n rows in the group), so only quotients in that band are ranked, about 3 a row.
    """
    g = Window.partitionBy(*group)
    v = (votes.withColumn("_n", F.count(F.lit(1)).over(g)).withColumn("_sum", F.sum("vote").over(g))
         .withColumn("_q", F.when(F.col("_sum") > 0, F.col("vote") * F.col("seats") / F.col("_sum"))
                     .otherwise(F.lit(0.0)))
         .withColumn("_d", F.when(F.col("seats") > 0, F.col("_q") * F.col("_n") / (2 * F.col("seats")))
                     .otherwise(F.lit(0.0)) + 1)
         .withColumn("_low", F.greatest(F.lit(0), F.floor(F.col("_q") - F.col("_d"))).cast("long"))
         .withColumn("_high", F.when(F.col("_q") > 0, F.ceil(F.col("_q") + F.col("_d"))).otherwise(0).cast("long"))
         .withColumn("_left", F.col("seats") - F.sum("_low").over(g))
         .withColumn("_row", F.row_number().over(g.orderBy(*order))))
    quotients = v.withColumn("_k", F.explode_outer(F.when(
        F.col("_high") > F.col("_low"), F.sequence("_low", F.col("_high") - 1))))
    ranked = quotients.withColumn("_rank", F.row_number().over(
        g.orderBy((F.col("vote") / (2 * F.col("_k") + 1)).desc_nulls_last(), "_row")))
    won = F.sum((F.col("_k").isNotNull() & (F.col("_rank") <= F.col("_left"))).cast("long"))
    return (ranked.groupBy(*votes.columns, "_low").agg(won.alias("_won"))
            .withColumn("quota", F.col("_low") + F.col("_won")).drop("_low", "_won"))


def _by_source(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
    """Join on source (null equals null) and on ``more``."""
    a, b = left.alias("a"), right.alias("b")
    on = F.col("a.source").eqNullSafe(F.col("b.source"))
    for c in more:
        on &= F.col(f"a.{c}") == F.col(f"b.{c}")
    return a.join(b, on).select("a.*", *[f"b.{c}" for c in right.columns if c != "source" and c not in more])


def deal(rows: DataFrame, group: list[str], order: str, block_words: int) -> DataFrame:
    """Adds ``take``: the group's ``total`` words dealt to its rows, whole blocks by highest
    quotients of ``words``, at most ``CAP * words`` each. Words over that, and a part of a
    block, go to rows with room, first by ``order``. Takes add up to ``total`` if that is
    not over the group's ``CAP * words``."""
    every = Window.partitionBy(*group)
    before = every.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    dealt = apportion(rows.withColumn("vote", F.col("words").cast("double")).withColumn(
        "seats", F.expr(f"total div {block_words}")), group, [F.col(order)])
    dealt = dealt.withColumn("_most", F.col("words") * CAP).withColumn(
        "_first", F.least(F.col("quota") * block_words, "_most"))
    dealt = dealt.withColumn("_left", F.col("total") - F.sum("_first").over(every)
                             - F.coalesce(F.sum(F.col("_most") - F.col("_first")).over(before), F.lit(0)))
    return dealt.withColumn("take", F.col("_first") + F.greatest(F.lit(0), F.least(
        "_left", F.col("_most") - F.col("_first")))).drop("vote", "seats", "quota", "_most", "_first", "_left")


def mix(docs: DataFrame, block_words: int = 4, shard_words: int = 100_000, seed: int = 7) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken), one for each row of ``docs``.

    Null texts and empty texts have size 0 and are never taken; a null source is a
    source of its own; null ids are dealt like any id; repeated rows are taken
    separately, in no set order among equal ones (they yield the same set of rows);
    an empty table gives no rows. Columns other than doc_id, text, source are not used.
    """
    sized = scratch(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    # A shard holds about shard_words words, and no more rows than that, of one source.
    per_source = scratch(sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.greatest(F.lit(1), F.ceil(F.greatest(
            F.sum("size"), F.count(F.lit(1))) / shard_words)).cast("long").alias("shards")), "mix-sources")
    targets = source_targets(per_source.select("source", "source_size"))
    # One row a source, as in the windows of the targets.
    dealt = _by_source(sized, F.broadcast(per_source.select("source", "shards"))).withColumn(
        "shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("shards"))).drop("shards")

    blocks = targets.withColumn("vote", F.col("target")).withColumn(
        "seats", F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block_words).cast("long"))
    blocks = apportion(blocks.withColumn("_all", F.lit(0)), ["_all"], [F.col("source").asc_nulls_last()])
    blocks = blocks.select("source", "source_size", "target", F.least(
        F.col("quota") * block_words, F.col("source_size") * CAP).alias("total"))
    parts = dealt.groupBy("source", "shard").agg(F.sum("size").alias("words")).withColumn(
        "rack", F.expr(f"shard div {RACK}"))
    racks = parts.groupBy("source", "rack").agg(F.sum("words").alias("words"))
    racks = deal(_by_source(racks, blocks), ["source"], "rack", block_words).select(
        "source", "rack", "source_size", "target", F.col("take").alias("total"))
    quotas = deal(_by_source(parts, racks, "rack"), ["source", "rack"], "shard", block_words).select(
        "source", "shard", "words", "source_size", "target", "take",
        F.when(F.col("words") > 0, F.pmod(F.xxhash64("source", "shard", F.lit(seed + 1)), F.col("words")))
        .otherwise(F.lit(0)).cast("long").alias("start"))

    ring = Window.partitionBy("source", "shard").orderBy(
        F.xxhash64("doc_id", F.lit(seed + 2)), "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("hi", F.sum("size").over(ring)).withColumn("lo", F.col("hi") - F.col("size"))
    out = _by_source(placed, quotas, "shard")
    rest = F.when(F.col("words") > 0, F.col("take") % F.col("words")).otherwise(F.lit(0))
    rounds = F.when(F.col("words") > 0, F.floor(F.col("take") / F.col("words"))).otherwise(F.lit(0))

    def overlap(a: Column, b: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("hi"), b) - F.greatest(F.col("lo"), a))

    end = F.col("start") + rest  # the rest of the quota may run over the ring's end
    extra = overlap(F.col("start"), F.least(end, F.col("words"))) + overlap(F.lit(0), end - F.col("words"))
    return out.select("doc_id", "size", "source_size", "target",
                      (rounds * F.col("size") + extra).cast("long").alias("taken"))
