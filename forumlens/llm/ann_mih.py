"""Approximate nearest neighbours by multi-index hashing, for largest inner products.

Vectors get an extra component that makes all norms equal, so that the largest inner
product is the smallest angle. Codes are the signs under rotations learned (iterative
quantisation) on a bounded sample, split into 8-bit substrings with an index for each.
Two codes within Hamming radius ``r = m a + b`` (m substrings) agree within ``a`` bits in
one of the first ``b + 1`` substrings or within ``a - 1`` in another (pigeonhole), so
probing those buckets retrieves every code within ``r``; those are reranked with the
original vectors in double precision. ``r`` is set on the sample for the wished recall.

Equal vectors are one entry of the index, with its members beside it. Queries and
entries are cut into blocks, and each pair of blocks is one bounded group: the stated
query set meets all rows, and nothing is sent whole to one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forumlens.llm.common import hash_share
from forumlens.sources.scratch import scratch

BITS, SUB = 256, 8
SAMPLE = 6000        # vectors for learning, in expectation
RECALL = 0.985       # share of the sample's true neighbours within the radius
ROUNDS = 15
ROWS, QUERIES = 4096, 4096  # of a block

_POP = np.array([bin(i).count("1") for i in range(256)])
_AWAY = _POP[np.arange(256)[:, None] ^ np.arange(256)]  # between substring values


@dataclass
class Codes:
    rotation: np.ndarray  # (d + 1, BITS)
    norm: float           # the largest norm
    radius: int

    def of(self, x: np.ndarray, query: bool) -> np.ndarray:
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.norm ** 2 - (x * x).sum(1)))
        return np.packbits(np.column_stack([x, extra]) @ self.rotation > 0, axis=1)


def learn(x: np.ndarray, norm: float, k: int, recall: float = RECALL, seed: int = 5) -> Codes:
    """Rotations and radius from a sample (numpy, bounded)."""
    rng, d = np.random.default_rng(seed), x.shape[1] + 1
    v = np.column_stack([x, np.sqrt(np.maximum(0, norm ** 2 - (x * x).sum(1)))])
    parts = []
    for _ in range(ceil(BITS / d)):
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(ROUNDS):
            a, _, b = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (a @ b).T
        parts.append(r)
    codes = Codes(np.column_stack(parts)[:, :BITS], norm, BITS)
    q = x[:: max(1, len(x) // 300)]
    near = np.argpartition(-(q @ x.T), min(k, len(x) - 1), axis=1)[:, : k + 1]
    away = np.bitwise_count(codes.of(q, True)[:, None, :] ^ codes.of(x, False)[near]).sum(2)
    codes.radius = int(np.quantile(away, recall, method="higher"))
    return codes


# A block's index holds 256 bitmaps of its entries for each substring: the buckets that
# probing from a value reaches, joined, so that probing is an OR of one bitmap a substring.
def buckets(cx: np.ndarray, radius: int) -> np.ndarray:
    """(substrings, 256, bytes) bitmaps: by query value, the entries that pigeonhole probing reaches."""
    a, b = divmod(radius, cx.shape[1])
    reach = [a if t <= b else a - 1 for t in range(cx.shape[1])]
    return np.stack([np.packbits((_AWAY <= r)[:, cx[:, t]], axis=1) for t, r in enumerate(reach) if r >= 0])


def search_block(codes: Codes, q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query, entry, score) of the k best entries found for each query, and how many entries were
    probed in all; the radius grows for a query until it has k of them or all. Ties go to smaller
    ids. Distances are worked out for probed entries only, scores for those within the radius."""
    cx, cq = codes.of(x, False), codes.of(q, True)
    m, k = cx.shape[1], min(k, len(x))
    wx, wq = cx.view(np.uint64), cq.view(np.uint64)
    index = {codes.radius: buckets(cx, codes.radius)}
    out, probed = [], 0
    for i in range(len(q)):
        radius = codes.radius
        while True:
            if radius not in index:
                index[radius] = buckets(cx, radius)
            maps = index[radius]
            reached = np.bitwise_or.reduce(maps[np.arange(len(maps)), cq[i, :len(maps)]], axis=0)
            at = np.flatnonzero(np.unpackbits(reached, count=len(x)))
            probed += len(at)
            at = at[np.bitwise_count(wx[at] ^ wq[i]).sum(1, dtype=np.uint16) <= radius]
            if len(at) >= k or radius >= BITS:
                break
            radius = min(BITS, radius + m // 4)
        s = (x[at] * q[i]).sum(1)
        best = np.lexsort((ids[at], -s))[:k]
        out.append((np.full(len(best), i), at[best], s[best]))
    return *(np.concatenate(c) for c in zip(*out)), probed


def valid(v: Column) -> Column:
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                      & F.exists(v, lambda x: x != 0), F.lit(False))


def search(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row of (vec_id, embedding) that
    ``is_query`` picks, the ``k`` nearest found among all other rows.

    Null ids, and vectors that are null, empty, zero or hold null or non-finite components,
    take no part, nor do vectors of another length than most have (ties: the longer). Rows
    with the same id are one (the smallest vector); an empty table gives no rows.
    """
    spark = vectors.sparkSession
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    v = v.where(F.col("vec_id").isNotNull() & valid(F.col("embedding")))
    v = v.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    dim = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if dim is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    v = v.where(F.size("embedding") == dim["d"])
    entries = v.groupBy("embedding").agg(F.min("vec_id").alias("cid"),
                                         F.max(F.when(is_query, 1).otherwise(0)).alias("asked"))
    entries = scratch(entries, "ann-entries")
    members = v.join(entries, "embedding").select("cid", "vec_id", is_query.alias("asks"))
    members = scratch(members, "ann-members")
    n, asked, norm = entries.agg(F.count(F.lit(1)), F.sum("asked"), F.max(F.aggregate(
        "embedding", F.lit(0.0), lambda a, x: a + x * x))).first()
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    some = entries.where(hash_share(F.col("cid"), 51, SAMPLE / n)).select("embedding").toArrow()
    x = np.array(some.column(0).to_pylist() or [r[0] for r in entries.select("embedding").limit(1).collect()])
    codes = spark.sparkContext.broadcast(learn(x, float(np.sqrt(norm)), k))
    blocks, q_blocks = ceil(n / ROWS), ceil(asked / QUERIES)
    spread = F.xxhash64("cid", F.lit(52))
    left = entries.where("asked = 1").select(
        "cid", "embedding", F.pmod(spread, F.lit(q_blocks)).alias("qb"), F.lit(True).alias("query"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("rb"))
    right = entries.select(
        "cid", "embedding", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))).alias("qb"),
        F.lit(False).alias("query"), F.pmod(spread, F.lit(blocks)).alias("rb"))

    def one(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("cid", kind="stable")
        q, r = cell[cell["query"]], cell[~cell["query"]]
        if not len(q) or not len(r):
            return pd.DataFrame({"qid": [], "cid": [], "score": []})
        ids = r["cid"].to_numpy()
        qi, at, s, _ = search_block(codes.value, np.stack(q["embedding"]), np.stack(r["embedding"]), ids, k + 1)
        return pd.DataFrame({"qid": q["cid"].to_numpy()[qi], "cid": ids[at], "score": s})

    # k + 1 distinct vectors hold the k nearest rows besides the query's own, and of equal
    # vectors only the k + 1 smallest ids can be among them: both limits lose nothing.
    found = left.unionByName(right).groupBy("qb", "rb").applyInPandas(one, "qid long, cid long, score double")

    def first(rows: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
        return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(
            F.col("_n") <= n).drop("_n")

    found = first(found, "qid", k + 1, F.desc("score"), F.col("cid"))
    some_members = first(members.select("cid", "vec_id"), "cid", k + 1, F.col("vec_id"))
    found = first(found.join(some_members, "cid"), "qid", k + 1, F.desc("score"), F.col("vec_id"))
    asks = members.where("asks").select(F.col("cid").alias("qid"), F.col("vec_id").alias("query_id"))
    out = found.select("qid", "vec_id", "score").join(asks, "qid").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
