"""Hard negatives, with Four-Russians scoring of integer vectors.

Components become integers. A candidate is kept as bit planes: bit ``b`` of eight
neighbouring components is one byte. For an anchor, the sums of all 256 subsets of eight
components are tabled once; the byte of a plane looks up that plane's part of the inner
product, and the parts are shifted by the plane and added (the sign plane is subtracted),
which gives the full exact score of a pair without a multiplication.

Anchors (a stated query set) and candidates are cut into blocks by a hash, and each pair
of blocks is one bounded group: first the blocks of the anchor's label, for its positives,
then all blocks, for the negatives in the window of each positive's score. Each group
returns a bounded number of rows for an anchor, which are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forumlens.llm.lsh_forest import whole_groups
from forumlens.sources.scratch import scratch

ROWS, ANCHORS = 4096, 4096   # of a block
TILE = 128                   # anchors scored at once
LARGEST = 1 << 49            # of a score, so that score and place fit one 64-bit key


def pack_planes(x: np.ndarray, planes: int) -> np.ndarray:
    """(rows, planes * groups) bytes of integers (rows, dims): plane by plane, two's complement."""
    rows, dims = x.shape
    wide = np.zeros((rows, max(1, -(-dims // 8)) * 8), np.int64)
    wide[:, :dims] = x
    bits = (wide[:, None, :] >> np.arange(planes)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").reshape(rows, -1)


def unpack_planes(packed: np.ndarray, planes: int) -> np.ndarray:
    """The integers of ``pack_planes`` (dims filled up to whole groups of eight)."""
    bits = np.unpackbits(packed.reshape(len(packed), planes, -1), axis=2, bitorder="little").astype(np.int64)
    power = 1 << np.arange(planes)
    power[-1] = -power[-1]
    return np.einsum("rpd,p->rd", bits, power)


def subset_tables(anchors: np.ndarray, kind: type) -> np.ndarray:
    """(groups, 256, anchors) sums of all subsets of each eight components."""
    groups = anchors.shape[1] // 8
    out = np.zeros((groups, 256, len(anchors)), kind)
    for g in range(groups):
        for i in range(8):
            out[g, 1 << i:2 << i] = out[g, :1 << i] + anchors[:, 8 * g + i]
    return out


def scores(anchors: np.ndarray, packed: np.ndarray, planes: int) -> np.ndarray:
    """(candidates, anchors) inner products by table lookups, shifts and additions."""
    groups = anchors.shape[1] // 8
    reach = int(np.abs(anchors).max(initial=0)) * 8 * groups << planes
    kind = np.int32 if reach < 1 << 31 else np.int64
    tables = subset_tables(anchors, kind)
    at = packed.reshape(len(packed), planes, groups)
    total = np.zeros((len(packed), len(anchors)), kind)
    part, found = np.empty_like(total), np.empty_like(total)
    for b in range(planes if groups else 0):
        np.take(tables[0], at[:, b, 0], axis=0, out=part, mode="clip")
        for g in range(1, groups):
            np.take(tables[g], at[:, b, g], axis=0, out=found, mode="clip")
            part += found
        part <<= b
        if b == planes - 1:
            total -= part
        else:
            total += part
    return total


def best(score: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(candidate, anchor) of the ``k`` highest fitting scores in each column; ties to earlier rows."""
    n = len(score)
    key = np.where(fits, score.astype(np.int64) * n + np.arange(n)[::-1, None], np.iinfo(np.int64).min)
    if n > k:
        rows = np.argpartition(key, n - k, axis=0)[n - k:]
    else:
        rows = np.broadcast_to(np.arange(n)[:, None], score.shape)
    cols = np.broadcast_to(np.arange(score.shape[1]), rows.shape)
    ok = fits[rows, cols]
    return rows[ok], cols[ok]


def _cells(batches: Iterator[pa.RecordBatch], keys: list[str], planes: int):
    """For each group with both sides: its candidates (by id), and tiles of anchors with their scores."""
    for t in whole_groups(batches, keys):
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in keys:
            c = t.column(k).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        for cell in np.split(np.arange(t.num_rows), np.flatnonzero(new)[1:]):
            part = t.slice(cell[0], len(cell)).combine_chunks()
            asks = part.column("asks").to_numpy()
            if asks.all() or not asks.any():
                continue
            packed = np.frombuffer(b"".join(part.column("packed").to_pylist()), np.uint8).reshape(len(cell), -1)
            ids, labels = part.column("vec_id").to_numpy(), part.column("label").to_numpy()
            right = np.flatnonzero(~asks)
            right = right[np.argsort(ids[right], kind="stable")]
            for i in range(0, int(asks.sum()), TILE):
                left = np.flatnonzero(asks)[i:i + TILE]
                got = scores(unpack_planes(packed[left], planes), packed[right], planes)
                yield part, ids, labels, left, right, got


def _positives(keys: list[str], planes: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, _, left, right, got in _cells(batches, keys, planes):
            row, col = best(got, ids[right][:, None] != ids[left][None, :], k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[left][col]), pa.array(ids[right][row]), pa.array(got[row, col].astype(np.int64))],
                ["anchor_id", "positive_id", "positive_score"])
    return run


def _negatives(keys: list[str], planes: int, k: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, labels, left, right, got in _cells(batches, keys, planes):
            other = labels[right][:, None] != labels[left][None, :]
            near = part.column("positives").take(pa.array(left)).to_pylist()
            out = []
            for p in range(max(len(x) for x in near)):
                has = np.flatnonzero([len(x) > p for x in near])
                pid = np.array([near[j][p]["positive_id"] for j in has], np.int64)
                ps = np.array([near[j][p]["positive_score"] for j in has], np.int64)
                # low ps <= 100 s <= high ps, as bounds of whole numbers
                least, most = -((-low * ps) // 100), (high * ps) // 100
                s = got[:, has]
                row, col = best(s, other[:, has] & (s >= least) & (s <= most), k)
                out.append((ids[left][has][col], pid[col], ids[right][row], ps[col], s[row, col].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], [
                "anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])
    return run


def _finite(v: Column) -> Column:
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _ranked(rows: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def _bit_planes(rows: DataFrame, planes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(2)
            wide = x.flatten().to_numpy().reshape(b.num_rows, len(x.flatten()) // max(1, b.num_rows))
            packed = pa.array([r.tobytes() for r in pack_planes(wide, planes)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed], ["vec_id", "label", "packed"])

    return rows.select("vec_id", "label", "x").mapInArrow(run, "vec_id long, label long, packed binary")


def mine(vectors: DataFrame, is_anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 10,
         low: int = 30, high: int = 90) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from
    (vec_id, label, embedding): for each anchor that ``is_anchor`` picks and each of its
    first ``positives`` other rows of the same label, the first ``negatives`` rows of
    another label whose score is ``low`` to ``high`` per cent of the positive's. Scores are
    inner products of floor(``scale`` x); higher ones come first, ties by smaller vec_id.

    Rows with a null id, label or vector, or with a null or non-finite component, take no
    part, nor do vectors of another length than most have (ties: the longer). Rows of the
    same id are one (the smallest label, then vector). A zero or empty vector scores 0. An
    anchor without a positive, and a positive without a fitting row, give no rows; so does
    an empty table. Raises if a score can pass 2^49.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"),
                       F.col("embedding").cast("array<double>").alias("e"))
    v = v.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _finite(F.col("e")))
    v = v.groupBy("vec_id").agg(F.min(F.struct("label", "e")).alias("v")).select("vec_id", "v.label", "v.e")
    v = v.select("vec_id", "label", F.transform("e", lambda x: F.floor(x * F.lit(float(scale)))).alias("x"),
                 F.expr(f"aggregate(e, 0D, (m, c) -> greatest(m, abs(c) * {float(scale)}D + 1))").alias("reach"))
    v = scratch(v, "negatives-rows")
    dim = v.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("reach")).orderBy(
        F.desc("n"), F.desc("d")).first()
    schema = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if dim is None:
        return spark.createDataFrame([], schema)
    if dim["d"] * dim["reach"] ** 2 >= LARGEST:
        raise ValueError(f"components up to {dim['reach']:.3g} in {dim['d']} dimensions: a score can pass 2^49")
    planes = int(dim["reach"]).bit_length() + 1
    rows = scratch(_bit_planes(v.where(F.size("x") == dim["d"]), planes), "negatives-planes")
    asked = rows.where(is_anchor)
    n_anchors = asked.count()

    def block(seed: int, count: Column) -> Column:
        return F.pmod(F.xxhash64("vec_id", F.lit(seed)), count)

    def each(count: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), count - 1))

    # Positives: an anchor meets the blocks of its label.
    sizes = rows.groupBy("label").agg(
        F.ceil(F.count(F.lit(1)) / ROWS).alias("blocks"),
        F.ceil(F.sum(F.when(is_anchor, 1).otherwise(0)) / ANCHORS).alias("a_blocks")).where("a_blocks > 0")
    sized = rows.join(sizes, "label")
    right = sized.select("label", each(F.col("a_blocks")).alias("ab"), block(62, F.col("blocks")).alias("cb"),
                         F.lit(False).alias("asks"), "vec_id", "packed")
    left = sized.where(is_anchor).select("label", block(63, F.col("a_blocks")).alias("ab"),
                                         each(F.col("blocks")).alias("cb"), F.lit(True).alias("asks"), "vec_id", "packed")
    three = ["label", "ab", "cb"]
    found = left.unionByName(right).repartition(*three).sortWithinPartitions(*three).mapInArrow(
        _positives(three, planes, positives), "anchor_id long, positive_id long, positive_score long")
    found = _ranked(found, ["anchor_id"], positives, F.desc("positive_score"), F.col("positive_id"))
    found = found.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    anchors = scratch(asked.join(found, asked["vec_id"] == found["anchor_id"]).select(
        "vec_id", "label", "packed", "positives"), "negatives-anchors")

    # Negatives: every block of anchors meets every block of candidates.
    blocks, a_blocks = ceil(rows.count() / ROWS), max(1, ceil(n_anchors / ANCHORS))
    as_long = lambda k: F.lit(k).cast("long")
    left = anchors.select(block(63, as_long(a_blocks)).alias("ab"), each(as_long(blocks)).alias("cb"),
                          F.lit(True).alias("asks"), "vec_id", "label", "packed", "positives")
    right = rows.select(each(as_long(a_blocks)).alias("ab"), block(62, as_long(blocks)).alias("cb"),
                        F.lit(False).alias("asks"), "vec_id", "label", "packed",
                        F.lit(None).cast(anchors.schema["positives"].dataType).alias("positives"))
    two = ["ab", "cb"]
    mined = left.unionByName(right).repartition(*two).sortWithinPartitions(*two).mapInArrow(
        _negatives(two, planes, negatives, low, high),
        "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    out = _ranked(mined, ["anchor_id", "positive_id"], negatives, F.desc("negative_score"), F.col("negative_id"))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
