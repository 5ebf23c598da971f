"""Topic assortativity of contributor graphs.

Vectors are stored as k plain double columns (``v0..v{k-1}``) so every cosine
is codegen'd arithmetic. Edges with a zero-norm end give a null cosine and are
left out of the mean (the reference would turn the whole mean into NaN).

* L14 on an edge table: two equi-joins (both ends) and an average.
* L14 on the document multigraph (never materialised): with unit vectors u_d
  and role counts r(u,d), the sum over document pairs of multiplicity x cosine
  is 1/2 sum_u (|sum_d r u_d|^2 - sum_d r^2), and the pair count is
  1/2 sum_u ((sum_d r)^2 - sum_d r^2) over documents with a non-zero vector.
* L15: ``n_iter`` random relabellings: a node takes the vector of the node at a
  position given by a keyed bijection of its own position, so an iteration needs no
  sort, rank or window. Nodes with a vector come first in the positions, so what takes
  a zero vector falls away by a comparison. While the vectors fit ``VECTOR_BYTES``
  (counted first) cells of a block of edges and a block of iterations sum the statistic
  in place and hand on a row for each iteration; the blocks are dealt and stored once and
  read for each block of iterations. Beyond it blocks of iterations are
  joined with the vectors. Then ECDF, VA index and verdict (K11) plus the
  distribution summary.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forumlens.functions.scalars import va_index, verdict
from forumlens.operators.stats import describe
from forumlens.sources.scratch import discard, scratch

DEFAULT_SEED = 11
VECTOR_BYTES = 1 << 26      # vectors of a graph that are broadcast, at most
SENT_NODES = 1 << 22        # nodes whose positions are broadcast to the edges, at most
BLOCK_ROWS = 1 << 23        # edges (or roles) of a cell, at most (about)
LEAST_ROWS = 1 << 18        # edges (or roles) of a cell below which more blocks are not worth their set-up
CHUNK = 1 << 13             # edges that a cell multiplies at a time
RUN = 32                    # rows of a node from which on they are copied in one piece
WALKED = 1 << 16            # numbers that go through the bijection at a time
MOST_SPANS = 32             # blocks of iterations, at most
DENSE_NODES = 1 << 26       # nodes of a graph of which a cell keeps a table of all, at most
JOINED_ITERATIONS = 100     # iterations of a block beyond VECTOR_BYTES


def vector_columns(df: DataFrame, arr_col: str, k: int, unit: bool = True) -> DataFrame:
    """Array column -> v0..v{k-1} (unit length when ``unit``; zero -> nulls)."""
    comps = [F.col(arr_col)[i].cast("double") for i in range(k)]
    if unit:
        norm = F.sqrt(sum((c * c for c in comps), F.lit(0.0)))
        comps = [F.when(norm > 0, c / norm) for c in comps]
    keep = [c for c in df.columns if c != arr_col]
    return df.select(*keep, *[c.alias(f"v{i}") for i, c in enumerate(comps)])


def _dot(prefix_a: str, prefix_b: str, k: int):
    return sum((F.col(f"{prefix_a}{i}") * F.col(f"{prefix_b}{i}") for i in range(k)), F.lit(0.0))


def _sent(vecs: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(vecs) if small else vecs


def edge_cosine_mean(edges: DataFrame, vecs: DataFrame, k: int, small: bool = False) -> DataFrame:
    """L14 on explicit edges (src, dst[, weight]) and unit vectors (node, v*; null = zero, left out);
    ``small``: the vectors may be broadcast."""
    vecs = vecs.filter(F.col("v0").isNotNull())
    w = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    e = edges.select("src", "dst", w.alias("w"))
    a = vecs.select(F.col("node").alias("src"), *[F.col(f"v{i}").alias(f"a{i}") for i in range(k)])
    b = vecs.select(F.col("node").alias("dst"), *[F.col(f"v{i}").alias(f"b{i}") for i in range(k)])
    j = e.join(_sent(a, small), "src").join(_sent(b, small), "dst").select("w", _dot("a", "b", k).alias("cos"))
    return j.agg((F.sum(F.col("w") * F.col("cos")) / F.sum(F.when(F.col("cos").isNotNull(), F.col("w"))))
                 .alias("mean_cosine"),
                 F.sum(F.when(F.col("cos").isNotNull(), F.col("w"))).cast("long").alias("n_edges"))


def doc_cosine_mean(r: DataFrame, doc_vecs: DataFrame, k: int, small: bool = False) -> DataFrame:
    """L14 on the document multigraph through the factorisation.
    r: (doc, user, r); doc_vecs: (doc, v*) unit vectors (null = zero); ``small``: they may be broadcast."""
    j = r.join(_sent(doc_vecs.filter(F.col("v0").isNotNull()), small), "doc")
    per_user = j.groupBy("user").agg(
        F.sum("r").alias("sr"), F.sum(F.col("r") * F.col("r")).alias("sr2"),
        *[F.sum(F.col("r") * F.col(f"v{i}")).alias(f"s{i}") for i in range(k)])
    sq = sum((F.col(f"s{i}") * F.col(f"s{i}") for i in range(k)), F.lit(0.0))
    g = per_user.agg((F.sum(sq - F.col("sr2")) / 2).alias("num"),
                     (F.sum(F.col("sr") * F.col("sr") - F.col("sr2")) / 2).alias("den"))
    return g.select(F.try_divide("num", "den").alias("mean_cosine"), F.col("den").cast("long").alias("n_edges"))


def with_dense_index(df: DataFrame, order_col, name: str = "idx") -> DataFrame:
    """0-based position by ``order_col`` (a column name or a list of them):
    range-partitioned sort plus per-partition offsets (no single-partition
    window over the data)."""
    cols = [order_col] if isinstance(order_col, str) else list(order_col)
    s = scratch(df.orderBy(*cols).withColumn("__pid", F.spark_partition_id()).withColumn(
        "__mid", F.monotonically_increasing_id()), "dense-index")
    counts = s.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"), F.min("__mid").alias("__mid0"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: bounded, so the window and the broadcast are safe
    offs = counts.select("__pid", "__mid0", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    return (s.join(F.broadcast(offs), "__pid")
            .withColumn(name, F.col("__off") + F.col("__mid") - F.col("__mid0"))
            .drop("__pid", "__mid", "__mid0", "__off"))


FEISTEL_ROUNDS = 6


def _scramble(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit mixing function of ``x`` and the key."""
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _round_key(seed: int, it: int, r: int) -> int:
    return (seed * 0x2545F4914F6CDD1D + it * 0xD1342543DE82EF95 + r * 0x9FB21C651E98DF25) & ((1 << 63) - 1)


def _mixers(half: int, it: int, seed: int, count: int) -> list:
    """The round functions of a network of two times ``half`` bits: tables of their values, unless
    there are more values than numbers to be mapped."""
    keys, mask = [_round_key(seed, it, r) for r in range(FEISTEL_ROUNDS)], np.uint64((1 << half) - 1)

    def mixed(x: np.ndarray, key: int) -> np.ndarray:
        return (_scramble(x.astype(np.uint64), key) & mask).astype(np.int64)

    if 1 << half > count:
        return [lambda x, key=key: mixed(x, key) for key in keys]
    return [mixed(np.arange(1 << half), key).take for key in keys]


def _walk(start: np.ndarray, n: int, step) -> np.ndarray:
    """``step`` on each number, and again while the result is not below ``n``; some at a time, for the cache."""
    out = np.empty(len(start), np.int64)
    for lo in range(0, len(start), WALKED):
        done = step(start[lo:lo + WALKED].astype(np.int64))
        todo = np.flatnonzero(done >= n)
        x = done.take(todo)
        while len(todo):
            x = step(x)
            done[todo] = x
            over = x >= n
            todo, x = todo[over], x[over]
        out[lo:lo + WALKED] = done
    return out


def _half(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def keyed_bijection(idx: np.ndarray, n: int, it: int, seed: int) -> np.ndarray:
    """A permutation of 0..n-1 chosen by (seed, it), at the places ``idx``: a Feistel
    network on the next even number of bits, walked on until the value is below n."""
    half = _half(n)
    mixers = _mixers(half, it, seed, len(idx))

    def step(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & ((1 << half) - 1)
        for mix in mixers:
            left ^= mix(right)
            left, right = right, left
        left <<= half
        left |= right
        return left

    return _walk(idx, n, step)


def keyed_inverse(pos: np.ndarray, n: int, it: int, seed: int) -> np.ndarray:
    """The places that ``keyed_bijection`` sends to ``pos``: its rounds in reverse."""
    half = _half(n)
    mixers = _mixers(half, it, seed, len(pos))[::-1]

    def step(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & ((1 << half) - 1)
        for mix in mixers:
            right ^= mix(left)
            left, right = right, left
        left <<= half
        left |= right
        return left

    return _walk(pos, n, step)


def permutations(positions: DataFrame, n: int, n_iter: int, seed: int = DEFAULT_SEED, below: int | None = None,
                 first: int = 0) -> DataFrame:
    """H5: (it, node, src_idx) from (node, idx): in iteration ``it`` a node takes the
    vector of the node with index ``src_idx``; a bijection of 0..n-1 for each iteration.
    With ``below`` only rows with a smaller ``src_idx``; ``first`` is the first iteration's number."""
    most = n if below is None else below

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idx = batch.column("idx").to_numpy()
            for it in range(first, first + n_iter):
                src = keyed_bijection(idx, n, it, seed)
                at = np.flatnonzero(src < most)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), it, np.int32)), batch.column("node").take(pa.array(at)), pa.array(src[at])],
                    ["it", "node", "src_idx"])

    return positions.select("node", "idx").mapInArrow(run, f"it int, node {positions.schema['node'].dataType.simpleString()}, src_idx long")


def permutation_stats(edges: DataFrame | None, vecs: DataFrame, k: int, n_iter: int = 100,
                      seed: int = DEFAULT_SEED, doc_roles: DataFrame | None = None,
                      vector_bytes: int = VECTOR_BYTES, block_rows: int | None = None) -> DataFrame:
    """(it, stat): the mean edge cosine after relabelling the node
    vectors with permutation ``it``. ``vecs``: (node, v*) unit vectors; either
    ``edges`` (src, dst[, weight]) or ``doc_roles`` (doc, user, r) for the
    factorised document graph.

    An iteration in which no edge joins two vectors has a null ``stat``. Vectors of up to
    ``vector_bytes`` are broadcast and the sums made in blocks of ``block_rows`` edges (``BLOCK_ROWS``
    unless given); more are joined."""
    # nodes with a vector first: what takes a position from ``filled`` on has a null cosine
    idx = scratch(with_dense_index(vecs.withColumn("none", F.col("v0").isNull()), ["none", "node"], "idx"), "perm-index")
    n, filled = idx.agg(F.count(F.lit(1)), F.count("v0")).first()
    if filled * k * 8 > vector_bytes:
        return _stats_by_joins(edges, idx, n, filled, k, n_iter, seed, doc_roles)
    if block_rows is None:
        block_rows = BLOCK_ROWS
    kind = "int" if n < 1 << 31 else "long"
    where = idx.select("node", F.col("idx").cast(kind).alias("idx"))
    table = idx.where("not none").orderBy("idx").select(*[f"v{i}" for i in range(k)]).toArrow()
    vectors = idx.sparkSession.sparkContext.broadcast(
        np.column_stack([table[f"v{i}"].to_numpy() for i in range(k)]).reshape(filled, k))
    if doc_roles is None:
        w = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
        where = _sent(where, n <= SENT_NODES)
        rows = scratch(edges.groupBy("src", "dst").agg(F.sum(w).alias("w"))
                       .join(where.toDF("src", "a"), "src").join(where.toDF("dst", "b"), "dst").select("a", "b", "w"), "perm-rows")
        # dealt by the end of fewer nodes, whose runs of edges are then long
        count, *ends = rows.agg(F.count(F.lit(1)), F.approx_count_distinct("a"), F.approx_count_distinct("b")).first()
        by = "a" if ends[0] <= ends[1] else "b"
        other = "b" if by == "a" else "a"
        rows = _with_split(rows.toDF(*["a" if c == by else "b" if c == other else c for c in rows.columns]), "a", count, block_rows)
        key = F.when(F.col("split"), F.xxhash64("a", "b")).otherwise(F.xxhash64("a"))
        parts = _cells(rows, key, count, n_iter, block_rows, _edge_cell(vectors, n, filled, seed),
                       "it int, num double, den double")
    else:
        rows = scratch(doc_roles.join(where.toDF("doc", "a"), "doc").select("a", "user", F.col("r").cast("double").alias("r")),
                       "perm-rows")
        count = rows.count()
        # a user of more rows than a block holds is split over the blocks
        rows = _with_split(rows, "user", count, block_rows)
        key = F.when(F.col("split"), F.xxhash64("user", "a")).otherwise(F.xxhash64("user"))
        user = doc_roles.schema["user"].dataType.simpleString()
        parts = _cells(rows, key, count, n_iter, block_rows, _role_cell(vectors, n, filled, seed),
                       f"it int, split boolean, user {user}, num double, den double, sums array<double>")
        halves = parts.where("split").groupBy("it", "user").agg(
            F.sum("num").alias("sr2"), F.sum("den").alias("sr"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(k)])
        sq = sum((F.col(f"s{i}") * F.col(f"s{i}") for i in range(k)), F.lit(0.0))
        parts = parts.where("not split").select("it", "num", "den").unionByName(
            halves.select("it", (sq - F.col("sr2")).alias("num"), (F.col("sr") * F.col("sr") - F.col("sr2")).alias("den")))
    return _every(idx, n_iter, parts.groupBy("it").agg(F.try_divide(F.sum("num"), F.sum("den")).alias("stat")))


def _with_split(rows: DataFrame, col: str, count: int, block_rows: int) -> DataFrame:
    """``rows`` with ``split``: whether ``col`` has more rows of its value than a block holds."""
    if count <= block_rows:
        return rows.withColumn("split", F.lit(False))
    big = rows.groupBy(F.col(col).alias("__big")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > block_rows)
    return (rows.join(F.broadcast(big), F.col(col).eqNullSafe(F.col("__big")), "left")  # fewer rows than there are blocks
            .withColumn("split", F.col("__n").isNotNull()).drop("__big", "__n"))


def _every(idx: DataFrame, n_iter: int, stats: DataFrame) -> DataFrame:
    """A row for each iteration, also where no edge joins two vectors."""
    return idx.sparkSession.range(n_iter).select(F.col("id").cast("int").alias("it")).join(stats, "it", "left")


def _cells(rows: DataFrame, key, count: int, n_iter: int, block_rows: int, cell, schema: str) -> DataFrame:
    """``cell(first, last, table)`` for each block of the ``count`` rows (dealt by the hash ``key``) and block of iterations.

    Of large blocks there is a multiple of the cores, and each sees all iterations. Where there are fewer blocks
    than cores they are stored once and read for as many blocks of iterations as keep the cores busy."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = -(-count // block_rows)
    if blocks > 1 and count >= cores * LEAST_ROWS:
        blocks = -(-blocks // cores) * cores
    blocks = max(1, blocks, min(-(-2 * cores // MOST_SPANS), count // LEAST_ROWS))
    spans = max(1, min(n_iter, MOST_SPANS, -(-2 * cores // blocks))) if blocks < cores else 1
    step = max(1, -(-n_iter // spans))
    kept = rows.repartition(blocks, key)
    if spans > 1:
        kept = kept.persist(StorageLevel.DISK_ONLY)
        kept.count()

    def span(first: int, last: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            some = [b for b in batches if b.num_rows]
            if some:
                table = pa.Table.from_batches(some)
                some.clear()
                yield from cell(first, last, table).to_batches()
        return run

    found = [kept.mapInArrow(span(i, min(i + step, n_iter)), schema) for i in range(0, max(1, n_iter), step)]
    parts = scratch(reduce(DataFrame.unionByName, found), "perm-parts")
    if spans > 1:
        kept.unpersist()
    return parts


def _landing(nodes: np.ndarray, n: int, filled: int, seed: int):
    """A function of an iteration: which of the (sorted) ``nodes`` take a vector (their places in
    ``nodes``), and the positions that these take. Worked out for the nodes, or from the vectors'
    side if there are fewer of those."""
    if len(nodes) <= filled:
        def landed(it: int) -> tuple[np.ndarray, np.ndarray]:
            pos = keyed_bijection(nodes, n, it, seed)
            at = np.flatnonzero(pos < filled)
            return at, pos[at]
        return landed
    if n <= DENSE_NODES:  # a look into a table of all nodes is much faster than a search
        place = np.full(n, -1, np.int32)
        place[nodes] = np.arange(len(nodes), dtype=np.int32)
    every = np.arange(filled)

    def landed(it: int) -> tuple[np.ndarray, np.ndarray]:
        node = keyed_inverse(every, n, it, seed)
        if n <= DENSE_NODES:
            at = place.take(node).astype(np.int64)
            met = np.flatnonzero(at >= 0)
            if len(met) == len(at):
                return at, met
        else:
            at = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
            met = np.flatnonzero(nodes[at] == node)
        return at.take(met), met
    return landed


def _places(n: int, *ends: np.ndarray) -> tuple:
    """The different nodes (of 0..n-1), sorted, and for each of the arrays its nodes' places in them."""
    if n > DENSE_NODES:
        nodes = np.unique(np.concatenate(ends))
        return nodes, *[np.searchsorted(nodes, x).astype(np.int32) for x in ends]
    place = np.full(n, -1, np.int32)
    for x in ends:
        place[x] = 0
    nodes = np.flatnonzero(place == 0)
    place[nodes] = np.arange(len(nodes), dtype=np.int32)
    return nodes, *[place[x] for x in ends]


def _rows_of(at: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The numbers start[i] to start[i + 1] - 1 of each i of ``at``."""
    begin = start.take(at)
    count = start.take(at + 1) - begin
    ends = np.cumsum(count)
    rows = np.arange(ends[-1] if len(at) else 0)
    rows += np.repeat(begin - (ends - count), count)
    return rows


def _starts(code: np.ndarray, n: int) -> np.ndarray:
    """Where the rows of each of the codes 0..n-1 start when sorted by the code, and their end."""
    return np.concatenate([[0], np.cumsum(np.bincount(code, minlength=n))])


def _pieces(x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The rows begin[i]:end[i] of ``x``, one piece after another."""
    return np.concatenate([x[:0], *[x[i:j] for i, j in zip(begin.tolist(), end.tolist())]])


def _edge_cell(vectors, n: int, filled: int, seed: int):
    """For each iteration of a cell the sum of weight x cosine and of weights. Only edges whose
    end ``a`` takes a vector are looked at."""

    def cell(first: int, last: int, table: pa.Table) -> pa.Table:
        a, b, w = (table[c].to_numpy() for c in ("a", "b", "w"))
        nodes, a, b = _places(n, a, b)
        order = np.argsort(a, kind="stable")
        # 64-bit places: others are widened again each time that they index
        start, b, w, vec = _starts(a, len(nodes)), b[order].astype(np.int64), w[order], vectors.value
        del a, order
        w = None if (w == 1.0).all() else w
        landed = _landing(nodes, n, filled, seed)
        met, pos = np.zeros(len(nodes), bool), np.zeros(len(nodes), np.int64)
        num, den = np.zeros(last - first), np.zeros(last - first)
        for it in range(first, last):
            at, taken = landed(it)
            met[at], pos[at] = True, taken
            begin, end = start.take(at), start.take(at + 1)
            some = np.flatnonzero(end > begin)
            begin, end, own = begin.take(some), end.take(some), taken.take(some)
            size = end - begin
            if size.sum() >= RUN * len(some):
                ends, weight = _pieces(b, begin, end), None if w is None else _pieces(w, begin, end)
            else:
                rows = _rows_of(at.take(some), start)
                ends, weight = b.take(rows), None if w is None else w.take(rows)
            hit = np.flatnonzero(met.take(ends))
            found = np.diff(np.searchsorted(hit, np.concatenate([[0], np.cumsum(size)])))
            left, right = np.repeat(own, found), pos.take(ends.take(hit))
            for lo in range(0, len(hit), CHUNK):
                part = slice(lo, lo + CHUNK)
                x, y = vec.take(left[part], axis=0), vec.take(right[part], axis=0)
                if weight is not None:
                    x *= weight.take(hit[part])[:, None]
                num[it - first] += np.vdot(x, y)
            den[it - first] = len(hit) if weight is None else weight.take(hit).sum()
            met[at] = False
        return pa.table({"it": np.arange(first, last, dtype=np.int32), "num": num, "den": den})

    return cell


def _role_cell(vectors, n: int, filled: int, seed: int):
    """For each iteration of a cell the sums over its whole users of |sum r v|^2 - sum r^2 and of
    (sum r)^2 - sum r^2; for each split user sum r^2, sum r and sum r v of the cell's rows. Only
    rows whose document takes a vector are looked at; a whole user with one such row adds nothing."""

    def cell(first: int, last: int, table: pa.Table) -> pa.Table:
        users = table["user"].combine_chunks().dictionary_encode(null_encoding="encode")
        code, r = users.indices.to_numpy(), table["r"].to_numpy()
        split = np.zeros(len(users.dictionary), bool)
        split[code] = table["split"].to_numpy(zero_copy_only=False)
        nodes, local = _places(n, table["a"].to_numpy())
        order = np.argsort(local, kind="stable")
        start, code, r = _starts(local, len(nodes)), code[order].astype(np.int64), r[order]
        del local, order, table
        landed, vec, splits = _landing(nodes, n, filled, seed), vectors.value, split.any()
        by_topic, out = np.ascontiguousarray(vec.T), []
        for it in range(first, last):
            at, taken = landed(it)
            rows = _rows_of(at, start)
            c, x = code.take(rows), r.take(rows)
            pos = np.repeat(taken, start.take(at + 1) - start.take(at))
            many = np.bincount(c, minlength=len(split)) > 1
            if splits:
                many |= split
            kept = np.flatnonzero(many.take(c))
            c, x, pos = c.take(kept), x.take(kept), pos.take(kept)
            among = np.flatnonzero(many)
            place = np.cumsum(many)
            place -= 1
            c = place.take(c)
            sums = []
            for topic in by_topic:
                z = topic.take(pos)
                z *= x
                sums.append(np.bincount(c, z, len(among)))
            sr, sr2 = np.bincount(c, x, len(among)), np.bincount(c, x * x, len(among))
            if splits:
                here = split.take(among)
                there = np.bincount(c, minlength=len(among)) > 0
                for j in np.flatnonzero(here & there):
                    out.append((it, True, int(among[j]), sr2[j], sr[j], [s[j] for s in sums]))
                sums, sr, sr2 = [s[~here] for s in sums], sr[~here], sr2[~here]
            out.append((it, False, None, float(sum(s @ s for s in sums) - sr2.sum()), float(sr @ sr - sr2.sum()), None))
        it, part, user, num, den, sums = zip(*out) if out else [()] * 6
        return pa.table({"it": pa.array(it, pa.int32()), "split": pa.array(part, pa.bool_()), "user":
                         users.dictionary.take(pa.array(user, pa.int32())), "num": pa.array(num, pa.float64()),
                         "den": pa.array(den, pa.float64()), "sums": pa.array(sums, pa.list_(pa.float64()))})

    return cell


def _stats_by_joins(edges: DataFrame | None, idx: DataFrame, n: int, filled: int, k: int, n_iter: int, seed: int,
                    doc_roles: DataFrame | None) -> DataFrame:
    """The statistics of vectors of any number: blocks of ``JOINED_ITERATIONS`` are joined with
    the vectors one after another, so that the written table of a block is all there is at a time."""
    done = None
    for first in range(0, n_iter, JOINED_ITERATIONS):
        taken = _taken(idx, n, filled, k, first, min(JOINED_ITERATIONS, n_iter - first), seed)
        stat = scratch(_joined_stats(edges, taken, k, doc_roles), "perm-block")
        discard(taken)
        done = stat if done is None else done.unionByName(stat)
    return _every(idx, n_iter, done)


def _taken(idx: DataFrame, n: int, filled: int, k: int, first: int, count: int, seed: int) -> DataFrame:
    """(it, node, v*) of the nodes that take a vector in the iterations from ``first`` on."""
    nz = idx.where("not none").select(F.col("idx").alias("src_idx"), *[f"v{i}" for i in range(k)])
    # The size estimate does not know the rows that the job adds, so this join is pinned to
    # a shuffle join; the written table has its true size, and AQE picks the others.
    rows = permutations(idx.repartition(idx.sparkSession.sparkContext.defaultParallelism, "node"), n, count, seed,
                        filled, first)
    return scratch(rows.hint("merge").join(nz, "src_idx").drop("src_idx"), "perm-vectors")


def _joined_stats(edges: DataFrame | None, taken: DataFrame, k: int, doc_roles: DataFrame | None) -> DataFrame:
    """(it, stat) of the relabelled vectors ``taken``."""
    v = [f"v{i}" for i in range(k)]
    if doc_roles is not None:
        per = doc_roles.join(taken.withColumnRenamed("node", "doc"), "doc").groupBy("it", "user").agg(
            F.sum("r").alias("sr"), F.sum(F.col("r") * F.col("r")).alias("sr2"),
            *[F.sum(F.col("r") * F.col(c)).alias(f"s{i}") for i, c in enumerate(v)])
        sq = sum((F.col(f"s{i}") * F.col(f"s{i}") for i in range(k)), F.lit(0.0))
        return per.groupBy("it").agg(F.try_divide(F.sum(sq - F.col("sr2")), F.sum(F.col("sr") * F.col("sr") - F.col("sr2")))
                                     .alias("stat"))
    # the edges of a source sum their targets' vectors before they meet the source's
    w = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    e = edges.select("src", F.col("dst").alias("node"), w.alias("w"))
    per = e.join(taken, "node").groupBy("it", "src").agg(
        F.sum("w").alias("sw"), *[F.sum(F.col("w") * F.col(c)).alias(f"s{i}") for i, c in enumerate(v)])
    j = per.join(taken.withColumnRenamed("node", "src"), ["it", "src"])
    return j.groupBy("it").agg((F.sum(_dot("s", "v", k)) / F.sum("sw")).alias("stat"))


def permutation_test(edges: DataFrame | None, vecs: DataFrame, k: int, n_iter: int = 100,
                     seed: int = DEFAULT_SEED, doc_roles: DataFrame | None = None) -> DataFrame:
    """L15 + K11 + G10 + G11 + G13: one row with the observed mean cosine, its
    ECDF quantile in the permutation distribution, VA index, verdict and the
    summary of the distribution."""
    vecs = scratch(vecs, "perm-nodes")  # read by the observed mean, the index and the statistic
    small = vecs.select(F.count("v0")).first()[0] * k * 8 <= VECTOR_BYTES
    if doc_roles is not None:
        doc_roles = scratch(doc_roles, "perm-roles")
    else:
        edges = scratch(edges, "perm-edges")
    if doc_roles is not None:
        observed = doc_cosine_mean(doc_roles, vecs.withColumnRenamed("node", "doc"), k, small)
    else:
        observed = edge_cosine_mean(edges, vecs, k, small)
    obs = observed.first()["mean_cosine"]
    stat = scratch(permutation_stats(edges, vecs, k, n_iter, seed, doc_roles), "perm-stats")
    summary = describe(stat, "stat", digits=None)
    q = stat.agg(F.avg((F.col("stat") <= F.lit(obs)).cast("double")).alias("quantile")).first()["quantile"]
    return summary.select(
        F.lit(obs).alias("observed"), F.lit(q).alias("quantile"),
        va_index(F.lit(obs), F.col("mean"), F.col("std")).alias("va_index"),
        verdict(F.lit(q)).alias("verdict"), F.lit(n_iter).alias("n_iter"), "*")
