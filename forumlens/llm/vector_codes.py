"""Vector code compression: product quantisation trained with Drake-Hamerly adaptive bounds.

Vectors of whole numbers are cut into equal parts, each with its own codebook. A round
assigns every part to its nearest entry and moves each entry to the floored mean of its
parts; the result is that of full assignment in every round.

Each part keeps, from round to round, its entry with an upper bound of the distance, its
``b`` next entries in order with a lower bound for each, and one outer lower bound for
all the rest. When entries move, upper bounds grow by the move of the own entry, lower
bounds shrink by the move of theirs, the outer one by the largest move. A part whose
upper bound is clearly below all of them stays without a distance being worked out. For the
others the distances of the own entry and of the first ``j`` of the list are worked out in
whole numbers, with ``j`` the first place from which on all bounds are clearly above;
where there is none, all entries are. Ties and near ties are never left to the bounds, so
floating point decides nothing. ``b`` is adapted for each part position: it shrinks to the
depth that nearly all uncertain parts needed in the last round.

A round is one pass over the stored state and one small sum; a superseded state is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlens.sources.scratch import discard, scratch

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
FIRST_BOUNDS, LEAST_BOUNDS = 4, 2   # entries / 4 and entries / 8, as published
ENOUGH = 0.99                       # share of uncertain parts whose depth the next list must hold
SLACK = 1e-6                        # relative; stored bounds are 32-bit and rounded outward
LARGEST = 1 << 60                   # of a squared distance; components then fit 32 bits

STATE = "vec_id long, label string, x binary, code binary, depth binary, near binary, bound binary"


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of parts (n, w) to ``entries`` (k, w), or to own lists (n, k, w)."""
    if entries.ndim == 2:
        entries = entries[None]
    d = x[:, None, :] - entries
    return np.einsum("nkw,nkw->nk", d, d)


class Part:
    """State of a batch of parts at one position: ``code`` (n,), ``near`` (n, b), and
    ``bound`` (n, b + 2): upper bound, ``b`` lower bounds, outer bound."""

    def __init__(self, code: np.ndarray, near: np.ndarray, bound: np.ndarray):
        self.code, self.near, self.bound = code, near, bound

    @staticmethod
    def fresh(x: np.ndarray, entries: np.ndarray, b: int) -> Part:
        """From all distances; ties go to the lower index."""
        d = squared(x, entries)
        order = np.argsort(d, axis=1, kind="stable")
        root = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
        n, k = d.shape
        bound = np.full((n, b + 2), np.inf, np.float32)
        bound[:, 0] = _up(root[:, 0])
        have = min(b, k - 1)
        near = np.full((n, b), 255, np.uint8)
        near[:, :have] = order[:, 1:1 + have]
        bound[:, 1:1 + have] = _down(root[:, 1:1 + have])
        if k > b + 1:
            bound[:, -1] = _down(root[:, b + 1])
        return Part(order[:, 0].astype(np.uint8), near, bound)

    def moved(self, moves: np.ndarray) -> None:
        """Entries moved by ``moves`` (k,): bounds stay bounds."""
        far = np.append(moves, np.zeros(256 - len(moves)))
        bound = self.bound.astype(np.float64)
        self.bound[:, 0] = _up(bound[:, 0] + far[self.code])
        self.bound[:, 1:-1] = _down(bound[:, 1:-1] - far[self.near])
        self.bound[:, -1] = _down(bound[:, -1] - moves.max(initial=0))

    def depths(self) -> np.ndarray:
        """How many of the list each part needs: the first place from which on all lower bounds
        are clearly above the upper one; b + 1 if even the outer one isn't."""
        least = np.minimum.accumulate(self.bound[:, :0:-1].astype(np.float64), axis=1)[:, ::-1]
        clear = self.bound[:, :1] * (1.0 + SLACK) < least * (1.0 - SLACK)
        return np.where(clear.any(1), clear.argmax(1), clear.shape[1])

    def assign(self, x: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Make every code that of the nearest entry; returns the depth needed."""
        b = self.near.shape[1]
        unsure = np.flatnonzero(self.depths() > 0)
        depth = np.zeros(len(x), np.uint8)
        if len(unsure):  # a tight upper bound first
            own = squared(x[unsure], entries[self.code[unsure]][:, None, :])[:, 0]
            self.bound[unsure, 0] = _up(np.sqrt(own.astype(np.float64)))
            left = Part(self.code[unsure], self.near[unsure], self.bound[unsure])
            depth[unsure] = left.depths()
        for j in np.unique(depth[depth > 0]):
            at = np.flatnonzero(depth == j)
            if j > b:
                new = Part.fresh(x[at], entries, b)
                self.code[at], self.near[at], self.bound[at] = new.code, new.near, new.bound
                continue
            ids = np.column_stack([self.code[at], self.near[at, :j]])
            ids.sort(axis=1)                       # ties to the lower index; 255 is no entry
            d = squared(x[at], entries[np.minimum(ids, len(entries) - 1)])
            d = np.where(ids == 255, np.iinfo(np.int64).max, d)
            order = np.argsort(d, axis=1, kind="stable")
            ids, root = np.take_along_axis(ids, order, 1), np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
            self.code[at] = ids[:, 0]
            self.near[at[:, None], np.arange(j)] = ids[:, 1:]
            self.bound[at, 0] = _up(root[:, 0])
            self.bound[at[:, None], 1 + np.arange(j)] = _down(root[:, 1:])
        return depth

    def shortened(self, b: int) -> Part:
        """With a list of ``b``; what is cut is left to the outer bound."""
        if b >= self.near.shape[1]:
            return self
        outer = self.bound[:, 1 + b:].min(1)
        return Part(self.code, self.near[:, :b], np.column_stack([self.bound[:, :1 + b], outer]))


def _stack(column: pa.Array, kind: type, rows: int) -> np.ndarray:
    got = np.frombuffer(b"".join(column.to_pylist()), kind)
    return got.reshape(rows, len(got) // max(1, rows)).copy()


def _rows(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())


def _parts(x: np.ndarray) -> np.ndarray:
    """(parts, n, width) view of (n, dims)."""
    return x.reshape(len(x), PARTS, -1).transpose(1, 0, 2)


def _round(books: np.ndarray, moves: np.ndarray, had: list[int], keep: list[int], first: bool):
    """One assignment of all stored rows; ``had`` and ``keep``: list lengths before and after."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _parts(_stack(batch.column(2), np.int32, n).astype(np.int64))
            if not first:
                code, near = _stack(batch.column(3), np.uint8, n), _stack(batch.column(5), np.uint8, n)
                bound = _stack(batch.column(6), np.float32, n)
                near = np.split(near, np.cumsum(had)[:-1], axis=1)
                bound = np.split(bound, np.cumsum([b + 2 for b in had])[:-1], axis=1)
            parts, depth = [], np.zeros((n, PARTS), np.uint8)
            for p in range(PARTS):
                if first:
                    part = Part.fresh(x[p], books[p], keep[p])
                else:
                    part = Part(code[:, p].copy(), near[p].copy(), bound[p].copy()).shortened(keep[p])
                    part.moved(moves[p])
                    depth[:, p] = part.assign(x[p], books[p])
                parts.append(part)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), _rows(np.column_stack([p.code for p in parts])),
                 _rows(depth), _rows(np.column_stack([p.near for p in parts])),
                 _rows(np.column_stack([p.bound for p in parts]))],
                ["vec_id", "label", "x", "code", "depth", "near", "bound"])
    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's rows: (part, entry, place, total), with place -1 for the number of parts of
    an entry, and entry -1 for the number of parts by the depth needed (as place)."""
    totals: dict[tuple[int, int, int], int] = {}
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        x, code, depth = (_stack(batch.column(i), t, n) for i, t in enumerate((np.int32, np.uint8, np.uint8)))
        for p, part in enumerate(_parts(x.astype(np.int64))):
            order = np.argsort(code[:, p], kind="stable")
            entry, first, count = np.unique(code[order, p], return_index=True, return_counts=True)
            for e, k, row in zip(entry, count, np.add.reduceat(part[order], first, axis=0)):
                for place, v in enumerate(row):
                    key = (p, int(e), place)
                    totals[key] = totals.get(key, 0) + int(v)
                totals[p, int(e), -1] = totals.get((p, int(e), -1), 0) + int(k)
            for j, k in zip(*np.unique(depth[:, p], return_counts=True)):
                totals[p, -1, int(j)] = totals.get((p, -1, int(j)), 0) + int(k)
    if totals:
        keys = np.array(list(totals), np.int64)
        yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in keys.T), pa.array(list(totals.values()), pa.int64())],
                                         ["part", "entry", "place", "total"])


def next_lists(counts: dict[int, int], b: int) -> int:
    """The list length for the next round, from the number of parts by the depth needed."""
    unsure = sorted((j, n) for j, n in counts.items() if j)
    total, seen = sum(n for _, n in unsure), 0
    for j, n in unsure:
        seen += n
        if seen >= ENOUGH * total:
            return max(min(LEAST_BOUNDS, b), min(b, j))
    return min(LEAST_BOUNDS, b) if total == 0 else b


def _finite(v: Column) -> Column:
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) for each kept row of (vec_id, label, embedding), and the
    codebooks (parts, entries, width).

    ``code``: one byte a part; ``error``: the squared distances to the final entries, summed.
    Components become floor(4096 x). The first codebooks are the parts of the 16 rows of
    the smallest vec_ids (null last, then by vector); with fewer rows there are fewer entries.
    Rows whose vector is null or holds a null or non-finite component are dropped, and so are
    vectors of another length than most have (ties: the longer) and empty ones. A length that
    isn't a multiple of 8 is filled up with zeros. Repeated rows and rows without an id or label
    stay, each with its code. An empty table gives no rows. Raises if a squared distance can
    pass 2^60.
    """
    v = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"),
                       F.col("embedding").cast("array<double>").alias("e"))
    v = v.where(_finite(F.col("e")) & (F.size("e") > 0))
    reach = F.expr(f"aggregate(e, 0D, (m, c) -> greatest(m, abs(c) * {SCALE}D + 1))")
    dim = v.groupBy(F.size("e").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(reach).alias("reach")).orderBy(
        F.desc("n"), F.desc("d")).first()
    if dim is None:
        none = v.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"))
        return none, np.zeros((PARTS, 0, 0), np.int64)
    if dim["d"] * (2 * dim["reach"]) ** 2 >= LARGEST:
        raise ValueError(f"components up to {dim['reach']:.3g} in {dim['d']} dimensions: a distance can pass 2^60")
    fill = -dim["d"] % PARTS
    whole = F.transform("e", lambda c: F.floor(c * F.lit(float(SCALE))))
    kept = v.where(F.size("e") == dim["d"]).select(
        "vec_id", "label", F.concat(whole, F.array_repeat(F.lit(0).cast("long"), fill)).alias("x"))
    start = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).select("x").toArrow()
    books = _parts(np.array(start.column(0).to_pylist(), np.int64)).copy()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1).astype(np.int32)
                none = pa.array([b""] * b.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _rows(x), none, none, none, none],
                                                 ["vec_id", "label", "x", "code", "depth", "near", "bound"])

    state = kept.mapInArrow(pack, STATE)
    had = keep = [min(FIRST_BOUNDS, ENTRIES)] * PARTS
    moves = np.zeros(books.shape[:2])
    for r in range(rounds + 1):
        old = state
        state = scratch(old.mapInArrow(_round(books, moves, had, keep, r == 0), STATE), f"codes-{r}")
        if r:
            discard(old)
        if r == rounds:
            break
        found = state.select("x", "code", "depth").mapInArrow(_sums, "part long, entry long, place long, total long")
        found = found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect()  # of fixed size
        totals = {(row["part"], row["entry"], row["place"]): row["total"] for row in found}
        new = books.copy()
        for p in range(PARTS):
            for e in range(books.shape[1]):
                if n := totals.get((p, e, -1)):
                    new[p, e] = [totals[p, e, w] // n for w in range(books.shape[2])]
        moves = np.sqrt(((new - books) ** 2).sum(2).astype(np.float64)) * (1 + SLACK)
        had, books = keep, new
        if r:
            keep = [next_lists({j: n for (q, e, j), n in totals.items() if q == p and e == -1}, had[p])
                    for p in range(PARTS)]
    return state.select("vec_id", "label", "code", _error(books)(F.col("x"), F.col("code")).alias("error")), books


def _error(books: np.ndarray):
    @F.pandas_udf("long")
    def error(x, code):
        import pandas as pd

        n = len(x)
        if not n:
            return pd.Series([], dtype="int64")
        parts = _parts(np.frombuffer(b"".join(x), np.int32).reshape(n, -1).astype(np.int64))
        codes = np.frombuffer(b"".join(code), np.uint8).reshape(n, PARTS)
        return pd.Series(sum(squared(parts[p], books[p][codes[:, p]][:, None, :])[:, 0] for p in range(PARTS)))
    return error


def digest(books: np.ndarray) -> str:
    """sha256 of all entries' components by part, entry and place, as decimals joined by commas."""
    return hashlib.sha256(",".join(str(int(c)) for c in books.ravel()).encode()).hexdigest()
