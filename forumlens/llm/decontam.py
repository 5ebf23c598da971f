"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and benchmark items become lower-case letters, digits and single spaces (bytes).
An item of n bytes matches a region of a text if at most ``k`` edits turn one into the
other, ``k`` being ``error`` times n, and less if a short item's q-grams allow no more.
By the q-gram lemma such a region shares at least ``n - q + 1 - k q`` q-grams with the
item, on diagonals at most ``k`` apart. Shared q-grams are therefore counted in diagonal
bands of width ``2 (k + 1)`` that overlap by half, so that each such run of diagonals
lies whole in one; bands that meet the bound are verified by banded alignment: for each
number of edits, how far each diagonal of the band gets, eight bytes at a step, so that the
work grows with the edits and not with the square of the length. Items shorter than q
have no q-gram; they match where they stand as whole words.

The benchmark goes through the texts in blocks of a fixed size; each block is one pass
over the texts without a shuffle of texts, so that a passage in many texts makes no hot key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens.llm.common import lower_bytes, mix, text_chunks, unnamed
from forumlens.sources.scratch import scratch

Q = 8                 # bytes: a q-gram is one 64-bit number
ERROR = 0.1
BLOCK_BYTES, BLOCK_ITEMS = 4 << 20, 1 << 18  # of the benchmark in a pass
SHARED = 1 << 22       # shared q-grams listed at once
CELLS = 1 << 21        # of bands aligned at once
SEEN_BITS = 22

_PLAIN = np.full(256, 0x20, np.uint8)
_PLAIN[0x30:0x3A] = np.arange(0x30, 0x3A)
_PLAIN[0x61:0x7B] = np.arange(0x61, 0x7B)
_PLAIN[0x80:] = np.arange(0x80, 0x100)


def plain(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes and offsets of several texts; no text begins with a space."""
    b = _PLAIN[lower_bytes(buf)]
    first = np.zeros(len(b) + 1, bool)
    first[offs] = True
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 0x20) | (b[:-1] != 0x20)
    keep &= ~(first[:len(b)] & (b == 0x20))
    return b[keep], np.concatenate([[0], np.cumsum(keep)])[offs]


def packed(b: np.ndarray) -> np.ndarray:
    """The q bytes from each place on as one number."""
    m = len(b) - Q + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    g = b.astype(np.uint64)
    for step in (1, 2, 4):
        g = g[:-step] | (g[step:] << np.uint64(8 * step))
    return g[:m]


@dataclass
class Block:
    """Benchmark items with the index of their q-grams."""
    ids: list
    items: list[np.ndarray]
    size: np.ndarray
    budget: np.ndarray
    need: np.ndarray
    grams: np.ndarray   # sorted, each once
    first: np.ndarray   # of its places
    item: np.ndarray
    at: np.ndarray
    seen: np.ndarray    # bitmap of hashed q-grams
    text: np.ndarray    # the items' bytes, packed
    start: np.ndarray   # of each item in them
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # by length under q: sorted items as numbers, their places


def _slot(g: np.ndarray) -> np.ndarray:
    return (mix(g) >> np.uint64(64 - SEEN_BITS)).astype(np.int64)


def build(ids: list, texts: list[str], error: float = ERROR) -> Block:
    (_, _, buf, offs), = list(text_chunks(pa.array(texts, pa.large_string()), 1 << 62))
    b, lo = plain(buf, offs)
    items = []
    for i, j in zip(lo[:-1], lo[1:]):
        x = b[i:j]
        items.append(x[:-1] if len(x) and x[-1] == 0x20 else x)
    size = np.array([len(x) for x in items], np.int64)
    # at least one shared q-gram must remain: n - q + 1 - k q >= 1
    budget = np.maximum(0, np.minimum(np.floor(error * size).astype(np.int64), (size - Q) // Q))
    parts = [packed(x) for x in items]
    g = np.concatenate(parts)
    item = np.repeat(np.arange(len(items)), [len(p) for p in parts])
    at = np.concatenate([np.arange(len(p)) for p in parts])
    order = np.argsort(g, kind="stable")
    grams, first = np.unique(g[order], return_index=True)
    seen = np.zeros(1 << SEEN_BITS, bool)
    seen[_slot(grams)] = True
    start = np.concatenate([[0], np.cumsum(size)])
    text = packed(np.concatenate([*items, np.zeros(Q, np.uint8)]))
    short = {}
    for n in range(1, Q):
        has = np.flatnonzero(size == n)
        if len(has):
            code = text[start[has]] & _low_bytes(n)
            by = np.argsort(code, kind="stable")
            short[n] = code[by], has[by]
    return Block(ids, items, size, budget, np.maximum(1, size - Q + 1 - budget * Q), grams,
                 np.append(first, len(g)), item[order], at[order], seen, text, start[:-1], short)


def _low_bytes(n: int) -> np.uint64:
    return np.uint64((1 << 8 * n) - 1)


def short_matches(block: Block, b: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, item) of items under ``Q`` bytes that stand in a text as whole words."""
    if not block.short or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = np.zeros(len(b) + 1, bool)
    begins[lo] = True
    begins[1:] |= b == 0x20
    pos = np.flatnonzero(begins[:-1] & (b != 0x20))
    doc = np.searchsorted(lo, pos, "right") - 1
    here = packed(np.append(b, np.zeros(Q, np.uint8)))[pos]
    docs, items = [], []
    for n, (codes, places) in block.short.items():
        end = pos + n
        whole = (end == lo[doc + 1]) | ((end < lo[doc + 1]) & (b[np.minimum(end, len(b) - 1)] == 0x20))
        key = here & _low_bytes(n)
        first, last = np.searchsorted(codes, key, "left"), np.searchsorted(codes, key, "right")
        hit = np.flatnonzero(whole & (last > first))
        pair = np.unique(np.column_stack([doc[hit], first[hit]]), axis=0)  # a word once a text
        count = np.searchsorted(codes, codes[pair[:, 1]], "right") - pair[:, 1]
        at = np.arange(count.sum()) + np.repeat(pair[:, 1] - (np.cumsum(count) - count), count)
        docs.append(np.repeat(pair[:, 0], count))
        items.append(places[at])
    return np.concatenate(docs).astype(np.int64), np.concatenate(items).astype(np.int64)


def _counted(rows: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different columns of ``rows`` (3, n), and how often each stands there."""
    order = np.lexsort(rows[::-1])
    rows = rows[:, order]
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[:, 1:] != rows[:, :-1]).any(0)
    first = np.flatnonzero(new)
    n = np.ones(rows.shape[1], np.int64) if weight is None else weight[order]
    return rows[:, first], np.add.reduceat(n, first) if len(first) else n


def candidates(block: Block, b: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, item, first diagonal of the band) of bands with enough shared q-grams."""
    g = packed(b)
    pos = np.flatnonzero(block.seen[_slot(g)]) if len(g) else np.zeros(0, np.int64)
    doc = np.searchsorted(lo, pos, "right") - 1
    inside = pos + Q <= lo[doc + 1] if len(pos) else np.zeros(0, bool)
    pos, doc = pos[inside], doc[inside]
    k = np.searchsorted(block.grams, g[pos])
    hit = k < len(block.grams)
    hit[hit] = block.grams[k[hit]] == g[pos[hit]]
    pos, doc, k = pos[hit], doc[hit], k[hit]
    if not len(pos):
        return (np.zeros(0, np.int64),) * 3
    count = block.first[k + 1] - block.first[k]
    cuts = np.searchsorted(np.cumsum(count), np.arange(SHARED, count.sum() + SHARED, SHARED))
    found, times = [], []
    for part in np.split(np.arange(len(pos)), np.unique(cuts[:-1] + 1)):
        if not len(part):
            continue
        c = count[part]
        where = np.arange(c.sum()) + np.repeat(block.first[k[part]] - (np.cumsum(c) - c), c)
        item, at = block.item[where], block.at[where]
        d, p = np.repeat(doc[part], c), np.repeat(pos[part], c)
        # diagonals counted from -size, so that they are not negative
        band = (p - lo[d] - at + block.size[item]) // (block.budget[item] + 1)
        both = np.array([np.tile(d, 2), np.tile(item, 2), np.concatenate([band, np.maximum(0, band - 1)])])
        rows, n = _band_counts(both)
        found.append(rows)
        times.append(n)
    if len(found) > 1:
        rows, n = _counted(np.concatenate(found, axis=1), np.concatenate(times))
    doc, item, band = rows
    enough = n >= block.need[item]
    doc, item, band = doc[enough], item[enough], band[enough]
    return doc, item, band * (block.budget[item] + 1) - block.size[item]


def _band_counts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_counted`` with a single key where text, item and band fit one."""
    bits = [int(r.max()).bit_length() for r in rows]
    if sum(bits) > 62:
        return _counted(rows)
    key, n = np.unique((((rows[0] << bits[1]) | rows[1]) << bits[2]) | rows[2], return_counts=True)
    pair = key >> bits[2]
    return np.array([pair >> bits[1], pair & ((1 << bits[1]) - 1), key & ((1 << bits[2]) - 1)]), n


def align(block: Block, b: np.ndarray, lo: np.ndarray, doc: np.ndarray, item: np.ndarray,
          low: np.ndarray) -> np.ndarray:
    """Fewest edits between each item and a region of its text within the band, all at once;
    a number over the budget where there are more.

    ``far[c, j]``: the most bytes of the item matched on diagonal ``left + j`` (place in the
    text less place in the item) with the edits so far.
    """
    budget, n, size = block.budget[item], block.size[item], (lo[1:] - lo[:-1])[doc]
    left, width = low - budget, 2 * (budget + 1) + 2 * budget + 1
    text = packed(np.append(b, np.zeros(Q, np.uint8)))
    best = budget + 1
    live = np.arange(len(item))
    far = np.where(np.arange(int(width.max())) < width[:, None], 0, -(1 << 40))
    for edits in range(int(budget.max()) + 1):
        if edits:
            new = far + 1                                             # another byte
            new[:, 1:] = np.maximum(new[:, 1:], far[:, :-1])          # one more in the text
            new[:, :-1] = np.maximum(new[:, :-1], far[:, 1:] + 1)     # one less
            inside = np.arange(far.shape[1]) < width[live][:, None]
            far = np.where(inside, np.minimum(new, n[live][:, None]), -(1 << 40))
        row, col = np.nonzero(far >= 0)
        c = live[row]
        r = far[row, col]
        while len(row):  # follow equal bytes
            at = r + left[c] + col
            room = np.where(at >= 0, np.minimum(n[c] - r, size[c] - at), 0)
            going = room > 0
            row, col, c, r, at, room = row[going], col[going], c[going], r[going], at[going], room[going]
            x = block.text[block.start[item[c]] + r] ^ text[lo[doc[c]] + at]
            equal = np.where(x == 0, Q, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) // 8).astype(np.int64)
            r = r + np.minimum(equal, room)
            far[row, col] = r
            going = (equal == Q) & (room > Q)
            row, col, c, r = row[going], col[going], c[going], r[going]
        done = far.max(1) >= n[live]
        best[live[done]] = edits
        stay = ~done & (budget[live] > edits)
        live, far = live[stay], far[stay]
        if not len(live):
            break
    return best


def _aligned(block: Block, b: np.ndarray, lo: np.ndarray, doc: np.ndarray, item: np.ndarray, low: np.ndarray) -> np.ndarray:
    """``align`` in groups of bands of like width and about ``CELLS`` cells."""
    order = np.argsort(block.budget[item], kind="stable")
    out = np.zeros(len(doc), np.int64)
    i = 0
    while i < len(order):
        j = i
        while j < len(order) and (j == i or (j - i + 1) * (4 * int(block.budget[item[order[j]]]) + 3) <= CELLS):
            j += 1
        part = order[i:j]
        out[part] = align(block, b, lo, doc[part], item[part], low[part])
        i = j
    return out


def match_chunk(block: Block, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, item, edits) of the matches in some texts, each pair once with its fewest edits."""
    b, lo = plain(buf, offs)
    doc, item, low = candidates(block, b, lo)
    edits = _aligned(block, b, lo, doc, item, low)
    ok = edits <= block.budget[item]
    words, whole = short_matches(block, b, lo)
    doc, item = np.append(doc[ok], words), np.append(item[ok], whole)
    edits = np.append(edits[ok], np.zeros(len(words), np.int64))
    order = np.lexsort((edits, item, doc))
    doc, item, edits = doc[order], item[order], edits[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    return doc[new], item[new], edits[new]


def blocks(benchmark: DataFrame, error: float = ERROR, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """The benchmark in blocks of about ``most`` bytes (or one longer item) and ``BLOCK_ITEMS`` items."""
    ids, texts, held = [], [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        if ids and (held + len(r["text"].encode()) > most or len(ids) >= BLOCK_ITEMS):
            yield build(ids, texts, error)
            ids, texts, held = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        held += len(r["text"].encode())
    if ids:
        yield build(ids, texts, error)


def _pass(docs: DataFrame, block: Block, make_rows, schema):
    shared = docs.sparkSession.sparkContext.broadcast(block)  # BLOCK_BYTES of benchmark text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in text_chunks(batch.column(batch.num_columns - 1)):
                got = match_chunk(shared.value, buf, offs)
                yield make_rows(shared.value, batch.slice(i, j - i), *got)

    return docs.mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, error: float = ERROR) -> DataFrame:
    """Rows (doc_id, item_id, edits, budget, item_chars): each document and benchmark item that
    match, with the fewest edits found.

    Null and empty texts and items match nothing; items of under ``Q`` normalised bytes match
    where they stand as whole words, without edits; documents with the same id are one; a null id is an id like others; equal items count each;
    empty tables give no rows. Whole texts are searched, of any length.
    """
    spark, out = docs.sparkSession, None

    def rows(block, batch, doc, item, edits):
        ids = batch.column(0).take(pa.array(doc))
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([block.ids[i] for i in item], pa.int64()), pa.array(edits, pa.int64()),
             pa.array(block.budget[item], pa.int64()), pa.array(block.size[item], pa.int64())],
            ["doc_id", "item_id", "edits", "budget", "item_chars"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    schema = "doc_id long, item_id long, edits long, budget long, item_chars long"
    for block in blocks(benchmark, error):  # one block is held at a time
        got = scratch(_pass(src, block, rows, schema), "contamination")
        out = got if out is None else out.unionByName(got)
    if out is None:
        return spark.createDataFrame([], schema)
    return out.groupBy("doc_id", "item_id").agg(
        F.min("edits").alias("edits"), F.max("budget").alias("budget"), F.max("item_chars").alias("item_chars"))


def clean(docs: DataFrame, benchmark: DataFrame, error: float = ERROR) -> DataFrame:
    """The rows of ``docs`` whose text matches no benchmark item, all columns unchanged (null
    and empty texts stay). One pass over the rows for each block of the benchmark."""
    left, (text,) = unnamed(docs, "text")

    def rows(_, batch, doc, item, edits):
        keep = np.ones(batch.num_rows, bool)
        keep[doc] = False
        return batch.drop_columns(["text"]).filter(pa.array(keep))

    for i, block in enumerate(blocks(benchmark, error)):
        left = scratch(left, "decontaminated") if i else left
        left = _pass(left.select("*", F.col(text).alias("text")), block, rows, left.schema)
    return left.toDF(*docs.columns)
