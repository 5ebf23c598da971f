"""N-gram Jaccard join with a MinHash LSH forest.

Sets are the 5-word shingles of the lower-cased words; two texts are linked if their
Jaccard similarity is at least ``threshold``.

1. Equal texts become one node (64-bit hash of the text), with their number of copies.
2. Each node has a path in ``TREES`` tries: its signature, read from the tree's own
   ``DEPTH`` values on. Sorted paths are the trie; nodes that share a prefix of ``floor_depth``
   values of a tree, at which a pair at the threshold meets with the target recall, are a
   bucket: one subtree, sorted.
3. In a subtree matched prefixes start at full length and are shortened trie node by trie
   node. At each branching the first live node leads: nodes with an estimate of at least
   ``SAME`` to it are settled and stop there, the others and the leader go on to the shorter
   prefix. At the floor all live nodes are compared with leaders until none is left: an
   estimate of at least ``NEAR`` settles a node that leads nobody, one of at least ``LOOSE``
   joins it. As 1 - Jaccard is a metric, the leaders of two linked nodes have a similarity of at least
   threshold - (1 - SAME) - (1 - NEAR), over ``LOOSE``, and lie under the prefix by which the
   linked nodes meet, so linked nodes are joined. A bucket of over ``SALT_ROWS`` nodes is cut into
   blocks, and each pair of blocks is one group with all nodes of both: every two nodes
   of a bucket meet in a group, so the margin is the same as in a small bucket.
4. The joined nodes' components are verified exactly: each pair of blocks of a component
   is one bounded group, in which all shared shingles are counted; it returns a row for
   each node (its links and its root), never the pairs.
5. Components of the verified links are the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from forumlens.llm.common import batch_column, doc_index, mix, shingles, text_chunks, unnamed
from forumlens.operators.components import components
from forumlens.sources.scratch import scratch

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 14, 5, 0.999
SAME, NEAR, LOOSE = 0.97, 0.85, 0.42
SALT_ROWS = 1 << 16                        # of a bucket in a group (two blocks, a sixteenth left for chance)
BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 1 << 20  # of a component in a block

_N = TREES * DEPTH
_A = (mix(np.arange(1, _N + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(1, _N + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(32)).astype(np.uint32)


def floor_depth(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix with which a pair at the threshold meets in a tree with this probability:
    prefixes are shortened down to it, and no further."""
    d = depth
    while d > 1 and 1 - (1 - threshold ** d) ** trees < recall:
        d -= 1
    return d


def signatures(g: np.ndarray, go: np.ndarray) -> np.ndarray:
    """16-bit MinHash values by text; all 0 for a text without shingles."""
    out = np.zeros((len(go) - 1, _N), np.uint16)
    has = np.flatnonzero(np.diff(go))
    if len(has):
        h = (g >> np.uint64(32)).astype(np.uint32)
        for i in range(_N):
            least = np.minimum.reduceat(h * _A[i] + _B[i], go[has])
            out[has, i] = ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
    return out


def _sign():
    def fn(col: pa.Array) -> pa.Array:
        n, sig = [], []
        for _, _, buf, offs in text_chunks(col):
            g, go = shingles(buf, offs, WORDS)
            n.append(np.diff(go).astype(np.int32))
            sig += [row.tobytes() for row in signatures(g, go)]
        return pa.StructArray.from_arrays([pa.array(np.concatenate(n) if n else np.zeros(0, np.int32)),
                                           pa.array(sig, pa.binary())], ["n", "sig"])
    return fn


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by ``keys``, of about ``rows`` rows or one group."""
    held: list[pa.RecordBatch] = []

    def edges(t: pa.Table) -> np.ndarray:
        cols = [t.column(k).to_numpy() for k in keys]
        return np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        t = pa.Table.from_batches(held)
        cut = edges(t)
        if len(cut):
            yield t.slice(0, cut[-1])
            held = t.slice(cut[-1]).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def group_numbers(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, np.int64)
    for k in keys:
        c = t.column(k).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index in the component of each of ``n`` nodes under edges (a, b)."""
    label = np.arange(n)
    while len(a):
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def shared_prefixes(group: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Values that each row's path shares with the row before, -1 for the first of a group."""
    out = np.full(len(group), -1)
    if len(group) > 1:
        unlike = path[1:] != path[:-1]
        same = np.where(unlike.any(1), unlike.argmax(1), path.shape[1])
        out[1:] = np.where(group[1:] == group[:-1], same, -1)
    return out


def _alike(path: np.ndarray, rows: np.ndarray, heads: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows))
    for i in range(0, len(rows), 1 << 14):
        out[i:i + (1 << 14)] = (path[rows[i:i + (1 << 14)]] == path[heads[i:i + (1 << 14)]]).mean(1)
    return out


def _heads(number: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The first of ``rows`` with the same number, for each of them."""
    first = np.ones(len(rows), bool)
    first[1:] = number[rows][1:] != number[rows][:-1]
    return rows[first][np.cumsum(first) - 1]


def lead(group: np.ndarray, path: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Root of each row among the rows of its group, and the prefix length at which it stopped.

    Rows are sorted by group and path and share ``floor`` values within a group.
    """
    shared = shared_prefixes(group, path)
    stop = np.full(len(group), floor)
    live, leads = np.ones(len(group), bool), np.zeros(len(group), bool)
    a, b = [], []
    for depth in np.unique(shared[shared > floor])[::-1]:
        node = np.cumsum(shared < depth) - 1  # rows under the same prefix of this length
        branching = np.bincount(node, weights=shared == depth) > 0
        rows = np.flatnonzero(live & branching[node])
        head = _heads(node, rows)
        settled = (rows != head) & ~leads[rows]
        settled &= _alike(path, rows, head) >= SAME
        a.append(rows[settled])
        b.append(head[settled])
        live[rows[settled]] = False
        leads[head[settled]] = True
        stop[rows[settled]] = depth
    active = np.flatnonzero(live)
    while len(active):
        head = _heads(group, active)
        alike = _alike(path, active, head)
        joins = (alike >= LOOSE) & (active != head)
        a.append(active[joins])
        b.append(head[joins])
        active = active[((alike < NEAR) | leads[active]) & (active != head)]
    return (local_roots(len(group), np.concatenate(a), np.concatenate(b)) if a else np.zeros(0, np.int64)), stop


def _lead(keys: list[str], floor: int):
    """Rows (tid, root) of nodes with another root in their group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, keys, 4096):
            path = np.stack([np.frombuffer(x, np.uint16) for x in t.column("path").to_pylist()])
            tid = t.column("tid").to_numpy()
            root, _ = lead(group_numbers(t, keys), path, floor)
            out = np.flatnonzero(tid[root] != tid)
            yield pa.RecordBatch.from_arrays([pa.array(tid[out]), pa.array(tid[root][out])], ["tid", "root"])
    return run


def shared_counts(ids: np.ndarray, offs: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each text of ``left``: how many ids it shares with each text of ``right``.
    ``ids`` are small numbers, each at most once in a text."""
    size = np.diff(offs)
    back = np.concatenate([ids[offs[r]:offs[r + 1]] for r in right]) if len(right) else ids[:0]
    owner = np.repeat(np.arange(len(right)), size[right])
    order = np.argsort(back, kind="stable")
    owner = owner[order].astype(np.int32)
    top = int(ids.max()) + 2 if len(ids) else 1
    first = np.searchsorted(back[order], np.arange(top))
    for x in left:
        own = ids[offs[x]:offs[x + 1]]
        a, n = first[own], first[own + 1] - first[own]
        at = np.arange(n.sum()) + np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        yield x, np.bincount(owner[at], minlength=len(right))


def verify_group(tid: np.ndarray, copies: np.ndarray, block: np.ndarray, low: int, high: int, ids: np.ndarray,
                 offs: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked copies and the root (index) of each text, from all pairs between two blocks."""
    links, a, b = np.zeros(len(tid), np.int64), [], []
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    size = np.diff(offs)
    for x, n in shared_counts(ids, offs, left, right):
        ok = (n * (1 + threshold) >= threshold * (size[x] + size[right]) - 1e-9) & (n > 0)
        y = right[ok]
        y = y[y > x] if low == high else y
        links[x] += copies[y].sum()
        links[y] += copies[x]
        a.append(np.full(len(y), x))
        b.append(y)
    if not a:
        return links, np.arange(len(tid))
    return links, local_roots(len(tid), np.concatenate(a), np.concatenate(b))


def _verify(threshold: float):
    keys = ["comp", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, keys):
            number = group_numbers(t, keys)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [t.num_rows]])
            out = []
            for i, j in zip(cuts[:-1], cuts[1:]):
                part = t.slice(i, j - i)
                tid = part.column("tid").to_numpy()
                tid, at = np.unique(tid, return_index=True)  # a repeated row counts once
                part = part.take(pa.array(at)).combine_chunks()
                doc, g, n = [], [], 0
                for k, _, buf, offs in text_chunks(part.column("text").combine_chunks()):
                    h, ho = shingles(buf, offs, WORDS)
                    g.append(h)
                    doc.append(doc_index(ho) + k)
                ids = np.unique(np.concatenate(g), return_inverse=True)[1].astype(np.int64)
                width = int(ids.max()) + 1 if len(ids) else 1
                pair = np.unique(np.concatenate(doc) * width + ids)
                doc, ids = pair // width, pair % width
                links, root = verify_group(
                    tid, part.column("copies").to_numpy(), part.column("block").to_numpy(), part.column("low")[0].as_py(),
                    part.column("high")[0].as_py(), ids, np.searchsorted(doc, np.arange(len(tid) + 1)), threshold)
                hit = np.flatnonzero(links)
                out.append((tid[hit], links[hit], tid[root[hit]]))
            tid, links, root = (np.concatenate(c) for c in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(tid), pa.array(links), pa.array(root)], ["tid", "links", "root"])
    return run


def text_id(text: Column) -> Column:
    return F.when(text.isNotNull(), F.xxhash64(text))


def texts_and_classes(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tid) for each row, and (tid, class_id, copies, links, kept) for each
    different text; ``kept`` marks the one text that stands for its class."""
    src = docs.select("doc_id", "text", text_id(F.col("text")).alias("tid"))
    kind = StructType([StructField("n", IntegerType()), StructField("sig", BinaryType())])
    rows = scratch(batch_column(src, "text", ["doc_id", "tid"], "s", kind, _sign), "forest-rows")
    texts = scratch(rows.where("tid is not null").groupBy("tid").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("s.n").alias("n"),
        F.first("s.sig").alias("sig")), "forest-texts")

    d = floor_depth(threshold)
    buckets = F.array(*[F.xxhash64(F.lit(t), F.expr(f"substring(sig, {2 * DEPTH * t + 1}, {2 * d})")) for t in range(TREES)])
    keys = texts.where("n > 0").select("tid", F.posexplode(buckets).alias("tree", "bucket"))
    sizes = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    parts = F.when(F.col("members") > SALT_ROWS, F.ceil(F.col("members") * 32 / (SALT_ROWS * 15))).otherwise(F.lit(1)).cast("long")
    path = F.expr(f"concat(substring(sig, {2 * DEPTH} * tree + 1), substring(sig, 1, {2 * DEPTH} * tree))")
    inside = keys.join(sizes, "bucket").select("tid", "tree", "bucket", parts.alias("parts"), F.pmod(
        F.xxhash64("tid", F.lit(81)), parts).alias("part")).join(texts.select("tid", "sig"), "tid")
    others = F.when(F.col("parts") == 1, F.array(F.col("part"))).otherwise(
        F.array_remove(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), F.col("part")))
    met = inside.select("tid", "bucket", "part", F.explode(others).alias("other"), path.alias("path")).select(
        "bucket", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "tid", "path")
    three = ["bucket", "low", "high"]
    joined = scratch(met.repartition(*three).sortWithinPartitions(*three, "path", "tid").mapInArrow(
        _lead(three, d), "tid long, root long"), "forest-led").select(F.col("tid").alias("u"), F.col("root").alias("v"))
    likely = components(joined).select(F.col("node").alias("tid"), F.col("component").alias("comp"))

    members = likely.join(texts.select("tid", "rep", "copies", "n"), "tid")
    blocks = members.groupBy("comp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS),
                                                    F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    members = members.join(blocks, "comp").withColumn("block", F.pmod(F.xxhash64("tid", F.lit(82)), F.col("blocks")))
    m, s = members.alias("m"), src.alias("s")
    texted = s.join(m, (F.col("s.tid") == F.col("m.tid")) & F.col("s.doc_id").eqNullSafe(F.col("m.rep"))).select(
        "m.comp", "m.tid", "m.copies", "m.block", F.explode(F.sequence(F.lit(0), F.col("m.blocks") - 1)).alias("other"), "s.text")
    dealt = texted.select("comp", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                          "tid", "copies", "block", "text")
    verified = scratch(dealt.repartition("comp", "low", "high").sortWithinPartitions("comp", "low", "high").mapInArrow(
        _verify(threshold), "tid long, links long, root long"), "forest-links")
    grouped = components(verified.select(F.col("tid").alias("u"), F.col("root").alias("v"))).select(
        F.col("node").alias("tid"), "component")
    links = verified.groupBy("tid").agg(F.sum("links").alias("near"))
    all_texts = (texts.select("tid", "rep", "copies").join(grouped, "tid", "left").join(links, "tid", "left")
                 .select("tid", "rep", "copies", F.coalesce("component", "tid").alias("component"),
                         (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("links")))
    all_texts = scratch(all_texts, "forest-classes")
    heads = all_texts.groupBy("component").agg(F.min(F.struct(
        F.col("rep").isNull().alias("no_id"), F.col("rep"), F.col("tid"))).alias("head"))
    classes = all_texts.join(heads, "component").select(
        "tid", F.col("head.rep").alias("class_id"), "copies", "links", (F.col("tid") == F.col("head.tid")).alias("kept"))
    return rows.select("doc_id", "tid"), classes


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, class_id, copies, links), one for each row of ``docs``.

    ``class_id``: smallest id in the class of texts connected by links (null if it has
    none); ``copies``: rows with the very same text; ``links``: other rows whose text is the
    same or similar by the threshold. Null texts are alone (class_id is their own id);
    texts without a word are linked to equal texts only; texts under five words have one
    shingle. Repeated rows are copies. An empty table gives no rows.
    """
    rows, classes = texts_and_classes(docs, threshold)
    return rows.join(classes, "tid", "left").select(
        "doc_id", F.when(F.col("tid").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("copies"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the row with the smallest
    id stays (of repeated rows, one; a null id only where no row of the class has an id). Null
    texts all stay."""
    _, classes = texts_and_classes(docs, threshold)
    heads = classes.where("kept").select("tid", F.col("class_id").alias("head"))
    plain, (doc_id, text) = unnamed(docs, "doc_id", "text")
    d = plain.withColumn("tid", text_id(F.col(text)))
    one = d.where(F.col(text).isNotNull()).join(heads, "tid").where(F.col(doc_id).eqNullSafe(F.col("head")))
    one = one.dropDuplicates(["tid", "head"]).select(*plain.columns)
    return one.unionByName(plain.where(F.col(text).isNull())).toDF(*docs.columns)
