"""MinHash near-duplicates with SuperMinHash signatures.

A set's signature has ``SLOTS`` places. Each element deals a random permutation of them,
one place a step: in step ``j`` it offers ``j`` plus a random fraction to its next place,
and each place keeps its least offer. As offers of a step are above all of the step
before, a set is done with the first step that leaves no place open: long sets need one or
two steps for each element instead of ``SLOTS`` hashes. The places' values are negatively
correlated, so that the share of equal places estimates Jaccard with less variance than
independent MinHash values.

1. Rows with the same set are one node (64-bit hash of the set).
2. Bands of four places are buckets. Within a bucket nodes are joined by their estimates
   (single linkage at ``LOOSE``, well under the threshold). A bucket of many nodes is cut
   into blocks, and each pair of blocks is a group, so that every two of its nodes meet.
3. The joined nodes' components are verified on the full sets, read again from the texts.
   A component of up to a block is one group. Of a larger one, first its ``LEADERS`` most
   connected nodes are compared with each block; then only the nodes which no verified
   link has joined to the largest part are compared, in blocks, with all of its blocks.
   Within a group two nodes that verified links already join are not compared again
   (union-find): a component's links are not listed, and none between its parts is missed.
4. Components of the verified links are the groups of near duplicates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from forumlens.llm.common import LOWER, batch_column, doc_index, grams, mix, span_hashes, text_chunks, words
from forumlens.llm.lsh_forest import group_numbers, whole_groups
from forumlens.operators.components import components
from forumlens.sources.scratch import scratch

WORDS, THRESHOLD = 4, 0.8
SLOTS, BAND = 112, 4                    # a pair at 0.8 shares no band with probability 4e-7
LOOSE = 0.62                            # 4.8 standard deviations under 0.8 for independent places
BUCKET_ROWS = 8192                      # nodes of a bucket in a block
BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 1 << 20  # of a component in a block
LEADERS = 8
FILTER_WORDS = 1 << 18                  # rows of 64 bits in the filter of wanted texts
SIGN_BYTES = 1 << 19                    # of text whose elements deal their places together

_STEPS = np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes of ``n`` words (A-Z lower-cased), ascending, and their offsets;
    with fewer words, of all of them."""
    low = LOWER[buf]
    st, en, wo = words(low, offs)
    h = span_hashes(low, st, en)
    g, go = grams(h, wo, n)
    doc = doc_index(go)
    count = np.diff(wo)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = np.full(len(short), 0x51ED270B, np.uint64)
        for k in range(n - 1):
            has = count[short] > k
            whole[has] = whole[has] * np.uint64(0xD6E8FEB86659FD93) + h[wo[short][has] + k]
        g, doc = np.append(g, mix(whole)), np.append(doc, short)
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    g, doc = g[new], doc[new]
    return g, np.searchsorted(doc, np.arange(len(offs)))


def super_minhash(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(sets, SLOTS) 16-bit values; 0 for an empty set. ``h``: different elements by set."""
    n, slots = len(offs) - 1, SLOTS
    best = np.full(n * slots, ~np.uint64(0))
    is_open = np.ones(n * slots, bool)
    doc = doc_index(offs)
    perm = None
    for j in range(slots):
        if not len(doc):
            break
        r = mix(h + _STEPS[j])
        k = j + ((r & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        rows = np.arange(len(doc))
        place = k if perm is None else perm[rows, k].astype(np.int64)
        at = doc * slots + place
        free = is_open[at]
        np.minimum.at(best, at[free], r[free])
        is_open[at[free]] = False
        full = ~is_open.reshape(n, slots).any(1)
        stay = ~full[doc]
        if perm is None:
            perm = np.broadcast_to(np.arange(slots, dtype=np.uint8), (int(stay.sum()), slots)).copy()
        else:
            perm = perm[stay]
        h, doc, k = h[stay], doc[stay], k[stay]
        rows = np.arange(len(doc))
        perm[rows, k] = perm[:, j]  # the place dealt goes out of the rest
    out = (mix(best) >> np.uint64(48)).astype(np.uint16).reshape(n, slots)
    out[np.diff(offs) == 0] = 0
    return out


def _describe():
    def fn(col: pa.Array) -> pa.Array:
        n, sid, sig = [], [], []
        for _, _, buf, offs in text_chunks(col, SIGN_BYTES):
            g, go = shingle_sets(buf, offs)
            size = np.diff(go)
            total = np.append(np.zeros(1, np.uint64), np.cumsum(mix(g ^ np.uint64(0x3C79AC492BA7B653)), dtype=np.uint64))
            sid.append(mix(total[go[1:]] - total[go[:-1]] + size.astype(np.uint64)).astype(np.int64))
            n.append(size.astype(np.int64))
            sig += [row.tobytes() for row in super_minhash(g, go)]
        whole = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))
        return pa.StructArray.from_arrays([whole(n), whole(sid), pa.array(sig, pa.binary())], ["n", "sid", "sig"])
    return fn


class Union:
    """Union-find over rows by labels: joining relabels the smaller side."""

    def __init__(self, label: np.ndarray):
        self.label = label.copy()
        order = np.argsort(label, kind="stable")
        cuts = np.flatnonzero(np.diff(label[order])) + 1
        self.members = {int(label[part[0]]): [part] for part in np.split(order, cuts)} if len(label) else {}
        self.size = {k: len(v[0]) for k, v in self.members.items()}

    def join(self, a: int, others: np.ndarray) -> None:
        for b in np.unique(self.label[others]):
            x, y = int(self.label[a]), int(b)
            if x == y:
                continue
            if self.size[x] < self.size[y]:
                x, y = y, x
            for part in self.members[y]:
                self.label[part] = x
            self.members[x] += self.members.pop(y)
            self.size[x] += self.size.pop(y)

    def first(self) -> np.ndarray:
        """For each row the smallest row of its part."""
        least = {k: min(int(p.min()) for p in v) for k, v in self.members.items()}
        return np.array([least[int(k)] for k in self.label], np.int64)


def alike(sig: np.ndarray, x: int, ys: np.ndarray) -> np.ndarray:
    return (sig[ys] == sig[x]).sum(1)


def linkage(sig: np.ndarray, first: np.ndarray, second: np.ndarray, least: int) -> np.ndarray:
    """Smallest row in each row's part, of rows joined if ``least`` places agree between a row of
    ``first`` and one of ``second``."""
    union = Union(np.arange(len(sig)))
    for x in first:
        ys = second[union.label[second] != union.label[x]]
        for i in range(0, len(ys), 4096):
            part = ys[i:i + 4096]
            near = part[alike(sig, x, part) >= least]
            if len(near):
                union.join(int(x), near)
    return union.first()


def _join_bucket(keys: list[str]):
    """Rows (u, v) of a node and the first node of its part in the group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, keys, 4096):
            sid, block = t.column("sid").to_numpy(), t.column("block").to_numpy()
            low, high = t.column("low").to_numpy(), t.column("high").to_numpy()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(len(sid), -1)
            starts = np.flatnonzero(np.diff(group_numbers(t, keys), prepend=-1))
            size = np.diff(np.append(starts, len(sid)))
            root, least = np.arange(len(sid)), int(LOOSE * sig.shape[1])
            two = starts[(size == 2) & (low[starts] == high[starts])]
            two = two[(sig[two] == sig[two + 1]).sum(1) >= least]
            root[two + 1] = two
            for i, k in zip(starts[size > 2], size[size > 2]):
                g = np.arange(i, i + k)
                first, second = np.flatnonzero(block[g] == low[g[0]]), np.flatnonzero(block[g] == high[g[0]])
                root[g] = g[linkage(sig[g], first, second, least)]
            out = np.flatnonzero(sid[root] != sid)
            yield pa.RecordBatch.from_arrays([pa.array(sid[out]), pa.array(sid[root][out])], ["u", "v"])
    return run


def shared(ids: np.ndarray, offs: np.ndarray, x: int, ys: np.ndarray) -> np.ndarray:
    """How many ids row ``x`` shares with each of ``ys``."""
    own = ids[offs[x]:offs[x + 1]]
    size = offs[ys + 1] - offs[ys]
    ends = np.cumsum(size)
    at = np.arange(ends[-1]) + np.repeat(offs[ys] - (ends - size), size)
    place = np.minimum(np.searchsorted(own, ids[at]), len(own) - 1)
    return np.add.reduceat((own[place] == ids[at]).astype(np.int64), ends - size)


def link(ids: np.ndarray, offs: np.ndarray, sig: np.ndarray, label: np.ndarray, first: np.ndarray, second: np.ndarray,
         threshold: float) -> np.ndarray:
    """Smallest row in each row's part, where rows of a ``label`` are joined already and rows of
    ``first`` are joined to those of ``second`` if their sets are at least ``threshold`` alike."""
    union, size = Union(label), np.diff(offs)
    least = int(LOOSE * sig.shape[1])
    for x in first:
        ys = second[(union.label[second] != union.label[x])]
        ys = ys[(size[ys] >= threshold * size[x] - 1e-9) & (threshold * size[ys] <= size[x] + 1e-9)]
        for i in range(0, len(ys), 256):
            part = ys[i:i + 256]
            part = part[(union.label[part] != union.label[x])]
            part = part[alike(sig, x, part) >= least] if len(part) else part
            if len(part):
                n = shared(ids, offs, int(x), part)
                near = part[n * (1 + threshold) >= threshold * (size[x] + size[part]) - 1e-9]
                if len(near):
                    union.join(int(x), near)
    return union.first()


def _verify(keys: list[str], threshold: float):
    """Rows (u, v) of a node and the first node of its part, from groups of rows with columns
    ``low`` (block of the nodes to compare), ``high`` (block of those to compare them with),
    ``block`` (of the row), ``part`` (known part), ``rank``, ``sid`` and ``text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, keys):
            number = group_numbers(t, keys)
            for g in np.split(np.arange(t.num_rows), np.flatnonzero(np.diff(number)) + 1):
                rows = t.slice(g[0], len(g)).combine_chunks()
                # A node may stand on both sides: one row.
                sid, at, same = np.unique(rows.column("sid").to_numpy(), return_index=True, return_inverse=True)
                block = rows.column("block").to_numpy()
                low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
                left, right = np.unique(same[block == low]), np.unique(same[block == high])
                if not len(left) or not len(right):
                    continue
                one = rows.take(pa.array(at)).combine_chunks()
                sets, sizes, sig = [], [], []
                for _, _, buf, offs in text_chunks(one.column("text").combine_chunks(), SIGN_BYTES):
                    s, so = shingle_sets(buf, offs)
                    sets.append(s)
                    sizes.append(np.diff(so))
                    sig.append(super_minhash(s, so))
                ids, offs = np.concatenate(sets), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
                part = np.unique(one.column("part").to_numpy(), return_inverse=True)[1]
                rank = one.column("rank").to_numpy()
                left = left[np.argsort(-rank[left], kind="stable")]
                root = link(ids, offs, np.concatenate(sig), part, left, right, threshold)
                out = np.flatnonzero(sid[root] != sid)
                yield pa.RecordBatch.from_arrays([pa.array(sid[out]), pa.array(sid[root][out])], ["u", "v"])
    return run


def _likely(nodes: DataFrame) -> DataFrame:
    """(sid, comp, rank): nodes joined by estimates; ``rank`` is the sum of their buckets' sizes."""
    width = 2 * BAND
    buckets = F.array(*[F.xxhash64(F.lit(b), F.expr(f"substring(sig, {width * b + 1}, {width})"))
                        for b in range(SLOTS // BAND)])
    keys = nodes.where("n > 0").select("sid", F.explode(buckets).alias("bucket"))
    sizes = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    inside = scratch(keys.join(sizes, "bucket"), "super-buckets")
    rank = inside.groupBy("sid").agg(F.sum("members").alias("rank"))
    blocks = F.ceil(F.col("members") / BUCKET_ROWS)
    dealt = inside.select("sid", "bucket", blocks.alias("blocks"), F.pmod(F.xxhash64("sid", F.lit(131)), blocks).alias("block"))
    dealt = dealt.join(nodes.select("sid", "sig"), "sid").select(
        "sid", "sig", "bucket", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    met = dealt.select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                       "block", "sid", "sig")
    keys = ["bucket", "low", "high"]
    joined = scratch(met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_join_bucket(keys), "u long, v long"),
                     "super-joined")
    likely = components(joined).select(F.col("node").alias("sid"), F.col("component").alias("comp"))
    return likely.join(rank, "sid")


def _wanted(docs: DataFrame, tids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``tid`` may be in ``tids``, so that only few texts travel.

    A filter of hashed bits, of a fixed size (at most ``FILTER_WORDS`` rows, hence the
    broadcast); when very many texts are wanted it fills up and lets more pass.
    """
    h = F.xxhash64("tid", F.lit(134))
    word, bit = F.pmod(h, F.lit(FILTER_WORDS)), F.pmod(F.shiftright(h, 32), F.lit(64)).cast("int")
    flag = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    words = tids.select(word.alias("word"), flag.alias("flag")).groupBy("word").agg(F.bit_or("flag").alias("flags"))
    tagged = docs.withColumn("word", word).join(F.broadcast(words), "word")
    return tagged.where(F.col("flags").bitwiseAND(flag) != 0).select(*docs.columns)


def _links(docs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Edges (u, v) whose components are those of all links between sets."""
    members = _likely(nodes).join(nodes.select("sid", "n", "rep", "tid"), "sid")
    sizes = members.groupBy("comp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS),
                                                   F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    members = scratch(members.join(sizes, "comp").withColumn("block", F.pmod(F.xxhash64("sid", F.lit(132)), F.col("blocks"))),
                      "super-members")
    m, d = members.alias("m"), _wanted(docs, members.select("tid")).alias("d")
    texts = scratch(d.join(m, (F.col("d.tid") == F.col("m.tid")) & F.col("d.doc_id").eqNullSafe(F.col("m.rep"))).select(
        "m.comp", "m.sid", "m.rank", "m.blocks", "m.block", "d.text").dropDuplicates(["sid"]), "super-texts")
    keys = ["comp", "low", "high"]
    kind = "u long, v long"

    def verified(rows: DataFrame) -> DataFrame:
        return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_verify(keys, threshold), kind)

    zero = F.lit(0).cast("long")
    small = texts.where("blocks = 1").select("comp", zero.alias("low"), zero.alias("high"), "block",
                                             F.col("sid").alias("part"), "rank", "sid", "text")
    found = scratch(verified(small), "super-small")
    large = texts.where("blocks > 1")
    if large.isEmpty():
        return found

    def every(seq_from: str) -> Column:
        return F.explode(F.sequence(zero, F.col("blocks") - 1)).alias(seq_from)

    # Block -1: the leaders.
    lead = large.join(_leaders(large), ["comp", "sid"], "left_semi").select(
        "comp", F.lit(-1).cast("long").alias("low"), every("high"), F.lit(-1).cast("long").alias("block"),
        F.col("sid").alias("part"), "rank", "sid", "text")
    rest = large.select("comp", F.lit(-1).cast("long").alias("low"), F.col("block").alias("high"), "block",
                        F.col("sid").alias("part"), "rank", "sid", "text")
    starred = scratch(verified(lead.unionByName(rest)), "super-starred")

    # What the leaders' links leave outside a component's largest part is compared with all of it.
    known = components(starred).select(F.col("node").alias("sid"), F.col("component").alias("part"))
    parted = scratch(large.select("comp", "sid").join(known, "sid", "left").select(
        "comp", "sid", F.coalesce("part", "sid").alias("part")), "super-parts")
    by_part = parted.groupBy("comp", "part").agg(F.count(F.lit(1)).alias("size"))
    main = by_part.groupBy("comp").agg(F.max(F.struct("size", "part")).alias("top")).select("comp", F.col("top.part").alias("main"))
    outside = scratch(parted.join(main, "comp").where("part <> main").select("comp", "sid", "part"), "super-outside")
    with_part = large.join(parted.select("sid", "part"), "sid")
    out_blocks = outside.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS).alias("out_blocks"))
    asked = with_part.join(outside.select("sid"), "sid", "left_semi").join(out_blocks, "comp")
    low = -1 - F.pmod(F.xxhash64("sid", F.lit(133)), F.col("out_blocks"))
    asked = asked.select("comp", low.alias("low"), every("high"), low.alias("block"), "part", "rank", "sid", "text")
    against = with_part.join(out_blocks, "comp").select(
        "comp", F.explode(F.sequence(-F.col("out_blocks"), F.lit(-1).cast("long"))).alias("low"),
        F.col("block").alias("high"), "block", "part", "rank", "sid", "text")
    crossed = scratch(verified(asked.unionByName(against)), "super-crossed")
    return found.unionByName(starred).unionByName(crossed)


def _leaders(large: DataFrame) -> DataFrame:
    """(comp, sid) of the nodes of a component with the most company in their buckets."""
    n = F.row_number().over(Window.partitionBy("comp").orderBy(F.desc("rank"), "sid"))
    return large.select("comp", "sid", "rank").withColumn("_n", n).where(F.col("_n") <= LEADERS).select("comp", "sid")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of (doc_id, text).

    A text's set holds its distinct 4-word shingles (A-Z lower-cased); with fewer words, all
    of them as one; null texts and texts without words have none, and are alone
    (component_id is their own id, kept). ``component_id``: the smallest id that links of at
    least ``threshold`` reach; ``kept``: it is the row's own. Repeated rows are copies, and a
    null id is never the smallest (a component without any id has null, and its rows are
    kept). An empty table gives no rows. Sets are told apart by 64-bit hashes.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = StructType([StructField("n", LongType()), StructField("sid", LongType()), StructField("sig", BinaryType())])
    tagged = src.withColumn("tid", F.xxhash64("text"))
    rows = scratch(batch_column(tagged, "text", ["doc_id", "tid"], "s", kind, _describe), "super-rows")
    rows = rows.select("doc_id", "tid", "s.*")
    nodes = rows.where("n > 0").groupBy("sid").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tid")).alias("rep"),
        F.first("n").alias("n"), F.first("sig").alias("sig"))
    nodes = scratch(nodes.select("sid", "n", "sig", F.col("rep.doc_id").alias("rep"), F.col("rep.tid").alias("tid")), "super-nodes")
    grouped = components(_links(tagged, nodes, threshold)).select(F.col("node").alias("sid"), "component")
    of_node = nodes.select("sid", "rep").join(grouped, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    least = of_node.groupBy("component").agg(F.min("rep").alias("component_id"))
    names = scratch(of_node.join(least, "component").select("sid", "component_id"), "super-names")
    got = rows.select("doc_id", "n", "sid").join(names, "sid", "left")
    name = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return got.select("doc_id", F.col("n").alias("n_shingles"), name.alias("component_id"),
                      F.col("doc_id").eqNullSafe(name).alias("kept"))
