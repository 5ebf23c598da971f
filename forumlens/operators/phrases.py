"""Phrase learning and merging.

* D5 counts unigrams and adjacent pairs with partial aggregation (hot pairs
  collapse map-side), keeps pairs with count >= min_count, and scores them by
  normalised PMI: ln(p(ab) / (p(a) p(b))) / -ln p(ab), p(x) = count / N, N the
  total token count; a pair is a phrase when its score > threshold. Most pairs
  occur once, so they are first counted by a hash (:func:`reachable`), and only pairs
  whose hash reaches min_count are shuffled; a hash counts at least what each of its pairs does,
  so none is lost.
* D6 merges greedily left to right: inside a run of consecutive positions whose
  adjacent pair is a phrase, the scan takes the 1st, 3rd, 5th ..., and the taken
  pairs replace their two tokens. A phrase table of up to ``IN_ROW_PHRASES`` rows goes to
  the executors and a document is merged in its row, without a shuffle; with a larger one
  pairs are flagged by a semi-join and runs found by windows.
* D7 chains passes: pass i learns on the output of pass i-1 (the intended
  behaviour; see README), with a reliable checkpoint between passes.
* D8 extends the raw tokens with the merged tokens of pass i that join exactly
  i+1 words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forumlens.sources.scratch import scratch

# Phrase defaults and the joining character.
MIN_COUNT = 20
THRESHOLD = 0.05
DELIM = "_"

IN_ROW_PHRASES = 1 << 21     # phrases that are sent to the executors, at most
CELL_BITS = 16               # counters in a block
MIN_BITS, MAX_BITS = 16, 26  # counters in all: 64 MB a task and 16 MB of broadcast bits at most


def _pairs(tokens: DataFrame, doc_col: str = "ord_key") -> DataFrame:
    """(doc, i, a, b) for every adjacent pair, computed in-row."""
    t = F.col("tokens")
    n = F.size(t)
    arr = F.when(n >= 2, F.transform(F.sequence(F.lit(0), n - 2),
                                     lambda i: F.struct(t[i].alias("a"), t[i + 1].alias("b"))))
    return (tokens.select(doc_col, F.posexplode_outer(arr).alias("i", "p"))
            .filter(F.col("p").isNotNull())
            .select(doc_col, "i", F.col("p.a").alias("a"), F.col("p.b").alias("b")))


def _cell(bits: int) -> Column:
    return F.xxhash64("a", "b").bitwiseAND(F.lit((1 << bits) - 1))


def _count_cells(bits: int, top: int):
    """Rows (block, counters) of a task's cells, one byte a counter, none over ``top``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << bits, np.uint8)
        for b in batches:
            at, n = np.unique(b.column("cell").to_numpy(), return_counts=True)
            cells[at] = np.minimum(cells[at] + n, top)
        blocks = cells.reshape(-1, 1 << CELL_BITS)
        for i in np.flatnonzero(blocks.any(1)):
            yield pa.RecordBatch.from_arrays([pa.array([int(i)]), pa.array([blocks[i].tobytes()], pa.binary())],
                                             ["block", "counters"])
    return run


def _passing_words(top: int):
    """Rows (word, bits): the cells that reach ``top`` over all rows of a block (sorted by it)."""
    def words(block: int, total: np.ndarray) -> pa.RecordBatch:
        bits = np.packbits(total >= top, bitorder="little").view(np.int64)
        at = np.flatnonzero(bits)
        return pa.RecordBatch.from_arrays([pa.array(block * (len(total) // 64) + at), pa.array(bits[at])], ["word", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, None
        for b in batches:
            for k, counters in zip(b.column("block").to_pylist(), b.column("counters")):
                if k != block:
                    if block is not None:
                        yield words(block, total)
                    block, total = k, np.zeros(1 << CELL_BITS, np.int64)
                total = np.minimum(total + np.frombuffer(counters.as_py(), np.uint8), top)
        if block is not None:
            yield words(block, total)
    return run


def reachable(pairs: DataFrame, min_count: int, n_pairs: int) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose hash counts at least ``min_count`` (up to 255).

    Each task counts its pairs in an array of fixed size and sends its blocks; their sums
    leave one bit a counter, broadcast in at most 2 ** (MAX_BITS - 6) rows. There are about as many
    counters as pairs up to the bound; with far more pairs fewer rows fall away, none wrongly.
    """
    top = min(min_count, 255)
    bits = min(MAX_BITS, max(MIN_BITS, int(n_pairs).bit_length()))
    counted = pairs.select(_cell(bits).alias("cell")).mapInArrow(_count_cells(bits, top), "block long, counters binary")
    passing = scratch(counted.repartition("block").sortWithinPartitions("block").mapInArrow(
        _passing_words(top), "word long, bits long"), "phrase-cells")
    cell = pairs.withColumn("cell", _cell(bits)).withColumn("word", F.shiftright("cell", 6))
    return cell.join(F.broadcast(passing), "word").where(
        F.expr("getbit(bits, cast(cell & 63 as int)) = 1")).select(*pairs.columns)


def learn_phrases(tokens: DataFrame, min_count: int = MIN_COUNT, threshold: float = THRESHOLD,
                  doc_col: str = "ord_key") -> DataFrame:
    """Phrase table (a, b, n_ab, n_a, n_b, score) of pairs that pass. ``tokens`` is read
    four times: a written table is best."""
    uni = (tokens.select(F.explode_outer("tokens").alias("t")).filter(F.col("t").isNotNull())
           .groupBy("t").agg(F.count(F.lit(1)).alias("n")))
    n_total = tokens.select(F.sum(F.greatest(F.size("tokens"), F.lit(0)))).first()[0] or 0
    every = _pairs(tokens, doc_col).select("a", "b")
    likely = reachable(every, min_count, n_total) if min_count > 1 else every
    pairs = (likely.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_ab"))
             .filter(F.col("n_ab") >= min_count))
    ua = uni.select(F.col("t").alias("a"), F.col("n").alias("n_a"))
    ub = uni.select(F.col("t").alias("b"), F.col("n").alias("n_b"))
    j = pairs.join(ua, "a").join(ub, "b")
    pab = F.col("n_ab") / n_total
    pa = F.col("n_a") / n_total
    pb = F.col("n_b") / n_total
    score = F.log(pab / (pa * pb)) / (-F.log(pab))
    return j.select("a", "b", "n_ab", "n_a", "n_b", score.alias("score")).filter(F.col("score") > threshold)


def apply_phrases(tokens: DataFrame, phrases: DataFrame, doc_col: str = "ord_key", most: int = IN_ROW_PHRASES) -> DataFrame:
    """Greedy left-to-right merge of phrase pairs into ``a_b`` tokens.

    Up to ``most`` phrases (they are counted) go to the executors and each document is merged in
    its row; with more, and for documents that share their key, the pairs are joined.
    Documents without a key stay as they are."""
    pairs = phrases.select("a", "b").distinct()
    if pairs.limit(most + 1).count() > most:
        return _merge_by_joins(tokens, phrases, doc_col)
    alone, shared = _by_key(tokens, doc_col)
    merged = _merge_in_row(alone, pairs, doc_col)
    return merged if shared is None else merged.unionByName(_merge_by_joins(shared, phrases, doc_col))


def _by_key(tokens: DataFrame, doc_col: str) -> tuple[DataFrame, DataFrame | None]:
    """Documents with a key of their own or none, and those that share one (None without any)."""
    again = scratch(tokens.where(F.col(doc_col).isNotNull()).groupBy(doc_col).agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") > 1).select(doc_col), "phrase-repeated")
    if again.isEmpty():
        return tokens, None
    return (tokens.join(again, doc_col, "left_anti").select(*tokens.columns),
            tokens.join(again, doc_col, "left_semi").select(*tokens.columns))


def _merge_in_row(tokens: DataFrame, pairs: DataFrame, doc_col: str, tokens_col: str = "tokens") -> DataFrame:
    t = pairs.toArrow().combine_chunks()  # counted
    words = pa.chunked_array([*t.column("a").chunks, *t.column("b").chunks], pa.string()).unique()
    first, second = (pc.index_in(t.column(c), value_set=words).to_numpy().astype(np.int64) for c in ("a", "b"))
    shared = tokens.sparkSession.sparkContext.broadcast((words, np.sort(first * max(1, len(words)) + second)))
    place = tokens.columns.index(tokens_col)
    key = tokens.columns.index(doc_col)

    def merge(batch: pa.RecordBatch) -> pa.Array:
        words, known = shared.value
        lists = batch.column(place)
        flat = lists.flatten()
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        end = np.cumsum(size)
        code = pc.fill_null(pc.index_in(flat, value_set=words.cast(flat.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        inner = (code[:-1] >= 0) & (code[1:] >= 0)  # pairs within a document that has a key
        last = end[(size > 0) & (end < len(flat))] - 1
        inner[last] = False
        keyless = np.repeat(pc.is_null(batch.column(key)).to_numpy(zero_copy_only=False), size)
        at = np.flatnonzero(inner & ~keyless[:-1])
        pair = code[at] * max(1, len(words)) + code[at + 1]
        found = np.searchsorted(known, pair)
        at = at[known[np.minimum(found, len(known) - 1)] == pair] if len(known) else at[:0]
        start = np.maximum.accumulate(np.where(np.r_[True, np.diff(at) > 1], at, 0)) if len(at) else at
        at = at[(at - start) % 2 == 0]  # the 1st, 3rd, 5th ... of a run
        taken, gone = np.zeros(len(flat), bool), np.zeros(len(flat), bool)
        taken[at], gone[at + 1] = True, True
        merged = pc.binary_join_element_wise(flat.take(pa.array(at)), flat.take(pa.array(at + 1)), pa.scalar(DELIM, flat.type))
        flat = pc.replace_with_mask(flat, pa.array(taken), merged).filter(pa.array(~gone))
        offs = np.r_[0, end] - np.r_[0, np.cumsum(gone)][np.r_[0, end]]
        return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), flat.cast(pa.string()),
                                        mask=pc.is_null(lists) if lists.null_count else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cols = batch.columns
                yield pa.RecordBatch.from_arrays([*cols[:place], merge(batch), *cols[place + 1:]], batch.schema.names)

    return tokens.mapInArrow(run, tokens.schema)


def _merge_by_joins(tokens: DataFrame, phrases: DataFrame, doc_col: str) -> DataFrame:
    keep = [c for c in tokens.columns if c != "tokens"]
    flagged = _pairs(tokens, doc_col).join(phrases.select("a", "b"), ["a", "b"], "left_semi")
    w = Window.partitionBy(doc_col).orderBy("i")
    runs = flagged.withColumn("grp", F.col("i") - F.row_number().over(w))
    w2 = Window.partitionBy(doc_col, "grp")
    taken = (runs.withColumn("start", F.min("i").over(w2))
             .filter(F.pmod(F.col("i") - F.col("start"), F.lit(2)) == 0)
             .select(doc_col, "i", F.concat_ws(DELIM, "a", "b").alias("merged")))
    touched = taken.select(doc_col).distinct()
    # Documents without a taken pair keep their tokens unchanged.
    untouched = tokens.join(touched, doc_col, "left_anti")
    ex = (tokens.join(touched, doc_col, "left_semi")
          .select(*keep, F.posexplode("tokens").alias("j", "t")))
    firsts = taken.select(doc_col, F.col("i").alias("j"), "merged")
    seconds = taken.select(doc_col, (F.col("i") + 1).alias("j"))
    out = (ex.join(seconds, [doc_col, "j"], "left_anti").join(firsts, [doc_col, "j"], "left")
           .select(*keep, "j", F.coalesce("merged", "t").alias("t")))
    regrouped = out.groupBy(*keep).agg(F.sort_array(F.collect_list(F.struct("j", "t"))).alias("e"))
    merged = regrouped.select(*keep, F.transform("e", lambda x: x["t"]).alias("tokens"))
    return untouched.unionByName(merged)


def n_joined(t):
    """Number of words joined in a token (underscores + 1)."""
    return F.size(F.split(t, DELIM))


def phrase_passes(tokens: DataFrame, nr_grams: int, min_count: int = MIN_COUNT,
                  threshold: float = THRESHOLD, doc_col: str = "ord_key",
                  train_filter=None, checkpoint: bool = True, checkpoint_input: bool = True):
    """``nr_grams - 1`` chained passes. Returns (list of phrase tables,
    list of merged token frames, one per pass). Each pass learns on the
    training documents of the previous pass's output."""
    train_filter = train_filter if train_filter is not None else (F.col("ml_tag") == 0)
    cur = scratch(tokens, "phrase-input") if checkpoint and checkpoint_input else tokens
    tables, merged = [], []
    for _ in range(nr_grams - 1):
        ph = learn_phrases(cur.filter(train_filter), min_count, threshold, doc_col)
        if checkpoint:
            ph = scratch(ph, "phrases")
        cur = apply_phrases(cur, ph, doc_col)
        if checkpoint:
            cur = scratch(cur, "phrase-tokens")
        tables.append(ph)
        merged.append(cur)
    return tables, merged


def extend_tokens(tokens: DataFrame, merged_passes, doc_col: str = "ord_key") -> DataFrame:
    """Raw tokens + merged tokens of pass i joining exactly i+2 words."""
    out = tokens
    for i, m in enumerate(merged_passes):
        extra = m.select(doc_col, F.filter("tokens", lambda t: n_joined(t) == i + 2).alias(f"x{i}"))
        out = out.join(extra, doc_col, "left")
    cols = [F.col("tokens")] + [F.coalesce(F.col(f"x{i}"), F.array().cast("array<string>"))
                                for i in range(len(merged_passes))]
    return out.select(*[c for c in tokens.columns if c != "tokens"], F.concat(*cols).alias("tokens"))


def extend_by_phrases(tokens: DataFrame, tables: list[DataFrame], doc_col: str = "ord_key",
                      most: int = IN_ROW_PHRASES) -> DataFrame:
    """D6 + D8 for the phrase tables of the passes: the raw tokens and the merged tokens of pass i joining exactly
    i+2 words. The passes are merged one after another in the row, as in :func:`apply_phrases`."""
    pairs = [t.select("a", "b").distinct() for t in tables]
    if any(p.limit(most + 1).count() > most for p in pairs):
        return _extend_by_joins(tokens, tables, doc_col, most)
    alone, shared = _by_key(tokens, doc_col)
    cur = alone.withColumn("merged", F.col("tokens"))
    none = F.array().cast("array<string>")
    for i, p in enumerate(pairs):
        joined = F.filter("merged", lambda t: n_joined(t) == i + 2)  # noqa: B023
        cur = _merge_in_row(cur, p, doc_col, "merged").withColumn(
            f"x{i}", F.when(F.col(doc_col).isNotNull(), F.coalesce(joined, none)).otherwise(none))
    out = cur.select(*[F.concat("tokens", *[f"x{i}" for i in range(len(pairs))]).alias(c) if c == "tokens" else c
                       for c in tokens.columns])
    return out if shared is None else out.unionByName(_extend_by_joins(shared, tables, doc_col, most))


def _extend_by_joins(tokens: DataFrame, tables: list[DataFrame], doc_col: str, most: int) -> DataFrame:
    merged, cur = [], tokens
    for t in tables:
        cur = scratch(apply_phrases(cur, t, doc_col, most), "phrase-tokens")
        merged.append(cur)
    return extend_tokens(tokens, merged, doc_col)


def extended_tokens(tokens: DataFrame, nr_grams: int, min_count: int = MIN_COUNT,
                    threshold: float = THRESHOLD, doc_col: str = "ord_key") -> DataFrame:
    """D5-D8 end to end: the token lists the dictionary and BoW steps use."""
    if nr_grams <= 1:
        return tokens
    base = scratch(tokens, "phrase-input")  # tokenized once, read by every pass
    tables, _ = phrase_passes(base, nr_grams, min_count, threshold, doc_col, checkpoint_input=False)
    return extend_by_phrases(base, tables, doc_col)
