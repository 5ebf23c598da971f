"""Tokens, dictionary, bag of words and term-frequency reports.

Plan shape at scale:
* tokenization and per-document counting stay inside the row (no shuffle);
* the dictionary is one partial-aggregated ``groupBy(token)`` (hot tokens
  collapse map-side, so a token present in a third of all documents is one row
  per partition before the shuffle);
* the dictionary keeps every token unless the caller asks for the ``keep_n`` most
  frequent; ids come from a distributed sort, and how it is joined is left to AQE;
* a bag of words is made in its row; only tokens beyond the most frequent are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from forumlens.functions.text import tokenize, with_run_lengths
from forumlens.operators.assort import with_dense_index
from forumlens.sources.scratch import scratch

KEY_COLS = ("post_id", "ord_key", "ml_tag")
IN_ROW_TOKENS = 1 << 20  # a lemma table of up to so many rows is broadcast
BAG_TOKENS = 1 << 22     # tokens of a dictionary that are sent to the executors, at most (about 100 MB)


def tokens_frame(posts: DataFrame, text_col: str = "text", to_lower_case: bool = True,
                 stop_words=None, own_stop_words=None, lemmas: DataFrame | None = None,
                 key_cols=KEY_COLS) -> DataFrame:
    """D1-D4 over a post frame -> key columns + ``tokens array<string>``.

    ``lemmas`` (token, lemma) is an optional user table (D2; of several lemmas of a token the
    least counts). Only a document's different tokens meet it, by a broadcast while it has at most
    ``IN_ROW_TOKENS`` rows; those with a lemma come back as a map and are replaced in the row.
    """
    keys = [c for c in key_cols if c in posts.columns]
    if lemmas is None:
        return posts.select(*keys, tokenize(text_col, to_lower_case, stop_words, own_stop_words).alias("tokens"))
    # Lemmatize before the stop-word filter: tokenize without stop words first.
    raw = posts.select(*keys, tokenize(text_col, to_lower_case, stop_words=()).alias("tokens"))
    lem = lemmas.groupBy("token").agg(F.min("lemma").alias("lemma")).where("lemma is not null")
    lem = F.broadcast(lem) if lem.count() <= IN_ROW_TOKENS else lem
    hits = (raw.select(*[F.col(c).alias(f"__{c}") for c in keys], F.explode(F.array_distinct("tokens")).alias("token"))
            .join(lem, "token").groupBy(*[f"__{c}" for c in keys])
            .agg(F.map_from_entries(F.collect_set(F.struct("token", "lemma"))).alias("__lemmas")))
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    grouped = raw.join(hits, same, "left")
    toks = F.transform("tokens", lambda t: F.coalesce(F.try_element_at(F.col("__lemmas"), t), t))
    from forumlens.functions.text import default_stop_words
    stops = list(default_stop_words() if stop_words is None else stop_words) + list(own_stop_words or [])
    if stops:
        toks = F.filter(toks, lambda t: ~t.isin(stops))
    return grouped.select(*keys, toks.alias("tokens"))


def doc_term_counts(tokens: DataFrame, key_cols=KEY_COLS) -> DataFrame:
    """Distinct (document, token) rows with in-document counts; computed in-row."""
    keys = [c for c in key_cols if c in tokens.columns]
    bag = with_run_lengths(tokens.select(*keys, "tokens"), "tokens", "bag")
    # explode_outer + null filter: a plain explode makes the optimizer infer a
    # size(bag) > 0 filter and push it below the projections, which would inline
    # the sort into the per-element lambdas (quadratic per document).
    return (bag.select(*keys, F.explode_outer("bag").alias("e"))
            .filter(F.col("e").isNotNull())
            .select(*keys, F.col("e.token").alias("token"), F.col("e.cnt").alias("cnt")))


def kept_tokens(tokens: DataFrame, no_below: int = 1, no_above: float = 1.0, doc_col: str = "ord_key",
                train_only: bool = True) -> DataFrame:
    """(token, df, cf, first_doc) of the tokens of the training documents that pass the limits."""
    train = tokens.filter(F.col("ml_tag") == 0) if train_only and "ml_tag" in tokens.columns else tokens
    n_docs = train.select(F.count(F.lit(1))).scalar()
    per_token = (doc_term_counts(train, (doc_col,))
                 .groupBy("token")
                 .agg(F.count(F.lit(1)).alias("df"), F.sum("cnt").alias("cf"),
                      F.min(doc_col).alias("first_doc")))
    return per_token.filter((F.col("df") >= no_below) & (F.col("df") <= F.floor(F.lit(float(no_above)) * n_docs)))


def build_vocabulary(tokens: DataFrame, no_below: int = 1, no_above: float = 1.0,
                     keep_n: int | None = None, doc_col: str = "ord_key",
                     train_only: bool = True) -> DataFrame:
    """D9+D10: dictionary over training documents (``ml_tag = 0``).

    Returns token, token_id, df (documents), cf (occurrences).
    Ids follow first-seen document, then alphabetical order inside a document;
    kept tokens satisfy ``no_below <= df <= floor(no_above * n_docs)``; then the
    ``keep_n`` most frequent by df (ties by id order) survive, if it is given, and
    ids are compacted in id order.
    """
    kept = kept_tokens(tokens, no_below, no_above, doc_col, train_only)
    if keep_n is not None:
        # Distributed top-k (TakeOrderedAndProject): bounded by keep_n rows.
        kept = kept.orderBy(F.col("df").desc(), "first_doc", "token").limit(keep_n)
        w = Window.orderBy("first_doc", "token")
        return kept.select("token", (F.row_number().over(w) - 1).cast("int").alias("token_id"),
                           "df", "cf", "first_doc")
    return with_dense_index(kept, ["first_doc", "token"], "token_id").select(
        "token", F.col("token_id").cast("int"), "df", "cf", "first_doc")


def bag_of_words(tokens: DataFrame, vocab: DataFrame, key_cols=KEY_COLS, most: int = BAG_TOKENS) -> DataFrame:
    """Per document ``keys`` (ascending ids), ``values`` (counts),
    ``key_tokens``; unknown tokens dropped; documents without known tokens keep
    empty arrays. Applied to every split.

    A dictionary of up to ``most`` tokens (it is counted) goes to the executors, and each
    bag is made in its own row, without a shuffle. Of a larger one the most frequent tokens
    do; only what a document has besides them is joined by token."""
    if vocab.select("token", "token_id").limit(most + 1).count() <= most:
        return _bags_in_row(tokens, vocab, key_cols)
    return _bags_in_two_parts(tokens, vocab, key_cols, most)


def frequent(vocab: DataFrame, most: int) -> Column:
    """A condition on ``df`` that holds for the most frequent tokens, ``most`` of them at most.

    They are counted in steps of an eighth of a doubling of ``df``; a step is in or out as a whole."""
    step = F.floor(8 * F.log2(F.col("df").cast("double")))
    n, least = 0, None
    for r in vocab.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("s").desc()).collect():  # < 512
        n += r["n"]
        if n > most:
            break
        least = r["s"]
    return F.lit(False) if least is None else step >= least


def _bags_in_row(tokens: DataFrame, vocab: DataFrame, key_cols, rest: bool = False) -> DataFrame:
    """With ``rest`` also the other tokens and their counts, as ``rest`` (token, cnt)."""
    known = vocab.select("token", F.col("token_id").cast("int").alias("token_id")).orderBy("token_id").toArrow()  # counted
    shared = tokens.sparkSession.sparkContext.broadcast((known.column("token").combine_chunks(),
                                                         known.column("token_id").to_numpy()))
    src = tokens.select(*[c for c in key_cols if c in tokens.columns], "tokens")
    out = StructType([*src.schema.fields[:-1], StructField("keys", ArrayType(IntegerType())),
                      StructField("values", ArrayType(LongType())), StructField("key_tokens", ArrayType(StringType()))])
    if rest:
        out = StructType([*out.fields, StructField("rest_tokens", ArrayType(StringType())), StructField("rest_counts", ArrayType(LongType()))])

    def counted(doc: np.ndarray, code: np.ndarray, codes: int, rows: int):
        """Offsets by row, codes and counts of the different (row, code)."""
        key, count = np.unique(doc * max(1, codes) + code, return_counts=True)
        offs = pa.array(np.searchsorted(key // max(1, codes), np.arange(rows + 1)), pa.int32())
        return offs, key % max(1, codes), pa.array(count, pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ids = shared.value
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            flat = lists.flatten()
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            place = pc.fill_null(pc.index_in(flat, value_set=names.cast(flat.type)), -1).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(batch.num_rows), size)
            hit = place >= 0
            offs, at, count = counted(doc[hit], place[hit], len(ids), batch.num_rows)
            lists = [pa.ListArray.from_arrays(offs, v) for v in (
                pa.array(ids[at], pa.int32()), count, names.take(pa.array(at)).cast(pa.string()))]
            if rest:
                left = ~hit & pc.is_valid(flat).to_numpy(zero_copy_only=False)
                words = flat.filter(pa.array(left)).dictionary_encode()
                offs, at, count = counted(doc[left], words.indices.to_numpy(), len(words.dictionary), batch.num_rows)
                lists += [pa.ListArray.from_arrays(offs, v) for v in (words.dictionary.take(pa.array(at)).cast(pa.string()), count)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *lists], out.names)

    return src.mapInArrow(run, out)


def _bags_in_two_parts(tokens: DataFrame, vocab: DataFrame, key_cols, most: int) -> DataFrame:
    """The bags of the most frequent tokens are made in the rows; the others' entries meet the
    rest of the dictionary and come back to their row by a number given to it."""
    keys = [c for c in key_cols if c in tokens.columns]
    vocab = vocab if "df" in vocab.columns else vocab.withColumn("df", F.lit(1))
    often = frequent(vocab, most)
    rows = scratch(_bags_in_row(tokens, vocab.where(often), key_cols, rest=True).withColumn(
        "row", F.monotonically_increasing_id()), "bag-rows")
    left = rows.select("row", F.explode(F.arrays_zip(F.col("rest_tokens").alias("token"), F.col("rest_counts").alias("cnt"))).alias("e"))
    found = (left.select("row", "e.token", "e.cnt").join(vocab.where(~often).select("token", F.col("token_id").cast("int").alias(
        "token_id")), "token").groupBy("row").agg(F.collect_list(F.struct("token_id", "cnt", "token")).alias("more")))
    own = F.transform(F.arrays_zip("keys", "values", "key_tokens"), lambda x: F.struct(
        x["keys"].alias("token_id"), x["values"].alias("cnt"), x["key_tokens"].alias("token")))
    both = rows.drop("rest_tokens", "rest_counts").join(found, "row", "left").select(*keys, F.when(
        F.col("more").isNotNull(), F.sort_array(F.concat(own, "more"))).otherwise(own).alias("e"))
    return both.select(*keys, F.col("e.token_id").alias("keys"), F.col("e.cnt").alias("values"), F.col("e.token").alias("key_tokens"))


def bow_pairs(bow: DataFrame) -> DataFrame:
    """(id, count) pairs; fails when keys and values differ in length."""
    return bow.select(
        "*",
        F.assert_true(F.size("keys") == F.size("values"), F.lit("BoW keys/values differ in length")).alias("_chk"),
    ).drop("_chk").withColumn("pairs", F.arrays_zip(F.col("keys").alias("id"), F.col("values").alias("cnt")))


def bow_entries(bow: DataFrame, key_cols=("post_id", "ord_key", "ml_tag")) -> DataFrame:
    """Flat view of a bag of words: one row per (document, token)."""
    keys = [c for c in key_cols if c in bow.columns]
    z = F.arrays_zip(F.col("keys").alias("token_id"), F.col("values").alias("cnt"),
                     F.col("key_tokens").alias("token"))
    return bow.select(*keys, F.explode(z).alias("e")).select(
        *keys, "e.token_id", "e.token", F.col("e.cnt").cast("bigint").alias("cnt"))


def corpus_term_frequency(bow: DataFrame, top_n: int = 100, ml_tags=None) -> DataFrame:
    """Token totals over the corpus (optionally some splits), top-n with a
    share relative to the most frequent token."""
    b = bow if not ml_tags else bow.filter(F.col("ml_tag").isin(list(ml_tags)))
    totals = bow_entries(b).groupBy("token").agg(F.sum("cnt").alias("cnt"))
    top = totals.orderBy(F.col("cnt").desc(), "token").limit(top_n)
    w = Window.orderBy(F.col("cnt").desc(), "token")
    return top.select("token", "cnt",
                      F.round(F.col("cnt") / F.max("cnt").over(Window.partitionBy()), 6).alias("rel"),
                      F.row_number().over(w).alias("rank"))


def doc_term_frequency(bow: DataFrame, ord_key: int, top_n: int = 100) -> DataFrame:
    """Term frequency of one document."""
    return corpus_term_frequency(bow.filter(F.col("ord_key") == ord_key), top_n)


def top_terms_per_doc(bow: DataFrame, top_n: int = 5) -> DataFrame:
    """The n most frequent known tokens of every document."""
    e = bow_entries(bow)
    w = Window.partitionBy("ord_key").orderBy(F.col("cnt").desc(), "token")
    return e.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n)


def vocabulary_size(vocab: DataFrame) -> DataFrame:
    """D15."""
    return vocab.select(F.count(F.lit(1)).alias("vocab_size"))
