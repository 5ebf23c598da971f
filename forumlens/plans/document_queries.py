"""Queries over stored documents: formats, the step store, questions and answers, landed records."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from forumlens.operators import assemble as AM
from forumlens.operators import formats as FM
from forumlens.operators import outcomes as O
from forumlens.operators import posts as P
from forumlens.operators import vocab as V
from forumlens.operators.outcomes import split_filter
from forumlens.plans.outcome_queries import OUTCOMES_CTE, UPSERT_SPLIT_DAY
from forumlens.plans.registry import register
from forumlens.plans.report_queries import K
from forumlens.plans.sqlparts import ml_tag_sql, posts_cte, tokens_cte, vocab_cte
from forumlens.plans.text_queries import _BOW_SQL, _vocab_and_bow, _written_tokens
from forumlens.session import ensure_checkpoint_dir
from forumlens.sources import catalog as C
from forumlens.sources import keyed as KD
from forumlens.sources import landed as L
from forumlens.sources import store as S
from forumlens.sources.tables import (catalog_artefacts, catalog_runs, catalog_steps, outcomes, posts, table,
                                      topic_vectors)

VALIDATION, TEST = 1, 2


# ------------------------------------------------------------ document formats

@register("format_tokens", sql=lambda: f"""
WITH {posts_cte()}, {tokens_cte()}, {vocab_cte()}, {_BOW_SQL}
SELECT b.ord_key, p.ml_tag, b.token, b.cnt FROM bow b JOIN posts p USING (ord_key) WHERE p.ml_tag IN (1, 2)""")
def format_tokens(spark, sf_dir):
    """B4 + B6 'tokens': token -> count of every document of the validation and test splits."""
    d = FM.doc_format(_vocab_and_bow(spark, sf_dir)[2], "tokens", [VALIDATION, TEST])
    return d.select("ord_key", "ml_tag", F.explode("doc").alias("token", "n")).select(
        "ord_key", "ml_tag", "token", F.col("n").cast("long").alias("cnt"))


@register("format_keys", sql=lambda: f"""
WITH {posts_cte()}, {tokens_cte()}, {vocab_cte()}, {_BOW_SQL}
SELECT ord_key, token_id, cnt FROM bow""")
def format_keys(spark, sf_dir):
    """B4 + B6 'keys' + D12: (id, count) pairs of every document; an empty split list means all."""
    checked = V.bow_pairs(_vocab_and_bow(spark, sf_dir)[2])
    d = FM.doc_format(checked, "Keys", [])
    return d.select("ord_key", F.explode("doc").alias("e")).select(
        "ord_key", F.col("e.id").alias("token_id"), F.col("e.cnt").cast("long").alias("cnt"))


@register("format_unprocessed_tokens", sql=lambda: f"""
WITH {posts_cte()}, {tokens_cte()}
SELECT ord_key, coalesce(array_to_string(tokens, ' '), '') AS doc FROM toks WHERE ml_tag = 0""")
def format_unprocessed_tokens(spark, sf_dir):
    """B6 'unprocessed_tokens': the token list of every training document."""
    d = FM.doc_format(_written_tokens(spark, sf_dir), "unprocessed_tokens", [0])
    return d.select("ord_key", F.array_join("doc", " ").alias("doc"))


_STEPS_SQL = """
ln AS (SELECT l_orderkey, l_linenumber, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS exit_code,
              sum(l_quantity) AS quantity
       FROM lineitem GROUP BY l_orderkey, l_linenumber),
steps AS (SELECT l_orderkey AS flow_run_id, '#' || k AS step, 'L' || l_orderkey || '_' || k AS step_label,
                 CAST(exit_code AS INTEGER) AS exit_code, quantity
          FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM ln))"""


@register("format_step_records", sql=f"""
WITH {_STEPS_SQL} SELECT flow_run_id, step, step_label, exit_code FROM steps WHERE step = '#2'""")
def format_step_records(spark, sf_dir):
    """B6 'all_#n': the whole records of one step."""
    return FM.doc_format(catalog_steps(spark, sf_dir), "all_#2").select("flow_run_id", "step", "step_label", "exit_code")


# ------------------------------------------------------------ step store

@register("step_store", sql=f"""
WITH {_STEPS_SQL}, third AS (SELECT * FROM steps WHERE step = '#3')
SELECT o.o_orderkey AS flow_run_id, t.step_label, t.exit_code, t.flow_run_id IS NULL AS missing
FROM orders o LEFT JOIN third t ON t.flow_run_id = o.o_orderkey""")
def step_store(spark, sf_dir):
    """A7 + A2 + A5: steps written by step, one step scanned back, its records fetched for the
    keys of all runs, and the keys without a record reported."""
    path = f"{ensure_checkpoint_dir(spark)}/steps-{uuid.uuid4().hex}"
    S.write_dataset(catalog_steps(spark, sf_dir), path, partition_cols=("step",))
    third = S.scan_step(spark, path, "#3", columns=("flow_run_id", "step_label", "exit_code"))
    found, missing = S.fetch_by_keys(third, catalog_runs(spark, sf_dir), ["flow_run_id"])
    return found.withColumn("missing", F.lit(False)).unionByName(
        missing.withColumn("missing", F.lit(True)), allowMissingColumns=True)


@register("bucketed_steps", sql=f"""
WITH {_STEPS_SQL}, second AS (SELECT * FROM steps WHERE step = '#2')
SELECT o.o_orderkey AS flow_run_id, t.step_label, t.exit_code, t.flow_run_id IS NULL AS missing
FROM orders o LEFT JOIN second t ON t.flow_run_id = o.o_orderkey""")
def bucketed_steps(spark, sf_dir):
    """A5 + F1: the steps stored in buckets by (step, run), the second step of every run
    fetched by its keys without a shuffle of the store, and the keys without a record."""
    keys = ["step", "flow_run_id"]
    records = catalog_steps(spark, sf_dir).select("flow_run_id", "step", "step_label", "exit_code")
    stored = spark.table(S.write_bucketed(records, keys))
    wanted = catalog_runs(spark, sf_dir).select(F.lit("#2").alias("step"), "flow_run_id")
    found, missing = S.fetch_by_keys(stored, wanted, keys)
    return found.withColumn("missing", F.lit(False)).unionByName(
        missing.withColumn("missing", F.lit(True)), allowMissingColumns=True).drop("step")


@register("step_guards", sql=f"""
WITH {_STEPS_SQL},
req AS (SELECT '#' || n AS step, 'L' || o_orderkey || '_' || n AS step_label FROM orders, (VALUES (1), (4)) v(n))
SELECT r.step, r.step_label, s.step_label IS NOT NULL AS conflict, coalesce(s.exit_code = 0, false) AS reusable
FROM req r LEFT JOIN steps s ON s.step = r.step AND s.step_label = r.step_label""")
def step_guards(spark, sf_dir):
    """F13 + F14: of the first and fourth step of every run, which exist already and which can be reused."""
    run = F.col("flow_run_id").cast("string")
    requested = catalog_runs(spark, sf_dir).select(run.alias("run"), F.explode(F.array(F.lit("1"), F.lit("4"))).alias("n")).select(
        F.concat(F.lit("#"), "n").alias("step"), F.concat(F.lit("L"), "run", F.lit("_"), "n").alias("step_label"))
    steps = catalog_steps(spark, sf_dir)
    taken = O.conflicting_steps(requested, steps).withColumn("conflict", F.lit(True))
    return O.reusable_steps(requested, steps).join(taken, ["step", "step_label"], "left").select(
        "step", "step_label", F.coalesce("conflict", F.lit(False)).alias("conflict"), "reusable")


@register("artefact_values", sql=f"""
WITH {_STEPS_SQL}
SELECT step, step_label, round(CAST(quantity AS DOUBLE), 4) AS quantity FROM steps WHERE step IN ('#1', '#2')""")
def artefact_values(spark, sf_dir):
    """A13 + A3: artefacts put as JSON text, the catalog scanned back, values of two steps parsed."""
    base = f"{ensure_checkpoint_dir(spark)}/catalog-{uuid.uuid4().hex}"
    C.put_artefacts(catalog_artefacts(spark, sf_dir), f"{base}/artefacts")
    catalog_runs(spark, sf_dir).write.parquet(f"{base}/runs")
    catalog_steps(spark, sf_dir).write.parquet(f"{base}/steps")
    cat = C.read_catalog(spark, base)
    steps = C.distinct_steps(cat["steps"]).where(F.col("step").isin("#1", "#2"))
    parsed = C.lineage_artefacts(steps, cat["artefacts"]).select(
        "step", "step_label", F.from_json("artefact_value", "quantity double, price double").alias("v"))
    return parsed.select("step", "step_label", F.round("v.quantity", 4).alias("quantity"))


# ------------------------------------------------------------ questions and answers

@register("qa_counts", sql="""
WITH f AS (SELECT conv_id, min(turn) AS asked, min(CASE WHEN role = 'assistant' THEN turn END) AS answered
           FROM conversations GROUP BY conv_id)
SELECT c.conv_id, CAST(count(*) FILTER (c.role = 'assistant') AS BIGINT) AS n_answers,
       CAST(count(*) FILTER (c.role <> 'assistant' AND c.turn > f.asked
                             AND (f.answered IS NULL OR c.turn < f.answered)) AS BIGINT) AS n_question_comments,
       CAST(count(*) FILTER (c.role <> 'assistant' AND c.turn > f.asked) AS BIGINT) AS n_comments
FROM conversations c JOIN f ON f.conv_id = c.conv_id GROUP BY c.conv_id""")
def qa_counts(spark, sf_dir):
    """C11: answers (assistant turns), comments on the question (other turns between the first
    turn and the first answer) and all comments of every conversation. Flat rows and partial
    sums, so that a conversation with very many turns is no hot group."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    answer = F.col("role") == "assistant"
    first = c.groupBy("conv_id").agg(F.min("turn").alias("asked"), F.min(F.when(answer, F.col("turn"))).alias("answered"))
    comment = ~answer & (F.col("turn") > F.col("asked"))
    early = F.coalesce(F.col("turn") < F.col("answered"), F.lit(True))
    return c.join(first, "conv_id").groupBy("conv_id").agg(
        F.count(F.when(answer, 1)).alias("n_answers"), F.count(F.when(comment & early, 1)).alias("n_question_comments"),
        F.count(F.when(comment, 1)).alias("n_comments"))


PAGE_CHARS = 1000


@register("conversation_pages", sql=f"""
WITH f AS (SELECT conv_id, min(turn) AS asked, min(CASE WHEN role = 'assistant' THEN turn END) AS answered
           FROM conversations GROUP BY conv_id),
p AS (SELECT c.conv_id, c.turn, c.text, CASE WHEN c.role = 'assistant' THEN 2 WHEN c.turn = f.asked THEN 0
             WHEN f.answered IS NULL OR c.turn < f.answered THEN 1 ELSE 3 END AS part
      FROM conversations c JOIN f ON f.conv_id = c.conv_id WHERE c.text IS NOT NULL),
w AS (SELECT conv_id, string_agg(text, ' ' ORDER BY part, turn) AS whole FROM p GROUP BY conv_id),
k AS (SELECT conv_id, whole, unnest(range((greatest(length(whole), 1) - 1) // {PAGE_CHARS} + 1)) AS page FROM w)
SELECT conv_id, CAST(page AS BIGINT) AS page, substring(whole, page * {PAGE_CHARS} + 1, {PAGE_CHARS}) AS text FROM k""")
def conversation_pages(spark, sf_dir):
    """The whole text of every conversation (question, its comments, answers, their comments), in
    pages of 1000 characters; a conversation of any number of turns is never one row or group."""
    pieces = AM.conversation_pieces(table(spark, sf_dir, "conversations"))
    return AM.pages(pieces, "conv_id", PAGE_CHARS)


# ------------------------------------------------------------ stored datasets

_LAST = "QUALIFY row_number() OVER (PARTITION BY post_id, result_class_name ORDER BY ts DESC, ord_key DESC) = 1"


@register("stored_upsert", sql=f"""
WITH {OUTCOMES_CTE},
base AS (SELECT * FROM outcomes WHERE step_label < '{UPSERT_SPLIT_DAY}' {_LAST}),
upd AS (SELECT * FROM outcomes WHERE step_label >= '{UPSERT_SPLIT_DAY}' AND exit_code = 1 {_LAST}),
merged AS (SELECT * FROM base WHERE NOT EXISTS (
             SELECT 1 FROM upd WHERE upd.post_id = base.post_id AND upd.result_class_name = base.result_class_name)
           UNION ALL SELECT * FROM upd)
SELECT 'outcomes' AS dataset, post_id AS key, result_class_name AS detail, exit_code FROM merged WHERE modus <> 'test'
UNION ALL SELECT 'runs', o_orderkey, o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END FROM orders""")
def stored_upsert(spark, sf_dir):
    """A8 + A9: two stored datasets; the outcomes of the first half of the month are upserted with
    the failures of the second half, test rows are purged from every dataset that knows the
    modus, and both are read back from what their manifests name."""
    root = f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    o = outcomes(spark, sf_dir).select("post_id", "result_class_name", "ord_key", "step_label", "exit_code", "modus", "ts")
    order = ["ts", "ord_key"]
    stored = KD.create(o.where(F.col("step_label") < UPSERT_SPLIT_DAY), f"{root}/outcomes", ["post_id", "result_class_name"], order)
    KD.create(catalog_runs(spark, sf_dir), f"{root}/runs", ["flow_run_id"], ["started_at_timest"])
    stored.upsert(o.where((F.col("step_label") >= UPSERT_SPLIT_DAY) & (F.col("exit_code") == 1)), order)
    KD.purge_everywhere(spark, root, "modus", "test")
    left = KD.open_dataset(spark, f"{root}/outcomes").read().select(
        F.lit("outcomes").alias("dataset"), F.col("post_id").alias("key"), F.col("result_class_name").alias("detail"), "exit_code")
    runs = KD.open_dataset(spark, f"{root}/runs").read().select(
        F.lit("runs").alias("dataset"), F.col("flow_run_id").alias("key"), F.col("topic").alias("detail"), "exit_code")
    return left.unionByName(runs)


# ------------------------------------------------------------ landed records

@register("landed_search", sql=f"""
SELECT 'document' AS record_class, doc_id AS ord_key, lang, NULL::INTEGER AS exit_code FROM documents
WHERE {ml_tag_sql()} = 0 AND lang = 'en' AND list_contains(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), 'the')""")
def landed_search(spark, sf_dir):
    """A4 + A6: one scan over posts and outcome log for training records (the log has no split, so
    none of it), and the English records with the term 'the'."""
    frames = {"document": posts(spark, sf_dir).select(
        F.lit("#3").alias("step"), "ord_key", "ml_tag", "lang", "text"),
        "outcome": outcomes(spark, sf_dir).select("step", "ord_key", "exit_code")}
    found = L.term_filter(L.scan_classes(frames, "#3", training_only=True), {"lang": "en", "text": "the"})
    return found.select("record_class", "ord_key", "lang", "exit_code")


@register("topic_weighted_sizes", sql=f"""
WITH tv AS (SELECT vec_id, list_transform(range({K}), lambda i: list_sum(list_transform(range(i, len(embedding), {K}),
                   lambda j: CAST(abs(embedding[j + 1]) AS DOUBLE)))) AS raw FROM embeddings),
w AS (SELECT d.source, coalesce(d.n_chars, 0) AS n, CAST(unnest(range({K})) AS INTEGER) AS topic_id,
             unnest(list_transform(raw, lambda v: v / list_sum(raw))) AS w
      FROM documents d JOIN tv ON tv.vec_id = d.doc_id)
SELECT source, topic_id, count(*) AS n_docs, round(sum(w * n), 3) AS weighted_chars FROM w GROUP BY source, topic_id""")
def topic_weighted_sizes(spark, sf_dir):
    """F4 + B11 + K9 + G12 (categorical, topic-weighted): characters of every source by topic weight."""
    vectors = P.topic_vector(P.topic_long(topic_vectors(spark, sf_dir, K)), K)
    docs = P.fill_numeric_nulls(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("post_id"), "source", "n_chars"))
    frame = docs.join(vectors, "post_id").select("source", "n_chars", *[F.col("w")[i].alias(f"w_topic_{i}") for i in range(K)])
    sums = P.weighted_metric(frame, "n_chars", K).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.array(*[F.sum(f"n_chars_w{i}") for i in range(K)]).alias("sums"))
    return sums.select("source", "n_docs", F.posexplode("sums").alias("topic_id", "s")).select(
        "source", F.col("topic_id").cast("int").alias("topic_id"), "n_docs", F.round("s", 3).alias("weighted_chars"))


@register("source_histogram", sql=f"""
WITH c AS (SELECT source, {ml_tag_sql()} AS ml_tag, count(*) AS cnt FROM documents GROUP BY ALL)
SELECT source, ml_tag, cnt, round(cnt / sum(cnt) OVER (PARTITION BY ml_tag), 6) AS share FROM c WHERE ml_tag IN (0, 1)""")
def source_histogram(spark, sf_dir):
    """G12 (categorical) + B4: documents by source in the training and validation splits, with shares."""
    d = split_filter(posts(spark, sf_dir), [0, VALIDATION]).select(F.col("tags")[0].alias("source"), "ml_tag")
    counts = d.groupBy("source", "ml_tag").agg(F.count(F.lit(1)).alias("cnt"))
    total = counts.groupBy("ml_tag").agg(F.sum("cnt").alias("total"))
    return counts.join(total, "ml_tag").select("source", "ml_tag", "cnt", F.round(F.col("cnt") / F.col("total"), 6).alias("share"))
