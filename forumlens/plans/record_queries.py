"""Queries over landed, exported and shaped records: slices, schemas, keys, lemmas, link unions, counts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from forumlens.functions.scalars import composite_key, file_stamp, int_from_text, split_tag, truncate_msg
from forumlens.functions.text import default_stop_words
from forumlens.operators import formats as FM
from forumlens.operators import graph as G
from forumlens.operators import links as L
from forumlens.operators import outcomes as O
from forumlens.operators import vocab as V
from forumlens.plans.outcome_queries import OUTCOMES_CTE
from forumlens.plans.registry import register
from forumlens.plans.report_queries import _links_cte
from forumlens.plans.sqlparts import ml_tag_sql, posts_cte, sql_list, tokens_cte, vocab_cte
from forumlens.plans.text_queries import _vocab
from forumlens.schemas import POST_RAW, POST_RESULTS
from forumlens.session import ensure_checkpoint_dir
from forumlens.sources import store as S
from forumlens.sources.landed import scan_landed
from forumlens.sources.scratch import scratch
from forumlens.sources.tables import TABLES, catalog_steps, outcomes, posts, table


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------ slices and keys

@register("training_results", sql=f"""
WITH {OUTCOMES_CTE}
SELECT 'ord_key:' || ord_key || ';step:' || step || ';step_label:' || step_label AS file_key, post_id,
       strftime(ts, '%Y_%m_%d__%H_%M_%S') AS stamp
FROM outcomes WHERE exit_code = 0 AND result_class_name IN ('click', 'view') AND {ml_tag_sql('ord_key')} = 0""")
def training_results(spark, sf_dir):
    """B3 + B9 + K14: successful training rows of two result classes, each with its composite
    key and the stamp of its time."""
    o = outcomes(spark, sf_dir).withColumn("ml_tag", split_tag("ord_key"))
    return O.successful_results(o, ["click", "view"], training_only=True).select(
        composite_key("step", "step_label", "ord_key").alias("file_key"), "post_id", file_stamp("ts").alias("stamp"))


@register("post_slices", sql=f"""
SELECT doc_id AS post_id, doc_id AS ord_key, {ml_tag_sql()} AS ml_tag, CAST(doc_id % 10 AS INTEGER) AS batch_id
FROM documents""")
def post_slices(spark, sf_dir):
    """B2: the batches of the post records, which have no exit code."""
    return O.batch_slice(posts(spark, sf_dir), successful_only=False)


@register("conformed_posts", sql=f"""
SELECT '#2' AS step, doc_id AS ord_key, 'posts' AS result_class_name, CAST(0 AS INTEGER) AS exit_code, doc_id AS post_id,
       md5(substring(text, 1, 4094)) AS msg_md5, CAST(length(substring(text, 1, 4094)) AS INTEGER) AS msg_length,
       CAST(NULL AS VARCHAR) AS flow_run_name, CAST(n_chars AS INTEGER) AS views
FROM documents WHERE {ml_tag_sql()} = 0""")
def conformed_posts(spark, sf_dir):
    """B5 + B8 + K8 + K13: training posts mapped to result records by the declared schema (what
    they lack by default or null, the class overridden, two fields left out), with the message cut at its
    length and the views read from a text such as '1,234 views'."""
    d = table(spark, sf_dir, "documents").withColumn("ml_tag", split_tag("doc_id")).withColumn(
        "views", F.concat(F.format_number("n_chars", 0), F.lit(" views")))
    mapped = FM.filter_map(d, F.col("ml_tag") == 0, F.col("doc_id").alias("post_id"), F.col("doc_id").alias("ord_key"),
                           F.lit("#2").alias("step"), truncate_msg("text").alias("exit_msg"), "views")
    views = mapped.select("post_id", int_from_text("views", cut_suffix=len(" views")).alias("views"))
    shaped = FM.conform(mapped.withColumn("exit_code", F.lit(None).cast("int")), POST_RESULTS, defaults={"exit_code": 0},
                        overrides={"result_class_name": "posts"}, exclude=("modus", "ml_tag"))
    return shaped.join(views, "post_id").select(
        "step", "ord_key", "result_class_name", "exit_code", "post_id", F.md5("exit_msg").alias("msg_md5"),
        F.length("exit_msg").alias("msg_length"), "flow_run_name", "views")


@register("flattened_words", sql="""
WITH f AS (SELECT doc_id, flatten(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: string_split(l, ' '))) AS w
           FROM documents)
SELECT doc_id, CAST(len(w) AS INTEGER) AS n_pieces, CAST(len(list_distinct(w)) AS INTEGER) AS n_different,
       md5(array_to_string(w, ' ')) AS pieces_md5 FROM f""")
def flattened_words(spark, sf_dir):
    """The lines of every document and the words of every line, flattened to one list."""
    d = table(spark, sf_dir, "documents")
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.split(x, " "))
    w = d.select("doc_id", FM.flatten_all(lines, 1).alias("w"))
    return w.select("doc_id", F.size("w").alias("n_pieces"), F.size(F.array_distinct("w")).alias("n_different"),
                    F.md5(F.array_join("w", " ")).alias("pieces_md5"))


@register("table_rows", sql=" UNION ALL ".join(f"SELECT '{t}' AS dataset, count(*) AS n FROM {t}" for t in TABLES))
def table_rows(spark, sf_dir):
    """The rows of every table."""
    out = None
    for name in TABLES:
        one = FM.row_count(table(spark, sf_dir, name)).select(F.lit(name).alias("dataset"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# ------------------------------------------------------------ landed and exported files

@register("landed_posts", sql=f"""
SELECT page_id AS post_id, '#2' AS step, {ml_tag_sql('page_id')} AS ml_tag, md5(html) AS content_md5,
       CAST(length(html) AS INTEGER) AS n_chars
FROM pages WHERE page_id % 7 <> 3""")
def landed_posts(spark, sf_dir):
    """A1: landed pages as JSON records (every seventh a failed download), read by the declared
    schema; only successful downloads go on."""
    path = _folder(spark, "landed")
    p = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("post_id"), F.col("page_id").alias("ord_key"), F.lit("#2").alias("step"),
        split_tag("page_id").alias("ml_tag"), F.col("html").alias("content_raw"),
        F.when(F.col("page_id") % 7 == 3, 1).otherwise(0).alias("request_code"))
    p.select(*[f.name for f in POST_RAW.fields if f.name in p.columns]).write.json(path)
    return scan_landed(spark, path, "post", "json").select(
        "post_id", "step", "ml_tag", F.md5("content_raw").alias("content_md5"), F.length("content_raw").alias("n_chars"))


@register("exported_steps", sql="""
WITH ln AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem),
s AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k,
             count(*) OVER (PARTITION BY l_orderkey) AS n FROM ln)
SELECT l_orderkey AS flow_run_id, '#' || k AS step, 'L' || l_orderkey || '_' || k AS step_label,
       CAST(CASE WHEN k = n THEN k - 1 END AS INTEGER) AS n_earlier,
       CASE WHEN k = n AND k > 1 THEN 'L' || l_orderkey || '_' || (k - 1) END AS previous FROM s""")
def exported_steps(spark, sf_dir):
    """A10 + A11: the steps exported as text with ';' and a header, their lists as JSON, and what
    the files hold."""
    path = _folder(spark, "export")
    S.export_csv(catalog_steps(spark, sf_dir), path)
    back = spark.read.schema("flow_run_id long, step string, step_label string, exit_code int, prev_step_lbls string").csv(
        path, sep=";", header=True)
    prev = F.from_json("prev_step_lbls", "array<string>")
    return back.select("flow_run_id", "step", "step_label", F.when(prev.isNotNull(), F.size(prev)).alias("n_earlier"),
                       F.try_element_at(prev, F.lit(-1)).alias("previous"))


@register("saved_vocabulary", sql=lambda: f"""
WITH {posts_cte()}, {tokens_cte()}, {vocab_cte()}
SELECT token, token_id, df, cf FROM vocab WHERE df >= 2""")
def saved_vocabulary(spark, sf_dir):
    """The dictionary saved as a table and loaded back; the tokens of two documents or more."""
    path = _folder(spark, "dictionary")
    S.save_table(_vocab(spark, sf_dir), path)
    return S.load_table(spark, path).where("df >= 2").select("token", "token_id", "df", "cf")


# ------------------------------------------------------------ joins and unions

@register("asker_of_posts", sql="""
WITH m AS (SELECT user_id, min_by('/users/' || event_type || '/' || event_id, event_id) AS user_url FROM events GROUP BY user_id)
SELECT d.doc_id AS post_id, m.user_url FROM documents d LEFT JOIN m ON m.user_id = d.doc_id""")
def asker_of_posts(spark, sf_dir):
    """the asker of every post by the first of its metadata records, null without one."""
    meta = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("post_id"), F.col("event_id").alias("ord_key"),
        F.concat(F.lit("/users/"), "event_type", F.lit("/"), "event_id").alias("user_url"))
    return G.asker_lookup(meta, posts(spark, sf_dir).select("post_id"))


@register("lemma_tokens", sql=lambda: f"""
WITH {posts_cte()},
raw AS MATERIALIZED (SELECT ord_key, ml_tag, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z]'), lambda t: length(t) >= 2) AS ws
                     FROM posts),
u AS MATERIALIZED (SELECT ord_key, unnest(ws) AS token FROM raw),
words AS MATERIALIZED (SELECT DISTINCT token FROM u),
lem AS (SELECT a.token, b.token AS lemma FROM words a JOIN words b ON a.token = b.token || 's' WHERE length(a.token) >= 4),
t AS (SELECT u.ord_key, coalesce(lem.lemma, u.token) AS token FROM u LEFT JOIN lem ON lem.token = u.token),
k AS (SELECT ord_key, count(*) AS n, count(DISTINCT token) AS d FROM t
      WHERE NOT list_contains({sql_list(default_stop_words())}, token) GROUP BY ord_key)
SELECT raw.ord_key, raw.ml_tag, coalesce(k.n, 0) AS n_tokens, coalesce(k.d, 0) AS n_different
FROM raw LEFT JOIN k ON k.ord_key = raw.ord_key""")
def lemma_tokens(spark, sf_dir):
    """Tokens of every document with lemmas (a word and 's' is that word, where the corpus holds both)."""
    p = posts(spark, sf_dir)
    words = V.tokens_frame(p, stop_words=()).select(F.explode("tokens").alias("token")).distinct()
    plural = words.where("length(token) >= 4 and token like '%s'").select("token", F.expr("left(token, length(token) - 1)").alias("lemma"))
    lemmas = scratch(plural.join(words.withColumnRenamed("token", "lemma"), "lemma", "left_semi"), "lemmas")
    t = V.tokens_frame(p, lemmas=lemmas)
    return t.select("ord_key", "ml_tag", F.size("tokens").cast("long").alias("n_tokens"),
                    F.size(F.array_distinct("tokens")).cast("long").alias("n_different"))


@register("post_link_union", sql=lambda: f"""
WITH {_links_cte()}, n AS (SELECT post_id, CAST(count(*) AS INTEGER) AS n FROM lk GROUP BY post_id)
SELECT post_id, pos, text, address, link_type, 'question' AS source, CAST(NULL AS INTEGER) AS answer_vote FROM lk
UNION ALL SELECT lk.post_id, lk.pos + n.n, text, address, link_type, 'answer', CAST(lk.post_id % 5 AS INTEGER)
FROM lk JOIN n ON n.post_id = lk.post_id""")
def post_link_union(spark, sf_dir):
    """The links of questions and of answers (with the answer's vote) as one bag. Each page
    stands for a question and its one answer."""
    block = F.col("html")
    none = F.array().cast("array<string>")
    info = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("post_id"), F.col("page_id").alias("ord_key"), block.alias("question_links"),
        none.alias("comment_link_lst"), F.array(F.struct(
            block.alias("answer_links"), (F.col("page_id") % 5).cast("int").alias("answer_vote"),
            none.alias("comment_link_lst"))).alias("answers"))
    return L.post_links(info).drop("ord_key")
