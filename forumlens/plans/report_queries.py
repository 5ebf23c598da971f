"""Report queries: statistics, links, post/tag frames, time bins."""

from __future__ import annotations

from pyspark.sql import functions as F

from forumlens.operators import links as L
from forumlens.operators import posts as P
from forumlens.operators import stats as S
from forumlens.operators import tags as T
from forumlens.operators import timeline as TL
from forumlens.plans.registry import register
from forumlens.plans.sqlparts import (ANCHOR_RE, ANCHOR_TEXT_RE, TAG_RE, href_sql, link_type_sql, no_comments_sql,
                                      posts_cte)
from forumlens.sources.tables import DEFAULT_TOPICS, post_stats, posts, table, topic_vectors

K = DEFAULT_TOPICS
MAIN_TAG = "en"
D = 6


def _r(c, name=None):
    return F.round(F.col(c) if isinstance(c, str) else c, D).alias(name or c)


def _sqlr(expr: str, name: str) -> str:
    return f"round({expr}, {D}) AS {name}"


# ---------------------------------------------------------------- statistics

def _dist_sql() -> str:
    qs = ", ".join(_sqlr(f"quantile_cont(x, {p})", S.prob_label(p)) for p in S.SUMMARY_PROBS)
    return f"""
WITH v AS (SELECT CAST(l_extendedprice AS DOUBLE) AS x FROM lineitem WHERE l_extendedprice IS NOT NULL),
m AS (SELECT x, avg(x) OVER () AS mu FROM v)
SELECT count(x) AS n, {_sqlr('avg(x)', 'mean')}, {_sqlr('stddev_samp(x)', 'std')},
       {_sqlr('min(x)', 'min')}, {_sqlr('max(x)', 'max')}, {qs},
       {_sqlr('avg(power(x - mu, 3)) / power(avg(power(x - mu, 2)), 1.5)', 'skewness')},
       {_sqlr('avg(power(x - mu, 4)) / power(avg(power(x - mu, 2)), 2) - 3', 'kurtosis')}
FROM m"""


@register("dist_summary", sql=_dist_sql)
def dist_summary(spark, sf_dir):
    """G10 + G11: count, mean, std, min, max, 15 exact percentiles, population
    skewness and excess kurtosis of l_extendedprice."""
    return S.describe(table(spark, sf_dir, "lineitem"), "l_extendedprice")


@register("quantile_sketch")
def quantile_sketch(spark, sf_dir):
    """G10 by a sketch: 15 percentiles of l_extendedprice, and the share of rows below and up
    to each value (their distance from p is the sketch's error)."""
    rows = table(spark, sf_dir, "lineitem").where("l_extendedprice is not null")
    q = S.sketch_quantiles(rows, "l_extendedprice").collect()  # 15 rows
    v = F.col("l_extendedprice").cast("double")
    shares = rows.agg(*[F.avg((v < x.value).cast("double")).alias(f"b{i}") for i, x in enumerate(q)],
                      *[F.avg((v <= x.value).cast("double")).alias(f"u{i}") for i, x in enumerate(q)])
    return shares.select(F.explode(F.array(*[F.struct(
        F.lit(x.p).alias("p"), F.lit(x.value).cast("double").alias("value"), F.col(f"b{i}").alias("below"), F.col(f"u{i}").alias("up_to"))
        for i, x in enumerate(q)])).alias("q")).select("q.*")


@register("histogram", sql="""
WITH v AS (SELECT value AS v FROM events WHERE value IS NOT NULL),
mm AS (SELECT min(v) AS mn, max(v) AS mx, count(*) AS n FROM v),
p AS (SELECT CASE WHEN mx > mn THEN mn ELSE mn - 0.5 END AS lo,
             CASE WHEN mx > mn THEN mx ELSE mx + 0.5 END AS hi, n FROM mm),
pw AS (SELECT lo, hi, n, (hi - lo) / 100.0 AS width FROM p),
b AS (SELECT least(CAST(floor((v - lo) / width) AS INTEGER), 99) AS bin FROM v, pw),
c AS (SELECT bin, count(*) AS cnt FROM b GROUP BY bin),
allb AS (SELECT CAST(range AS INTEGER) AS bin FROM range(100)),
h AS (SELECT allb.bin, coalesce(c.cnt, 0) AS cnt FROM allb LEFT JOIN c ON c.bin = allb.bin)
SELECT h.bin, round(lo + h.bin * width, 6) AS lo, round(lo + (h.bin + 1) * width, 6) AS hi,
       CAST(cnt AS BIGINT) AS cnt, CAST(sum(cnt) OVER (ORDER BY h.bin) AS BIGINT) AS cum_cnt,
       round(cnt / (n * width), 6) AS density
FROM h, pw""")
def histogram(spark, sf_dir):
    """G12 + H4: 100 equal-width bins of events.value with cumulative counts
    and density."""
    h = S.histogram(table(spark, sf_dir, "events"), "value", 100)
    return h.select("bin", _r("lo"), _r("hi"), "cnt", F.col("cum_cnt").cast("bigint").alias("cum_cnt"),
                    _r("density"))


@register("ecdf_by_group", sql="""
WITH m AS (SELECT event_type, avg(value) AS x FROM events GROUP BY event_type)
SELECT e.event_type, round(first(m.x), 6) AS x, round(avg(CASE WHEN e.value <= m.x THEN 1.0 ELSE 0.0 END), 6) AS ecdf
FROM events e JOIN m ON m.event_type = e.event_type GROUP BY e.event_type""")
def ecdf_by_group(spark, sf_dir):
    """Per event type, the ECDF of value at the type's mean value."""
    e = S.ecdf_at_group_mean(table(spark, sf_dir, "events"), "value", "event_type")
    return e.select("event_type", _r("x"), _r("ecdf"))


# --------------------------------------------------------------------- links

def _links_cte() -> str:
    ent = "{x}"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"),
                 ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        ent = f"replace({ent}, '{a}', '{b}')"
    href = href_sql("a", lambda x: ent.format(x=x))
    txt = ent.format(x=f"regexp_replace(regexp_extract(a, '{ANCHOR_TEXT_RE}', 1), '{TAG_RE}', '', 'g')")
    return f"""
pa AS (SELECT page_id, regexp_extract_all({no_comments_sql('html')}, '{ANCHOR_RE}', 0) AS arr FROM pages),
pe AS (SELECT page_id AS post_id, CAST(unnest(range(len(arr))) AS INTEGER) AS pos, unnest(arr) AS a FROM pa),
lk0 AS (SELECT post_id, pos, {txt} AS text,
               lower({href}) AS address
        FROM pe),
lk AS (SELECT post_id, pos, text, address, {link_type_sql('address')} AS link_type, 'question' AS source FROM lk0)"""


def _links(spark, sf_dir):
    return L.page_links(table(spark, sf_dir, "pages"))


@register("page_links", sql=lambda: f"WITH {_links_cte()} SELECT * FROM lk")
def page_links(spark, sf_dir):
    """C14 + K6 + K7: every anchor of every page: text, lower-cased address, type."""
    return _links(spark, sf_dir)


@register("link_report", sql=lambda: f"""WITH {_links_cte()}
SELECT address, CAST(count(*) AS BIGINT) AS cnt, CAST(count(DISTINCT post_id) AS BIGINT) AS n_posts,
       first(link_type) AS link_type FROM lk GROUP BY address""")
def link_report(spark, sf_dir):
    """Per address: count, distinct referring pages, link type."""
    return L.link_report(_links(spark, sf_dir))


def _link_votes_sql() -> str:
    ws = ", ".join(_sqlr(f"sum(coalesce(tvn.w[{i + 1}], 0.0))", f"w_topic_{i}") for i in range(K))
    return f"""WITH {_links_cte()}, {_topic_sql_ctes()},
st AS (SELECT user_id AS post_id, count(*) FILTER (event_type = 'click') AS votes,
              count(*) FILTER (event_type = 'view') AS views,
              count(*) FILTER (event_type = 'purchase') - count(*) FILTER (event_type = 'error') AS answer_vote
       FROM events GROUP BY user_id)
SELECT address, CAST(count(*) AS BIGINT) AS cnt, CAST(count(DISTINCT lk.post_id) AS BIGINT) AS n_posts,
       first(link_type) AS link_type, CAST(sum(coalesce(votes, 0)) AS BIGINT) AS question_votes_total,
       CAST(sum(coalesce(views, 0)) AS BIGINT) AS views_total,
       CAST(sum(CASE WHEN pos > 0 THEN coalesce(answer_vote, 0) ELSE 0 END) AS BIGINT) AS answers_votes_total, {ws}
FROM lk LEFT JOIN st ON st.post_id = lk.post_id LEFT JOIN tvn ON tvn.post_id = lk.post_id GROUP BY address"""


@register("link_votes", sql=_link_votes_sql)
def link_votes(spark, sf_dir):
    """G7 + F7: per address its count, referring pages and type, the sums of their question
    votes and views, of answer votes (links in answers: all but a page's first), and of their
    topic weights."""
    links = _links(spark, sf_dir).withColumn("source", F.when(F.col("pos") > 0, "answer").otherwise("question"))
    weights = topic_vectors(spark, sf_dir, K).select("post_id", *[F.col("w")[i].alias(f"w_topic_{i}") for i in range(K)])
    stats = post_stats(spark, sf_dir).join(weights, "post_id", "full")
    topics = [f"w_topic_{i}" for i in range(K)]
    rep = L.link_report(links, stats, topics)
    totals = ["question_votes_total", "views_total", "answers_votes_total"]
    return rep.select("address", "cnt", "n_posts", "link_type", *[F.col(c).cast("long").alias(c) for c in totals],
                      *[_r(c) for c in topics])


@register("link_refs", sql=lambda: f"WITH {_links_cte()} SELECT DISTINCT address, post_id FROM lk")
def link_refs(spark, sf_dir):
    """The referring pages of every address as (address, page) pairs."""
    return L.link_refs(_links(spark, sf_dir))


@register("link_count", sql=lambda: f"""WITH {_links_cte()}
SELECT CAST(count(DISTINCT address) AS BIGINT) AS n_links FROM lk""")
def link_count(spark, sf_dir):
    """Number of distinct addresses."""
    return L.distinct_link_count(_links(spark, sf_dir))


@register("top_links", sql=lambda: f"""WITH {_links_cte()},
rep AS (SELECT address, CAST(count(*) AS BIGINT) AS cnt, CAST(count(DISTINCT post_id) AS BIGINT) AS n_posts,
               first(link_type) AS link_type FROM lk GROUP BY address),
a AS (SELECT *, CAST(row_number() OVER (ORDER BY cnt DESC, address) AS INTEGER) AS rank, 'all' AS scope FROM rep),
s AS (SELECT *, CAST(row_number() OVER (ORDER BY cnt DESC, address) AS INTEGER) AS rank, 'std' AS scope
      FROM rep WHERE link_type = 'std')
SELECT * FROM a WHERE rank <= 5 UNION ALL SELECT * FROM s WHERE rank <= 5""")
def top_links(spark, sf_dir):
    """Five most frequent addresses overall and of type 'std'."""
    return L.top_links(L.link_report(_links(spark, sf_dir)), 5)


# ------------------------------------------------------------ posts and tags

def _topic_sql_ctes() -> str:
    return f"""
tv AS (SELECT vec_id AS post_id, list_transform(range({K}), lambda i: list_sum(list_transform(range(i, len(embedding), {K}), lambda j: CAST(abs(embedding[j + 1]) AS DOUBLE)))) AS raw
       FROM embeddings),
tvn AS (SELECT post_id, list_transform(raw, lambda v: v / list_sum(raw)) AS w FROM tv)"""


def _frame_sql_cte() -> str:
    ws = ", ".join(f"coalesce(tvn.w[{i + 1}], 0.0) AS w_topic_{i}" for i in range(K))
    return f"""{posts_cte()}, {_topic_sql_ctes()},
fr0 AS (SELECT p.post_id, p.ml_tag, p.tags, {ws} FROM posts p LEFT JOIN tvn ON tvn.post_id = p.post_id),
frame AS (SELECT *,
  {' + '.join(f'(-w_topic_{i} * log2(greatest(w_topic_{i}, 1e-10)))' for i in range(K))} AS topic_entropy,
  CAST(list_position([{', '.join(f'w_topic_{i}' for i in range(K))}],
                     list_max([{', '.join(f'w_topic_{i}' for i in range(K))}])) - 1 AS INTEGER) AS dominant_topic
  FROM fr0)"""


def _frame(spark, sf_dir):
    long = P.topic_long(topic_vectors(spark, sf_dir, K))
    return P.post_topic_frame(posts(spark, sf_dir), long, K)


@register("post_topic_frame", sql=lambda: f"""WITH {_frame_sql_cte()}
SELECT post_id, {', '.join(_sqlr(f'w_topic_{i}', f'w_topic_{i}') for i in range(K))},
       {_sqlr('topic_entropy', 'topic_entropy')}, dominant_topic FROM frame""")
def post_topic_frame(spark, sf_dir):
    """F2 + F4 + K1 + K2 + H3: posts with w_topic_0..9 (missing -> 0), topic
    entropy and dominant topic."""
    f = _frame(spark, sf_dir)
    return f.select("post_id", *[_r(f"w_topic_{i}") for i in range(K)], _r("topic_entropy"), "dominant_topic")


def _tag_stats_sql() -> str:
    return f"""tstats AS (SELECT tag, CAST(count(*) AS BIGINT) AS total_cnt,
  {', '.join(f'sum(w_topic_{i}) AS total_weight_topic_{i}' for i in range(K))}
  FROM (SELECT unnest(tags) AS tag, * EXCLUDE (tags) FROM frame) GROUP BY tag)"""


@register("tag_stats", sql=lambda: f"""WITH {_frame_sql_cte()}, {_tag_stats_sql()}
SELECT tag, total_cnt, {', '.join(_sqlr(f'total_weight_topic_{i}', f'total_weight_topic_{i}') for i in range(K))}
FROM tstats""")
def tag_stats(spark, sf_dir):
    """Per tag: post count and summed topic weights."""
    s = T.tag_stats(_frame(spark, sf_dir), K)
    return s.select("tag", "total_cnt", *[_r(f"total_weight_topic_{i}") for i in range(K)])


def _tag_scores_sql() -> str:
    c = {i: f"(SELECT total_weight_topic_{i} FROM tstats WHERE tag = '{MAIN_TAG}')" for i in range(K)}
    doc_cnt = f"(SELECT total_cnt FROM tstats WHERE tag = '{MAIN_TAG}')"
    ratios = [f"(total_weight_topic_{i} / {c[i]})" for i in range(K)]
    norm = " + ".join(ratios)
    normed = ", ".join(f"{ratios[i]} / ({norm}) AS normed_weight_{i}" for i in range(K))
    arr = "[" + ", ".join(f"normed_weight_{i}" for i in range(K)) + "]"
    ent = " + ".join(f"(-normed_weight_{i} * log2(greatest(normed_weight_{i}, 1e-10)))" for i in range(K))
    scores = ", ".join(f"0.3 * normed_weight_{i} + 0.7 * total_count_rel AS score_{i}" for i in range(K))
    return f"""ts1 AS (SELECT tag, total_cnt, {normed}, total_cnt / {doc_cnt} AS total_count_rel
                FROM tstats WHERE tag <> '{MAIN_TAG}'),
ts2 AS (SELECT *, {ent} AS weight_entropy, list_max({arr}) AS max_normed_topic_weight,
               CAST(list_position({arr}, list_max({arr})) - 1 AS INTEGER) AS dominant_normed_topic FROM ts1),
ts3 AS (SELECT *, {scores} FROM ts2)"""


_SCORE_COLS = ([f"normed_weight_{i}" for i in range(K)] + ["weight_entropy", "max_normed_topic_weight",
                                                             "total_count_rel"] + [f"score_{i}" for i in range(K)])


@register("tag_scores", sql=lambda: f"""WITH {_frame_sql_cte()}, {_tag_stats_sql()}, {_tag_scores_sql()}
SELECT tag, total_cnt, dominant_normed_topic, {', '.join(_sqlr(c, c) for c in _SCORE_COLS)} FROM ts3""")
def tag_scores(spark, sf_dir):
    """K3 + K4 + K5: normed topic weights against the main tag 'en', entropy,
    dominant topic and scores (lambda 0.3)."""
    s = T.tag_scores(T.tag_stats(_frame(spark, sf_dir), K), MAIN_TAG, K)
    return s.select("tag", "total_cnt", "dominant_normed_topic", *[_r(c) for c in _SCORE_COLS])


@register("tag_top10", sql=lambda: f"""WITH {_frame_sql_cte()}, {_tag_stats_sql()}, {_tag_scores_sql()},
lg AS (SELECT tag, total_cnt, CAST(unnest(range({K})) AS INTEGER) AS topic_id,
              unnest([{', '.join(f'score_{i}' for i in range(K))}]) AS score FROM ts3),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY score DESC NULLS LAST, tag) AS INTEGER) AS rank
       FROM lg)
SELECT topic_id, rank, tag, total_cnt, round(score, 6) AS score FROM rk WHERE rank <= 10""")
def tag_top10(spark, sf_dir):
    """Per topic the ten tags with the highest score."""
    s = T.tag_scores(T.tag_stats(_frame(spark, sf_dir), K), MAIN_TAG, K)
    return T.top_tags_per_topic(s, K, 10).select("topic_id", "rank", "tag", "total_cnt", _r("score"))


# ----------------------------------------------------------------- time bins

def _event_frame(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("ord_key"), F.col("user_id").alias("post_id"),
                                               F.to_date("ts").alias("asked_date"))
    long = P.topic_long(topic_vectors(spark, sf_dir, K))
    return P.post_topic_frame(ev, long, K)


def _bins_sql() -> str:
    ws = ", ".join(f"coalesce(tvn.w[{i + 1}], 0.0) AS w_topic_{i}" for i in range(K))
    return f"""{_topic_sql_ctes()},
b AS (SELECT CAST(e.ts AS DATE) AS d, {ws} FROM events e LEFT JOIN tvn ON tvn.post_id = e.user_id),
mm AS (SELECT min(d) AS mn, datediff('day', min(d), max(d)) AS span FROM b),
bb AS (SELECT b.*, mn, span, datediff('day', mn, d) AS off FROM b, mm),
binned AS (SELECT *, CASE WHEN off <= 0 THEN 0 ELSE CAST((40 * off + span - 1) // span AS INTEGER) END AS bin FROM bb),
lab AS (SELECT *, CASE WHEN bin = 0 THEN '[0] <=' || strftime(mn, '%Y-%m-%d')
           ELSE '[' || bin || '] ' || strftime(mn + CAST(((bin - 1) * span) // 40 AS INTEGER), '%Y-%m-%d')
                || '-' || strftime(mn + CAST((bin * span) // 40 AS INTEGER), '%Y-%m-%d') END AS bin_label
        FROM binned)"""


@register("time_bins", sql=lambda: f"""WITH {_bins_sql()}
SELECT bin, bin_label, CAST(count(*) AS BIGINT) AS n_posts FROM lab GROUP BY bin, bin_label""")
def time_bins(spark, sf_dir):
    """G8 + G9: rows per 40 equal day-bins of the event date."""
    return TL.posts_per_bin(TL.with_time_bin(_event_frame(spark, sf_dir), "asked_date"))


@register("topic_share_by_bin", sql=lambda: f"""WITH {_bins_sql()},
g AS (SELECT bin, bin_label, {', '.join(f'sum(w_topic_{i}) AS s{i}' for i in range(K))} FROM lab GROUP BY bin, bin_label),
lg AS (SELECT bin, bin_label, {' + '.join(f's{i}' for i in range(K))} AS tot,
              CAST(unnest(range({K})) AS INTEGER) AS topic_id, unnest([{', '.join(f's{i}' for i in range(K))}]) AS weight
       FROM g)
SELECT bin, bin_label, topic_id, round(weight, 6) AS weight,
       round(CASE WHEN tot = 0 THEN NULL ELSE weight / tot END, 6) AS share FROM lg""")
def topic_share_by_bin(spark, sf_dir):
    """Summed topic weights per bin and their shares."""
    t = TL.topic_share_per_bin(TL.with_time_bin(_event_frame(spark, sf_dir), "asked_date"), K)
    return t.select("bin", "bin_label", "topic_id", _r("weight"), _r("share"))
