"""Links: anchor extraction, classification and the link report (C14, G7,
G16, I3, J1, J4, K6, K7).

Anchor extraction is a pair of JVM regular expressions over the whole HTML
text (no Python); the report is one partial-aggregated ``groupBy(address)``.
The set of referring posts is returned as a flat (address, post) table rather
than an array, so a link present on a third of all pages is never gathered
into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forumlens.functions.markup import unescape
from forumlens.functions.scalars import link_type

# Anchor patterns and the missing-href marker.
ANCHOR_RE = r"(?is)<a(?:\s[^>]*)?>.*?</a>"
COMMENT_RE = r"(?s)<!--.*?-->"
HREF_RE = r"""(?is)^<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^"'\s>][^\s>]*))"""
ANCHOR_TEXT_RE = r"(?is)^<a[^>]*>(.*)</a>$"
TAG_RE = r"<[^>]*>"
NO_HREF = "#none#"


def anchors(html) -> Column:
    """C14: ``array<struct<text, href>>`` of every ``<a>`` in an HTML string outside
    comments, its href in double, single or no quotes; a missing href becomes
    ``#none#``; null or empty input gives []."""
    h = F.regexp_replace(F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit("")), COMMENT_RE, "")
    raw = F.regexp_extract_all(h, F.lit(ANCHOR_RE), 0)

    def one(a):
        href = F.concat(*[F.regexp_extract(a, HREF_RE, i) for i in (1, 2, 3)])  # one of them matched
        has = F.regexp_like(a, F.lit(HREF_RE))
        txt = F.regexp_replace(F.regexp_extract(a, ANCHOR_TEXT_RE, 1), TAG_RE, "")
        return F.struct(unescape(txt).alias("text"),
                        F.when(has, unescape(href)).otherwise(F.lit(NO_HREF)).alias("href"))

    return F.transform(raw, one)


def page_links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
               source: str = "question") -> DataFrame:
    """One row per link: id, position, text, lower-cased address, link type."""
    ex = pages.select(F.col(id_col).alias("post_id"), F.posexplode(anchors(html_col)).alias("pos", "a"))
    addr = F.lower(F.col("a.href"))
    return ex.select("post_id", F.col("pos").cast("int").alias("pos"),
                     F.col("a.text").alias("text"), addr.alias("address"),
                     link_type(addr).alias("link_type"), F.lit(source).alias("source"))


def link_report(links: DataFrame, post_stats: DataFrame | None = None, topic_cols=()) -> DataFrame:
    """Per lower-cased address: count, distinct referring posts, type and
    (when ``post_stats`` with votes/views/topic columns is given) the sums of
    question votes, views, answer votes (answer links only, null as 0) and
    topic weights. Order it with :func:`top_links` or ``orderBy``."""
    df = links
    aggs = [F.count(F.lit(1)).alias("cnt"), F.count_distinct("post_id").alias("n_posts"),
            F.first("link_type").alias("link_type")]
    if post_stats is not None:
        df = df.join(post_stats, "post_id", "left")
        aggs += [F.sum(F.coalesce("votes", F.lit(0))).alias("question_votes_total"),
                 F.sum(F.coalesce("views", F.lit(0))).alias("views_total"),
                 F.sum(F.when(F.col("source") == "answer", F.coalesce("answer_vote", F.lit(0)))
                       .otherwise(0)).alias("answers_votes_total")]
        aggs += [F.sum(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in topic_cols]
    return df.groupBy("address").agg(*aggs)


def link_refs(links: DataFrame) -> DataFrame:
    """Distinct (address, referring post) pairs."""
    return links.select("address", "post_id").distinct()


def distinct_link_count(links: DataFrame) -> DataFrame:
    """G16."""
    return links.agg(F.count_distinct("address").alias("n_links"))


def top_links(report: DataFrame, n: int = 5) -> DataFrame:
    """Top n by count overall and top n of type 'std' (``scope`` column)."""
    # Distributed top-k first (TakeOrderedAndProject), then rank the n rows.
    w = Window.orderBy(F.col("cnt").desc(), "address")
    order = [F.col("cnt").desc(), F.col("address")]
    a = report.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(w)).withColumn("scope", F.lit("all"))
    s = (report.filter(F.col("link_type") == "std").orderBy(*order).limit(n)
         .withColumn("rank", F.row_number().over(w)).withColumn("scope", F.lit("std")))
    return a.unionByName(s)


def post_links(info: DataFrame) -> DataFrame:
    """J1 + C14 on parsed posts: the links of the question, its comments, the
    answers and the answers' comments (a bag union), one row each with its
    source, the answer's vote for answer links, and the address / type."""
    def from_block(block, source, vote=None):
        return F.transform(anchors(block), lambda a: F.struct(
            a["text"].alias("text"), a["href"].alias("href"), F.lit(source).alias("source"),
            (vote if vote is not None else F.lit(None).cast("int")).alias("answer_vote")))

    q = from_block(F.col("question_links"), "question")
    qc = F.flatten(F.transform(F.coalesce(F.col("comment_link_lst"), F.array()),
                               lambda c: from_block(c, "comment")))
    ans = F.flatten(F.transform(F.coalesce(F.col("answers"), F.array()), lambda a: F.concat(
        from_block(a["answer_links"], "answer", a["answer_vote"]),
        F.flatten(F.transform(F.coalesce(a["comment_link_lst"], F.array()),
                              lambda c: from_block(c, "answer", a["answer_vote"]))))))
    ex = info.select("post_id", "ord_key", F.posexplode(F.concat(q, qc, ans)).alias("pos", "l"))
    addr = F.lower(F.col("l.href"))
    return ex.select("post_id", "ord_key", F.col("pos").cast("int").alias("pos"), F.col("l.text").alias("text"),
                     addr.alias("address"), link_type(addr).alias("link_type"), F.col("l.source").alias("source"),
                     F.col("l.answer_vote").alias("answer_vote"))
