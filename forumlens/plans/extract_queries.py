"""HTML job queries over the landed ``pages`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from forumlens.functions.scalars import split_tag
from forumlens.operators import extract as X
from forumlens.plans.registry import register
from forumlens.plans.sqlparts import ANCHOR_RE, ANCHOR_TEXT_RE, TAG_RE, href_sql, no_comments_sql
from forumlens.sources.tables import table


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


def _sep_sql() -> str:
    ent = "{x}"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"),
                 ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        ent = f"replace({ent}, '{a}', '{b}')"
    href = href_sql("a", lambda x: ent.format(x=x))
    txt = ent.format(x=f"regexp_replace(regexp_extract(a, '{ANCHOR_TEXT_RE}', 1), '{TAG_RE}', '', 'g')")
    return f"""
WITH pa AS (SELECT page_id, regexp_extract_all({no_comments_sql('html')}, '{ANCHOR_RE}', 0) AS arr FROM pages),
pe AS (SELECT page_id, CAST(unnest(range(len(arr))) AS INTEGER) AS pos, unnest(arr) AS a FROM pa),
lk AS (SELECT page_id, pos, {txt} AS text,
              {href} AS href FROM pe),
agg AS (SELECT page_id, count(*) AS n,
               string_agg('<a id="link_id_' || pos || '" href="' || href || '">' || chr(10) || text || chr(10) || '</a>',
                          chr(10) ORDER BY pos) AS links FROM lk GROUP BY page_id)
SELECT p.page_id AS post_id, CAST(coalesce(agg.n, 0) AS INTEGER) AS n_links, coalesce(agg.links, '') AS links
FROM pages p LEFT JOIN agg ON agg.page_id = p.page_id"""


@register("html_link_separation", sql=_sep_sql)
def html_link_separation(spark, sf_dir):
    """C7 (+C14): the parse job's link separation over whole pages: number
    of anchors and the id/href/text links block, checked against regex SQL."""
    return X.separate_page_links(_pages(spark, sf_dir)).select("post_id", "n_links", "links")


@register("post_parse_outcomes")
def post_parse_outcomes(spark, sf_dir):
    """The post parse job over every landed page; one outcome row per
    page (exit code, message, counts). Pages without the forum layout fail
    with exit code 1 and keep their message."""
    raw = _pages(spark, sf_dir).select(F.col("page_id").alias("post_id"), F.col("page_id").alias("ord_key"),
                                       split_tag("page_id").alias("ml_tag"), F.col("html").alias("content_raw"))
    info = X.parse_posts(raw)
    return info.select("post_id", "ord_key", "ml_tag", "exit_code", "exit_msg", "answer_count",
                       "comment_count", "total_comment_count")


def _page_counts_sql() -> str:
    return r"""
WITH a AS (SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)', 1) AS topic,
                  unnest(CASE WHEN len(regexp_extract_all(coalesce(html, ''), '(?is)<a(?:\s[^>]*)?>.*?</a>', 0)) = 0
                              THEN [NULL]
                              ELSE regexp_extract_all(coalesce(html, ''), '(?is)<a(?:\s[^>]*)?>.*?</a>', 0) END) AS a
           FROM pages),
p AS (SELECT topic,
             CASE WHEN a IS NOT NULL
                   AND list_contains(string_split_regex(regexp_extract(a, '(?is)^<a\s[^>]*?class\s*=\s*"([^"]*)"', 1), '\s+'),
                                     's-pagination--item')
                   AND contains(lower(regexp_extract(a, '(?is)^<a\s[^>]*?title\s*=\s*"([^"]*)"', 1)), 'go to page')
                  THEN coalesce(TRY_CAST(trim(regexp_replace(regexp_extract(a, '(?is)^<a[^>]*>(.*)</a>$', 1), '<[^>]*>', '', 'g')) AS INTEGER), -1)
                  ELSE -1 END AS nr
      FROM a)
SELECT topic, CAST(max(nr) AS INTEGER) AS nr_pages FROM p GROUP BY topic"""


@register("page_counts", sql=_page_counts_sql)
def page_counts(spark, sf_dir):
    """Pagination maximum per site (host of the page URL); -1 when a
    site's pages carry no pagination."""
    pages = _pages(spark, sf_dir).select(F.expr("parse_url(url, 'HOST')").alias("topic"),
                                         F.col("html").alias("content_raw"))
    return X.page_counts(pages)


@register("listing_meta")
def listing_meta(spark, sf_dir):
    """Question summaries of listing pages with parsed date, split tag
    and order keys (10 batches). The test pages carry no summaries, so the
    result is empty there; the goldens exercise the fields."""
    pages = _pages(spark, sf_dir).select(F.col("page_id").alias("page_nr"), F.col("html").alias("content_raw"),
                                         F.pmod(F.col("page_id"), F.lit(10)).alias("batch_id"))
    meta = X.extract_listing(pages, divisor=10, batch_col="batch_id")
    return meta.select("page_nr", "pos", "post_id", "ord_key", "ml_tag", "exit_code", "votes", "answers",
                       "views", "asked_date")
