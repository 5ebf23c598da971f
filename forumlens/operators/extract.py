"""HTML extraction jobs.

Each job is column expressions over the elements of ``functions/markup.py``, all
in the row: no Python and, but for the listing's order keys, no shuffle.
Every row yields exactly one outcome: a failure
keeps ``exit_code = 1`` and the message, with null data (nothing is dropped).
Class tests are class-token membership.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forumlens.functions import markup as M
from forumlens.functions.scalars import split_tag
from forumlens.operators.assort import with_dense_index
from forumlens.operators.links import ANCHOR_RE

# The page layout the parser expects (overridable profile).
FORUM_PROFILE = {
    "summary_class": "question-summary",
    "summary_id_prefix_len": 17,
    "question_link_class": "question-hyperlink",
    "vote_count_class": "vote-count-post",
    "views_class": "views",
    "status_class": "status",
    "excerpt_class": "excerpt",
    "action_time_class": "user-action-time",
    "user_details_class": "user-details",
    "tags_class": "tags",
    "pagination_class": "s-pagination--item",
    "pagination_title": "go to page",
    "question_id": "question",
    "postcell_class": "postcell",
    "body_classes": ("s_prose", "s-prose", "js-post-body"),
    "comments_class": "comments",
    "comment_class": "comment",
    "comment_user_class": "comment-user",
    "comment_date_class": "relativetime-clean",
    "comment_copy_class": "comment-copy",
    "answers_id": "answers",
    "answer_class": "answer",
    "accepted_class": "accepted-answer",
    "vote_class": "js-vote-count",
    "answer_meta_class": "mt24",
    "user_prefix": "/users",
}
# Output templates, markers and messages.
LINK_TEMPLATE = '<a id="{id}" href="{href}">\n{content}\n</a>'
NO_HREF = "#none#"
MSG_MULTI_QUESTION = "Multiple questions found in post {post_id}"
MSG_NO_QUESTION = "No question found in post {post_id}"
MSG_BAD_VOTE = "A vote that is no number in post {post_id}"

COMMENT_FIELDS = [
    T.StructField("comment_lst_raw", T.ArrayType(T.StringType())),
    T.StructField("comment_lst", T.ArrayType(T.StringType())),
    T.StructField("comment_user_url_lst", T.ArrayType(T.StringType())),
    T.StructField("comment_date_lst", T.ArrayType(T.TimestampType())),
    T.StructField("comment_link_lst", T.ArrayType(T.StringType())),
]
ANSWER = T.StructType([
    T.StructField("answer_raw", T.StringType()),
    T.StructField("answer_txt", T.StringType()),
    T.StructField("answer_links", T.StringType()),
    T.StructField("user_url", T.StringType()),
    T.StructField("user_name", T.StringType()),
    T.StructField("answer_date", T.TimestampType()),
    T.StructField("answer_vote", T.IntegerType()),
    T.StructField("is_accepted_answer", T.BooleanType()),
    *COMMENT_FIELDS,
])
QUESTION_INFO = T.StructType([
    T.StructField("post_id", T.LongType()),
    T.StructField("ord_key", T.LongType()),
    T.StructField("ml_tag", T.IntegerType()),
    T.StructField("exit_code", T.IntegerType()),
    T.StructField("exit_msg", T.StringType()),
    T.StructField("question_raw", T.StringType()),
    T.StructField("question_txt", T.StringType()),
    T.StructField("question_links", T.StringType()),
    T.StructField("code_pieces", T.StringType()),
    *COMMENT_FIELDS,
    T.StructField("answers", T.ArrayType(ANSWER)),
    T.StructField("answer_count", T.IntegerType()),
    T.StructField("comment_count", T.IntegerType()),
    T.StructField("total_comment_count", T.IntegerType()),
])
POST_META = T.StructType([
    T.StructField("page_nr", T.LongType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("post_id", T.LongType()),
    T.StructField("exit_code", T.IntegerType()),
    T.StructField("exit_msg", T.StringType()),
    T.StructField("post_url", T.StringType()),
    T.StructField("heading", T.StringType()),
    T.StructField("excerpt", T.StringType()),
    T.StructField("asked_date_raw", T.StringType()),
    T.StructField("votes", T.IntegerType()),
    T.StructField("answers", T.IntegerType()),
    T.StructField("answer_status", T.StringType()),
    T.StructField("views", T.IntegerType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("user", T.StringType()),
    T.StructField("user_url", T.StringType()),
])


def _links(block: Column) -> Column:
    """The anchors of a block as (href, text)."""
    return F.transform(F.regexp_extract_all(F.coalesce(block, F.lit("")), F.lit(ANCHOR_RE), 0), lambda a: F.struct(
        F.coalesce(M.attribute(a, "href"), F.lit(NO_HREF)).alias("href"), M.only_text(a).alias("text")))


def _listed(links: Column, first: Column) -> Column:
    """The links as text, numbered from ``first`` on."""
    head, between, middle, end = re.split(r"\{\w+\}", LINK_TEMPLATE)
    return F.array_join(F.transform(links, lambda a, i: F.concat(
        F.lit(head + "link_id_"), (first + i).cast("string"), F.lit(between), a["href"], F.lit(middle), a["text"],
        F.lit(end))), "\n")


def _without_links(block: Column) -> Column:
    return M.stripped(M.text(F.regexp_replace(block, ANCHOR_RE, "")))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda acc, n: acc + n)


def _or_none(a: Column) -> Column:
    return F.coalesce(a, F.array().cast("array<string>"))


def _comment(item: Column, p: dict) -> Column:
    """A comment's source, its text block, its user and its time."""
    stamp = M.attribute(M.last(M.elements(item, "span", p["comment_date_class"])), "title")
    return F.struct(
        F.concat(item, F.lit("</li>")).alias("raw"), M.last(M.elements(item, "span", p["comment_copy_class"])).alias("copy"),
        M.attribute(M.last(M.elements(item, "a", p["comment_user_class"])), "href").alias("user"),
        M.time(M.first(F.split(stamp, ","))).alias("date"))


def _post_part(html: Column, i: Column, p: dict) -> Column:
    """The question (part 0) or an answer: its body, its comments and what only answers have."""
    cells = F.flatten(F.transform(M.elements(html, "div", p["postcell_class"]), lambda c: M.elements(c, "div", p["body_classes"])))
    body = M.last(F.when(i == 0, cells).otherwise(M.elements(html, "div", p["body_classes"])))
    comments = F.transform(_or_none(M.elements(M.last(M.elements(html, "div", p["comments_class"])), "li", p["comment_class"])),
                           lambda c: _comment(c, p))
    profiles = F.transform(M.elements(html, "div", p["user_details_class"]), lambda d: M.first(F.filter(
        M.elements(d, "a"), lambda a: F.startswith(M.attribute(a, "href"), F.lit(p["user_prefix"])))))
    vote = M.last(M.elements(html, "div", p["vote_class"]))
    return F.struct(
        body.alias("body"), comments.alias("comments"), M.last(profiles).alias("user"),
        M.time(M.attribute(M.first(M.elements(M.last(M.elements(html, "div", p["action_time_class"])), "span")), "title")).alias("date"),
        vote.isNotNull().alias("voted"), F.trim(M.attribute(vote, "data-value")).try_cast("int").alias("vote"),
        F.coalesce(F.array_contains(M.classes(html), p["accepted_class"]), F.lit(False)).alias("accepted"))


def _finished(part: Column, p: dict) -> Column:
    """A part's fields, with its links numbered from ``part.first`` on: the body's, then each comment's."""
    links = part["links"]

    def comment_links(c: Column, j: Column) -> Column:
        before = part["first"] + _sum(F.transform(F.slice(links, 1, j + 1), F.size))
        return F.when(c["copy"].isNotNull(), _listed(F.get(links, j + 1), before))

    comments = part["comments"]
    return F.struct(
        F.concat(part["body"], F.lit("</div>")).alias("answer_raw"), _without_links(part["body"]).alias("answer_txt"),
        _listed(F.get(links, F.lit(0)), part["first"]).alias("answer_links"), M.attribute(part["user"], "href").alias("user_url"),
        M.text(part["user"]).alias("user_name"), part["date"].alias("answer_date"), part["vote"].alias("answer_vote"),
        part["accepted"].alias("is_accepted_answer"),
        F.transform(comments, lambda c: c["raw"]).alias("comment_lst_raw"),
        F.transform(comments, lambda c: _without_links(c["copy"])).alias("comment_lst"),
        F.transform(comments, lambda c: c["user"]).alias("comment_user_url_lst"),
        F.transform(comments, lambda c: c["date"]).alias("comment_date_lst"),
        F.transform(comments, comment_links).alias("comment_link_lst"))


def parse_posts(raw: DataFrame, html_col: str = "content_raw", profile: dict | None = None) -> DataFrame:
    """C6-C11 + C13 over (post_id, ord_key, ml_tag, <html>): one ``QUESTION_INFO`` row per input row.

    Link ids run through the page: the question's body and comments, then each answer's. A page
    without a question (null or empty too), with two of them, or with a vote that is no number
    fails with exit_code 1, a message and null fields. All of it stays in the row: no shuffle."""
    p = dict(FORUM_PROFILE, **(profile or {}))
    keys = ["post_id", "ord_key", "ml_tag"]
    html = M.uncommented(F.col(html_col))
    d = raw.select(F.col("post_id").cast("long"), F.col("ord_key").cast("long"), F.col("ml_tag").cast("int"),
                   M.elements(html, "code").alias("codes"), M.numbered(html, "code", "code").alias("html"))
    d = d.select(*keys, "codes", M.elements(F.col("html"), "div", own_id=p["question_id"]).alias("asked"),
                 M.elements(F.col("html"), "div", own_id=p["answers_id"]).alias("replies"))
    answers = _or_none(M.elements(M.first(F.col("replies")), "div", p["answer_class"]))
    d = d.select(*keys, "codes", (F.greatest(F.size("asked"), F.size("replies")) > 1).alias("several"), F.transform(
        F.concat(F.array(M.first(F.col("asked"))), answers), lambda h, i: _post_part(h, i, p)).alias("parts"))
    d = d.withColumn("parts", F.transform("parts", lambda x: x.withField(
        "links", F.concat(F.array(_links(x["body"])), F.transform(x["comments"], lambda c: _links(c["copy"]))))))
    d = d.withColumn("counts", F.transform("parts", lambda x: _sum(F.transform(x["links"], F.size))))
    d = d.withColumn("parts", F.transform("parts", lambda x, i: x.withField("first", _sum(F.slice("counts", F.lit(1), i)))))
    question, shown = F.get("parts", F.lit(0)), F.col("post_id").cast("string")

    def message(template: str) -> Column:
        return F.concat(F.lit(template.split("{")[0]), shown)

    d = d.select(*keys, F.when(F.col("several"), message(MSG_MULTI_QUESTION)).when(
        question["body"].isNull(), message(MSG_NO_QUESTION)).when(
        F.exists("parts", lambda x: x["voted"] & x["vote"].isNull()), message(MSG_BAD_VOTE)).otherwise("").alias("exit_msg"),
        F.transform("codes", lambda c, i: F.concat(
            F.lit("<code id=code_"), i.cast("string"), F.lit(">\n"), M.only_text(c), F.lit("\n</code>"))).alias("codes"),
        F.transform("parts", lambda x: _finished(x, p)).alias("parts"))
    q, own = F.get("parts", F.lit(0)), F.size(F.get("parts", F.lit(0))["comment_lst"])
    made = {"question_raw": q["answer_raw"], "question_txt": q["answer_txt"], "question_links": q["answer_links"],
            "code_pieces": F.array_join("codes", "\n"), **{f.name: q[f.name] for f in COMMENT_FIELDS},
            "answers": F.slice("parts", F.lit(2), F.greatest(F.size("parts"), F.lit(1))), "answer_count": F.size("parts") - 1,
            "comment_count": own, "total_comment_count": _sum(F.transform("parts", lambda x: F.size(x["comment_lst"])))}
    good = F.col("exit_msg") == ""
    return d.select(*keys, F.when(good, 0).otherwise(1).alias("exit_code"), "exit_msg",
                    *[F.when(good, made[f.name]).cast(f.dataType).alias(f.name) for f in QUESTION_INFO.fields[5:]])


# The numbers that a question summary must have.
LISTING_NEEDS = ("votes", "answers", "views")


def listing_meta(pages: DataFrame, p: dict = FORUM_PROFILE) -> DataFrame:
    """A record for each question summary of (page_nr, batch_id, html), with its position on
    the page. A missing field is null; a record that lacks its id or a required number fails
    with exit_code 1, a message and null fields."""
    def part(tag: str, hook: str) -> Column:
        return M.last(M.elements(F.col("s"), tag, p[hook]))

    def number(c: Column) -> Column:
        return F.trim(c).try_cast("int")

    found = M.elements(M.uncommented(F.col("html")), "div", p["summary_class"])
    s = pages.select("page_nr", "batch_id", F.posexplode(found).alias("pos", "s"))
    blocks = {"link": ("a", "question_link_class"), "vote": ("span", "vote_count_class"), "view": ("div", "views_class"),
              "status": ("div", "status_class"), "body": ("div", "excerpt_class"), "when": ("div", "action_time_class"),
              "who": ("div", "user_details_class"), "tag": ("div", "tags_class")}
    own_id = F.substring(M.attribute(F.col("s"), "id"), F.lit(p["summary_id_prefix_len"] + 1), F.lit(20)).try_cast("long")
    s = s.select("page_nr", "batch_id", F.col("pos").cast("int").alias("pos"), F.coalesce(own_id, F.lit(-1)).alias("post_id"),
                 *[part(*where).alias(f"b_{name}") for name, where in blocks.items()])
    b = {name: F.col(f"b_{name}") for name in blocks}
    state = F.filter(F.split(M.attribute(b["status"], "class"), r"\s+"), lambda c: (c != p["status_class"]) & (c != ""))
    fields = {
        "post_url": M.attribute(b["link"], "href"), "heading": M.text(b["link"]),
        "excerpt": F.array_join(M.pieces(b["body"]), ""),
        "asked_date_raw": M.attribute(M.first(M.elements(b["when"], "span")), "title"),
        "votes": number(M.text(M.first(M.elements(b["vote"], "strong")))),
        "answers": number(M.text(M.first(M.elements(b["status"], "strong")))), "answer_status": M.first(state),
        "views": F.regexp_replace(M.attribute(b["view"], "title"), "[^0-9-]", "").try_cast("int"),
        "tags": F.transform(M.elements(b["tag"], "a"), M.text),
        "user": M.first(M.pieces(b["who"])), "user_url": M.attribute(M.first(M.elements(b["who"], "a")), "href")}
    s = s.select("page_nr", "batch_id", "pos", "post_id", *[c.alias(name) for name, c in fields.items()])
    lacks = F.when(F.col("post_id") < 0, "a summary without a post id")
    for name in LISTING_NEEDS:
        lacks = lacks.when(F.col(name).isNull(), F.concat(F.lit(f"missing {name} for post "), "post_id"))
    s = s.withColumn("exit_msg", F.coalesce(lacks, F.lit("")))
    good = F.col("exit_msg") == ""
    return s.select("batch_id", "page_nr", "pos", "post_id", F.when(good, 0).otherwise(1).alias("exit_code"), "exit_msg",
                    *[F.when(good, F.col(f.name)).alias(f.name) for f in POST_META.fields if f.name in fields])


def extract_listing(pages: DataFrame, html_col: str = "content_raw", profile: dict | None = None,
                    test_fraction: float = 0.15, val_fraction: float = 0.15, divisor: int = 1,
                    batch_col: str | None = None) -> DataFrame:
    """Listing pages (page_nr, <html>) -> one post_meta row per
    summary, with asked_date parsed, a split tag and order keys
    (``batch + divisor * (row number within the batch - 1)``)."""
    p = dict(FORUM_PROFILE, **(profile or {}))
    src = pages.select(F.col("page_nr").cast("long"), F.col(html_col).alias("html"),
                       (F.col(batch_col) if batch_col else F.lit(0)).cast("long").alias("batch_id"))
    # Row numbers within a batch are global positions less the batch's first one: no
    # window over a batch, however many posts it has.
    meta = with_dense_index(listing_meta(src, p), ["batch_id", "page_nr", "pos", "post_id"], "__i")
    first = meta.groupBy("batch_id").agg(F.min("__i").alias("__first"))
    asked = F.to_date(F.try_to_timestamp(F.col("asked_date_raw"), F.lit("yyyy-MM-dd HH:mm:ssX")))
    return (meta.join(first, "batch_id")
            .withColumn("ord_key", F.col("batch_id") + F.lit(divisor) * (F.col("__i") - F.col("__first")))
            .withColumn("asked_date", asked)
            .withColumn("ml_tag", split_tag("post_id", test_fraction, val_fraction)).drop("__i", "__first"))


def page_count(html: Column, p: dict = FORUM_PROFILE) -> Column:
    """Largest page number in the pagination of an HTML text; -1 when none or not a number."""
    def attribute(a: Column, name: str) -> Column:
        return F.regexp_extract(a, rf'(?is)^<a\s(?:[^>]*?\s)?{name}\s*=\s*"([^"]*)"', 1)

    def is_page(a: Column) -> Column:
        return (F.array_contains(F.split(attribute(a, "class"), r"\s+"), p["pagination_class"])
                & F.contains(F.lower(attribute(a, "title")), F.lit(p["pagination_title"])))

    def number(a: Column) -> Column:
        text = F.regexp_replace(F.regexp_extract(a, r"(?is)^<a[^>]*>(.*)</a>$", 1), "<[^>]*>", "")
        return F.coalesce(F.trim(text).try_cast("int"), F.lit(-1))

    links = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<a(?:\s[^>]*)?>.*?</a>"), 0)
    return F.coalesce(F.array_max(F.transform(F.filter(links, is_page), number)), F.lit(-1))


def page_counts(pages: DataFrame, html_col: str = "content_raw", topic_col: str = "topic",
                profile: dict | None = None) -> DataFrame:
    """Per topic the largest page number found (-1 when none)."""
    p = dict(FORUM_PROFILE, **(profile or {}))
    return pages.groupBy(F.col(topic_col).cast("string").alias("topic")).agg(
        F.max(page_count(F.col(html_col), p)).alias("nr_pages"))


def separate_page_links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """C7 over whole pages: (id, n_links, links, text_len): the anchors of a page numbered, with their
    hrefs and single texts, and the length of what text is left without them."""
    html = M.uncommented(F.col(html_col))
    found = _links(html)
    p = pages.select(F.col(id_col).cast("long").alias("post_id"), found.alias("found"),
                     _without_links(html).alias("rest"))

    return p.select("post_id", F.size("found").alias("n_links"), _listed(F.col("found"), F.lit(0)).alias("links"),
                    F.length("rest").alias("text_len"))


def comment_count_expr(answers_col: str = "answers"):
    """C11 as a Column: question comments + comments of every answer."""
    return F.size("comment_lst") + F.aggregate(F.col(answers_col), F.lit(0),
                                               lambda s, a: s + F.size(a["comment_lst"]))


def answers_view(info: DataFrame) -> DataFrame:
    """One row per answer (position kept), for per-answer reports."""
    return info.select("post_id", "ord_key", F.posexplode_outer("answers").alias("answer_pos", "answer"))


def question_text_all(info: DataFrame) -> DataFrame:
    """B7 (base_content='all'): question, its comments, the answers and each
    answer's comments (joined by a space inside the answer) joined by a space.
    Null pieces are skipped (the reference fails on them)."""
    pieces = F.concat(F.array(F.col("question_txt")), F.coalesce(F.col("comment_lst"), F.array()),
                      F.transform("answers", lambda a: a["answer_txt"]),
                      F.transform("answers", lambda a: F.array_join(a["comment_lst"], " ")))
    return info.select("post_id", "ord_key", "ml_tag", F.array_join(pieces, " ").alias("text"))
