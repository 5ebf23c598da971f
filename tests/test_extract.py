"""Goldens for the HTML jobs (C1-C13) on hand-written forum pages."""

from datetime import datetime, timezone

from forumlens.operators import extract as X

POST = """<html><body>
<div id="question">
  <div class="postcell">
    <div class="s-prose js-post-body"><p>How to <a href="/x">link one</a> and <a>no href</a>?</p><code>print(1)</code><pre><code>a<b>b</b></code></pre></div>
  </div>
  <div class="comments"><ul>
    <li class="comment"><span class="comment-copy">see <a href="http://e.com/a.PNG">img</a></span> <a class="comment-user">anon</a> <span class="relativetime-clean" title="2021-03-04 05:06:07Z, License: CC">Mar 4</span></li>
  </ul></div>
</div>
<div id="answers">
  <div class="answer accepted-answer">
    <div class="js-vote-count" data-value="5">5</div>
    <div class="s-prose js-post-body">Answer <a href="/questions/1">q1</a></div>
    <div class="mt24"><div class="user-action-time"><span title="2021-03-05 00:00:00Z">x</span></div><div class="user-details"><a href="/users/7/bob">bob</a></div></div>
    <div class="comments"><ul><li class="comment"><span class="comment-copy">c2</span><a class="comment-user" href="/users/8">u8</a><span class="relativetime-clean" title="bad">x</span></li></ul></div>
  </div>
  <div class="answer">
    <div class="js-vote-count" data-value="0">0</div>
    <div class="s-prose">Second</div>
  </div>
</div>
</body></html>"""

LISTING = """<html><body>
<div class="question-summary" id="question-summary-101">
 <div class="votes"><span class="vote-count-post "><strong>3</strong></span></div>
 <div class="status answered-accepted"><strong>2</strong></div>
 <div class="views" title="1,234 views">1k</div>
 <h3><a class="question-hyperlink" href="/questions/101/x">Title 1</a></h3>
 <div class="excerpt"> Some excerpt </div>
 <div class="tags"><a>python</a><a>spark</a></div>
 <div class="user-action-time"><span title="2021-01-02 03:04:05Z">x</span></div>
 <div class="user-details"><a href="/users/1/al">al</a> <span>10</span></div>
</div>
<div class="question-summary" id="question-summary-102">
 <div class="votes"><span class="vote-count-post"><strong>0</strong></span></div>
 <div class="status unanswered"><strong>0</strong></div>
 <div class="views" title="12 views">12</div>
 <div class="user-action-time"><span title="yesterday">x</span></div>
</div>
<a class="s-pagination--item" title="Go to page 2">2</a>
<a class="s-pagination--item" title="go to page 10">10</a>
<a class="s-pagination--item" title="Go to page next">next</a>
</body></html>"""


def _parsed(spark, html, post_id):
    raw = spark.createDataFrame([(post_id, 0, 0, html)], "post_id long, ord_key long, ml_tag int, content_raw string")
    return X.parse_posts(raw).first()


def _utc(d):
    return d.astimezone(timezone.utc)


def test_parse_post_golden(spark):
    d = _parsed(spark, POST, 5)
    assert d["code_pieces"] == "<code id=code_0>\nprint(1)\n</code>\n<code id=code_1>\n\n</code>"
    assert d["question_txt"] == "How to  and ?"
    assert d["question_links"] == ('<a id="link_id_0" href="/x">\nlink one\n</a>\n'
                                   '<a id="link_id_1" href="#none#">\nno href\n</a>')
    assert d["comment_lst"] == ["see"]
    assert d["comment_user_url_lst"] == [None]
    assert [_utc(x) for x in d["comment_date_lst"]] == [datetime(2021, 3, 4, 5, 6, 7, tzinfo=timezone.utc)]
    assert d["comment_link_lst"] == ['<a id="link_id_2" href="http://e.com/a.PNG">\nimg\n</a>']
    a1, a2 = d["answers"]
    assert a1["is_accepted_answer"] and not a2["is_accepted_answer"]
    assert (a1["answer_vote"], a1["answer_txt"], a1["user_url"], a1["user_name"]) == (5, "Answer", "/users/7/bob", "bob")
    assert a1["answer_links"] == '<a id="link_id_3" href="/questions/1">\nq1\n</a>'
    assert _utc(a1["answer_date"]) == datetime(2021, 3, 5, tzinfo=timezone.utc)
    assert a1["comment_lst"] == ["c2"] and a1["comment_user_url_lst"] == ["/users/8"]
    assert a1["comment_date_lst"] == [None]
    assert (a2["answer_vote"], a2["answer_txt"], a2["user_url"]) == (0, "Second", None)
    assert (d["answer_count"], d["comment_count"], d["total_comment_count"]) == (2, 1, 2)


def test_parse_post_failures(spark):
    no = _parsed(spark, "<html><body><p>x</p></body></html>", 1)
    assert (no.exit_code, no.exit_msg, no.question_txt, no.answers) == (1, "No question found in post 1", None, None)
    two = '<div id="question"><div class="postcell"><div class="s-prose">a</div></div></div>' * 2
    assert _parsed(spark, two, 7).exit_msg == "Multiple questions found in post 7"
    bad = _parsed(spark, POST.replace('data-value="0"', 'data-value="many"'), 9)
    assert (bad.exit_code, bad.exit_msg, bad.answer_count) == (1, "A vote that is no number in post 9", None)


def test_parse_post_sources_and_odd_forms(spark):
    """The source of each body and comment is kept, code emptied; single quotes, unclosed items, entities,
    comments without a text, an answer without a body, HTML comments."""
    d = _parsed(spark, POST, 5)
    assert d.question_raw.startswith('<div class="s-prose js-post-body"><p>How to <a href="/x">')
    assert d.question_raw.endswith('<code id="code_0"></code><pre><code id="code_1"></code></pre></div>')
    assert d.comment_lst_raw[0].startswith('<li class="comment">') and d.comment_lst_raw[0].endswith("</li>")
    odd = """<div id='question'><div class='x postcell y'><div class='js-post-body'>1 &lt; 2<!-- <a href="/no">no</a> --></div></div>
    <div class="comments"><ul><li class="comment big"><span class="comment-copy"><a href="/1">1</a> <a href="/2">2</a></span>
    <li class="comment"><b>no text</b><li class="comment"><span class="comment-copy">z <a href="/3">3</a></span></ul></div></div>
    <div id="answers"><div class="answer"><div class="js-vote-count" data-value=" -3 "></div>
    <div class="user-details"><a href="/other">o</a><a href="/users/2">two &amp; co</a></div></div>
    <div class="answer"><div class="s_prose"><a href="/4">4</a></div></div></div>"""
    o = _parsed(spark, odd, 8)
    assert (o.exit_code, o.question_txt, o.question_links, o.code_pieces) == (0, "1 < 2", "", "")
    assert o.comment_lst == ["", None, "z"] and o.comment_count == 3
    assert o.comment_link_lst == ['<a id="link_id_0" href="/1">\n1\n</a>\n<a id="link_id_1" href="/2">\n2\n</a>', None,
                                  '<a id="link_id_2" href="/3">\n3\n</a>']
    a, b = o.answers
    assert (a.answer_raw, a.answer_txt, a.answer_links, a.answer_vote) == (None, None, "", -3)
    assert (a.user_url, a.user_name, a.comment_lst) == ("/users/2", "two & co", [])
    assert b.answer_links == '<a id="link_id_3" href="/4">\n4\n</a>' and b.answer_vote is None


ODD_LISTING = """<div class="question-summary" id="question-summary-7"><div class="views" title="1 view">1</div></div>
<!-- <div class="question-summary" id="question-summary-8"></div> -->
<div class='narrow question-summary' id='question-summary-9'><p>open <div><div class="status"><strong> 4</strong></div></div>
<span class="vote-count-post"><strong>-2</strong></span><div class="views" title="3 views"></div>
<div class="excerpt"> a <b> &lt;b&gt; </b> c </div><a class="question-hyperlink" href="/q?a=1&amp;b=2">A &amp; <i>B</i></a></div>
<div class="user-details">outside</div><div class="question-summary" id="none"></div>
<div class="question-summary-wide" id="question-summary-11"></div>"""


def test_listing_and_pages(spark):
    pages = spark.createDataFrame([(1, 0, LISTING), (2, 0, ODD_LISTING), (3, 0, None), (4, 0, "")],
                                  "page_nr long, batch_id long, html string")
    recs = {(r.page_nr, r.pos): r for r in X.listing_meta(pages).collect()}
    assert sorted(recs) == [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2)]
    r1, r2 = recs[1, 0], recs[1, 1]
    assert (r1["post_id"], r1["votes"], r1["answers"], r1["views"], r1["answer_status"]) == (101, 3, 2, 1234, "answered-accepted")
    assert (r1["post_url"], r1["heading"], r1["excerpt"]) == ("/questions/101/x", "Title 1", "Some excerpt")
    assert r1["tags"] == ["python", "spark"] and (r1["user"], r1["user_url"]) == ("al", "/users/1/al")
    assert r2["tags"] is None and r2["views"] == 12 and r2["answer_status"] == "unanswered"
    # a field missing, nested and unclosed tags, single quotes, entities, what lies outside, no id
    r3, r4, r5 = recs[2, 0], recs[2, 1], recs[2, 2]
    assert (r3.exit_code, r3.exit_msg, r3.views) == (1, "missing votes for post 7", None)
    assert (r4.post_id, r4.exit_code, r4.votes, r4.answers, r4.answer_status, r4.views) == (9, 0, -2, 4, None, 3)
    assert (r4.excerpt, r4.heading, r4.post_url, r4.user) == ("a<b>c", "A & B", "/q?a=1&b=2", None)
    assert (r5.post_id, r5.exit_code) == (-1, 1) and "without a post id" in r5.exit_msg


def test_links_of_pages(spark):
    html = """<p>see <a href='/x'>one</a><!-- <a href="/no">n</a> --> and <a>two <b>three</b></a><a href="/y"><b>four</b></a></p>"""
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    r = {x.post_id: x for x in X.separate_page_links(pages).collect()}
    assert (r[1].n_links, r[1].text_len) == (3, len("see  and"))
    assert r[1].links == ('<a id="link_id_0" href="/x">\none\n</a>\n<a id="link_id_1" href="#none#">\n\n</a>\n'
                          '<a id="link_id_2" href="/y">\nfour\n</a>')
    assert (r[2].n_links, r[2].links, r[2].text_len) == (0, "", 0)


def test_spark_jobs(spark):
    from pyspark.sql import functions as F
    raw = spark.createDataFrame([(5, 0, 0, POST), (6, 1, 0, "<p>none</p>"), (7, 2, 1, None)],
                                "post_id long, ord_key long, ml_tag int, content_raw string")
    info = {r.post_id: r for r in X.parse_posts(raw).collect()}
    assert info[5].exit_code == 0 and info[5].answer_count == 2
    assert info[5].answers[0].comment_date_lst == [None]
    assert info[6].exit_code == 1 and "No question" in info[6].exit_msg and info[6].answers is None
    assert info[7].exit_code == 1
    txt = X.question_text_all(X.parse_posts(raw).filter("exit_code = 0")).first().text
    assert txt == "How to  and ? see Answer Second c2 "
    n = X.parse_posts(raw).select(X.comment_count_expr().alias("n")).filter(F.col("n").isNotNull()).first().n
    assert n == 2
    pages = spark.createDataFrame([(1, LISTING), (2, LISTING)], "page_nr long, content_raw string")
    meta = X.extract_listing(pages, divisor=1).orderBy("ord_key").collect()
    assert [m.ord_key for m in meta] == [0, 1, 2, 3]
    assert meta[0].asked_date.isoformat() == "2021-01-02" and meta[1].asked_date is None
    # two topics may share a page number: no row is multiplied
    shared = spark.createDataFrame([(1, LISTING, 0), (1, LISTING, 1)], "page_nr long, content_raw string, b long")
    meta = X.extract_listing(shared, divisor=2, batch_col="b").collect()
    assert sorted((m.batch_id, m.ord_key) for m in meta) == [(0, 0), (0, 2), (1, 1), (1, 3)]
    pc = X.page_counts(spark.createDataFrame([("t", LISTING), ("t", "<p/>"), ("u", "<p/>")],
                                             "topic string, content_raw string"))
    assert {r.topic: r.nr_pages for r in pc.collect()} == {"t": 10, "u": -1}


def test_post_links_and_report(spark):
    from forumlens.operators import links as L
    raw = spark.createDataFrame([(5, 0, 0, POST)], "post_id long, ord_key long, ml_tag int, content_raw string")
    info = X.parse_posts(raw)
    rows = L.post_links(info).orderBy("pos").collect()
    assert [(r.address, r.source, r.link_type) for r in rows] == [
        ("/x", "question", "internal"), ("#none#", "question", "std"),
        ("http://e.com/a.png", "comment", "img"), ("/questions/1", "answer", "internal")]
    assert rows[3].answer_vote == 5 and rows[0].answer_vote is None
    stats = spark.createDataFrame([(5, 7, 100)], "post_id long, votes int, views int")
    rep = {r.address: r for r in L.link_report(L.post_links(info), stats).collect()}
    assert rep["/questions/1"].answers_votes_total == 5 and rep["/x"].answers_votes_total == 0
    assert rep["/x"].question_votes_total == 7 and rep["/x"].views_total == 100
