"""Goldens for tokenization, dictionary and bag of words."""

from pyspark.sql import functions as F

from forumlens.functions.text import default_stop_words, tokenize, with_run_lengths
from forumlens.operators import vocab as V


def _tok(spark, texts, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    return [r.t for r in df.select("id", tokenize("text", **kw).alias("t")).orderBy("id").collect()]


def test_tokenize_golden(spark):
    assert _tok(spark, ["Hello, World2x a"], stop_words=()) == [["hello", "world"]]
    # accents and digits split, single letters dropped
    assert _tok(spark, ["café naïve 3d x1y"], stop_words=()) == [["caf", "na", "ve"]]
    # lower-casing off: capitals are separators
    assert _tok(spark, ["HelloWorld abc"], to_lower_case=False, stop_words=()) == [["ello", "orld", "abc"]]
    # null and empty
    assert _tok(spark, [None, ""]) == [[], []]


def test_stop_words_removed_and_order_kept(spark):
    stops = default_stop_words()
    assert "the" in stops and "aren" in stops and "t" not in stops
    assert _tok(spark, ["the cat and the dog cat"]) == [["cat", "dog", "cat"]]
    assert _tok(spark, ["cat dog"], own_stop_words=["dog"]) == [["cat"]]


def test_run_lengths(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b", "c", "b"]), (2, [])], "id long, tokens array<string>")
    out = {r.id: [(e.token, e.cnt) for e in r.bag]
           for r in with_run_lengths(df, "tokens", "bag").collect()}
    assert out == {1: [("a", 1), ("b", 3), ("c", 1)], 2: []}


def test_dictionary_and_bow(spark):
    rows = [(1, 1, 0, ["zeta", "alpha", "zeta"]), (2, 2, 0, ["beta", "alpha"]), (3, 3, 0, ["alpha"]),
            (4, 4, 1, ["valonly", "alpha"])]
    toks = spark.createDataFrame(rows, "post_id long, ord_key long, ml_tag int, tokens array<string>")
    vocab = {r.token: (r.token_id, r.df, r.cf) for r in V.build_vocabulary(toks).collect()}
    # ids: first document's tokens alphabetically, then new tokens of later docs
    assert vocab == {"alpha": (0, 3, 3), "zeta": (1, 1, 2), "beta": (2, 1, 1)}
    assert "valonly" not in vocab
    # no_above: df <= floor(0.5 * 3) = 1 drops alpha, ids re-compacted in old order
    v2 = {r.token: r.token_id for r in V.build_vocabulary(toks, no_above=0.5).collect()}
    assert v2 == {"zeta": 0, "beta": 1}
    # keep_n keeps the most frequent by df, ties by id
    v3 = {r.token: r.token_id for r in V.build_vocabulary(toks, keep_n=2).collect()}
    assert v3 == {"alpha": 0, "zeta": 1}
    bow = {r.ord_key: (list(r.keys), list(r.values), list(r.key_tokens))
           for r in V.bag_of_words(toks, V.build_vocabulary(toks)).collect()}
    assert bow[1] == ([0, 1], [1, 2], ["alpha", "zeta"])
    assert bow[4] == ([0], [1], ["alpha"])  # applied to every split, unknown dropped
    pairs = V.bow_pairs(V.bag_of_words(toks, V.build_vocabulary(toks))).filter(F.col("ord_key") == 1).first()
    assert [(p.id, p.cnt) for p in pairs.pairs] == [(0, 1), (1, 2)]


def test_bow_counts_sum_to_known_tokens(spark):
    from forumlens.sources.tables import posts
    from tests.conftest import SF_SMALL
    toks = V.tokens_frame(posts(spark, SF_SMALL))
    vocab = V.build_vocabulary(toks)
    bow = V.bag_of_words(toks, vocab)
    known = {r.token for r in vocab.select("token").collect()}
    expect = sum(sum(1 for t in r.tokens if t in known) for r in toks.collect())
    got = bow.select(F.sum(F.aggregate("values", F.lit(0).cast("long"), lambda a, v: a + v))).first()[0]
    assert got == expect


def test_oracle_texts_need_no_jar_or_session(monkeypatch):
    import glob

    monkeypatch.setattr(glob, "glob", lambda *a, **k: (_ for _ in ()).throw(AssertionError("looked for files")))
    from forumlens.plans import registry
    assert all(registry.oracle_sql().values())


def test_text_scan_has_no_exchange(spark, tmp_path):
    import io
    from contextlib import redirect_stdout

    from forumlens.plans import registry

    for q in ("token_stats", "split_tags"):
        out = io.StringIO()
        with redirect_stdout(out):
            registry.queries()[q](spark, "/root/testdata/sf0.001").explain()
        assert "Exchange" not in out.getvalue(), q


def test_vocabulary_without_a_cap(spark):
    from forumlens.operators import vocab as V

    rows = spark.createDataFrame([(1, 1, 0, ["b", "a", "b"]), (2, 2, 0, ["c", "a"])],
                                 "post_id long, ord_key long, ml_tag int, tokens array<string>")
    got = [(r.token, r.token_id, r.df) for r in V.build_vocabulary(rows).orderBy("token_id").collect()]
    assert got == [("a", 0, 2), ("b", 1, 1), ("c", 2, 1)]


def test_anchor_forms(spark):
    from forumlens.operators.links import anchors

    html = ("""<a href='/one'>1</a><a data-href="x" href=/two>2</a><!-- <a href="/no">n</a> -->"""
            """<a href="/q?a=1&amp;b=2">&apos;3&apos;</a><a>4</a>""")
    got = spark.createDataFrame([(html,)], "h string").select(anchors("h").alias("a")).first().a
    assert [(x.text, x.href) for x in got] == [("1", "/one"), ("2", "/two"), ("'3'", "/q?a=1&b=2"), ("4", "#none#")]
