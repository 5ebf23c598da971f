"""Goldens for statistics, time bins, tags, links, store and formats."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from forumlens.functions import scalars as K
from forumlens.operators import formats as FM
from forumlens.operators import links as L
from forumlens.operators import outcomes as O
from forumlens.operators import stats as S
from forumlens.operators import tags as T
from forumlens.operators import timeline as TL
from forumlens.sources import landed, store


def test_moments_and_percentiles(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "x double")
    r = S.describe(df, "x").first()
    assert r.skewness == 0.768417 and r.kurtosis == -1.0
    vals = np.array([1, 2, 4, 9], dtype=float)
    for p in S.SUMMARY_PROBS:
        assert abs(r[S.prob_label(p)] - round(float(np.percentile(vals, p * 100)), 6)) < 1e-9
    assert r.n == 4 and r.std == round(float(np.std(vals, ddof=1)), 6)


def test_histogram_and_ecdf(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 1, 2, 10]], "x double")
    h = S.histogram(df, "x", 10).orderBy("bin").collect()
    counts, _ = np.histogram([0, 1, 1, 2, 10], bins=10)
    assert [r.cnt for r in h] == counts.tolist()
    assert h[-1].cum_cnt == 5
    c = S.histogram(spark.createDataFrame([(3.0,), (3.0,)], "x double"), "x", 4).collect()
    assert sum(r.cnt for r in c) == 2  # constant column: [v-0.5, v+0.5]
    assert S.ecdf_at(df, "x", 1.0).first().ecdf == 0.6


def test_time_bins(spark):
    days = [dt.date(2024, 1, 1), dt.date(2024, 1, 2), dt.date(2024, 1, 20), dt.date(2024, 1, 21)]
    df = spark.createDataFrame([(d,) for d in days] + [(None,)], "asked_date date")
    b = {r.asked_date: (r.bin, r.bin_label) for r in TL.with_time_bin(df).collect()}
    assert None not in b  # rows without a date are dropped
    assert b[dt.date(2024, 1, 1)] == (0, "[0] <=2024-01-01")
    assert b[dt.date(2024, 1, 21)][0] == 40  # maximum in the last bin
    # 20 days over 40 bins: repeated edges; day 1 -> ceil(40*1/20) = 2
    assert b[dt.date(2024, 1, 2)] == (2, "[2] 2024-01-01-2024-01-02")


def test_tags_normed_weights(spark):
    frame = spark.createDataFrame(
        [(["main", "a", "a"], 0.5, 0.5), (["main", "b"], 1.0, 0.0), (["main"], 0.0, 1.0)],
        "tags array<string>, w_topic_0 double, w_topic_1 double")
    st = {r.tag: r for r in T.tag_stats(frame, 2).collect()}
    assert st["a"].total_cnt == 2 and st["a"].total_weight_topic_0 == 1.0  # duplicate tag counts twice
    sc = {r.tag: r for r in T.tag_scores(T.tag_stats(frame, 2), "main", 2).collect()}
    assert "main" not in sc
    a = sc["a"]
    assert abs(a.normed_weight_0 + a.normed_weight_1 - 1.0) < 1e-12
    assert abs(a.normed_weight_0 - (1.0 / 1.5) / (1.0 / 1.5 + 1.0 / 1.5)) < 1e-12
    assert abs(a.score_0 - (0.3 * a.normed_weight_0 + 0.7 * 2 / 3)) < 1e-12
    top = T.top_tags_per_topic(T.tag_scores(T.tag_stats(frame, 2), "main", 2), 2, 1).collect()
    assert len(top) == 2


def test_link_types_and_report(spark):
    html = ('<p><a href="http://E.com/A.PNG">i</a><a href="/questions/1">q</a>'
            '<a href="https://stackoverflow.com/x">s</a><a href="http://x.org/y">y</a><a>n</a></p>')
    pages = spark.createDataFrame([(1, html), (2, html), (3, None)], "page_id long, html string")
    links = {(r.post_id, r.pos): (r.address, r.link_type) for r in L.page_links(pages).collect()}
    assert links[(1, 0)] == ("http://e.com/a.png", "img")
    assert links[(1, 1)] == ("/questions/1", "internal")
    assert links[(1, 2)][1] == "internal" and links[(1, 3)][1] == "std"
    assert links[(1, 4)] == ("#none#", "std")
    rep = {r.address: (r.cnt, r.n_posts) for r in L.link_report(L.page_links(pages)).collect()}
    assert rep["/questions/1"] == (2, 2)


def test_store_ops(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, ts long")
    upd = spark.createDataFrame([(2, "b2", 2), (2, "b3", 3), (3, "c", 1)], "k long, v string, ts long")
    got = {r.k: r.v for r in store.upsert(base, upd, ["k"], ["ts"]).collect()}
    assert got == {1: "a", 2: "b3", 3: "c"}
    assert store.purge(base, F.col("v") == "a").count() == 1
    found, missing = store.fetch_by_keys(base, spark.createDataFrame([(1,), (9,)], "k long"), ["k"])
    assert found.count() == 1 and [r.k for r in missing.collect()] == [9]
    docs = spark.createDataFrame([("#3", "hello World", 1), ("#3", "hello world", 2)], "step string, txt string, n int")
    assert landed.term_filter(docs, {"txt": "World"}).count() == 1  # case-sensitive whitespace token
    assert landed.term_filter(docs, {"txt": "hello", "n": 2}).count() == 1


def test_formats_and_outcomes(spark):
    bow = spark.createDataFrame([(1, 1, 0, [0, 2], [3, 1], ["x", "z"]), (2, 2, None, [1], [1], ["y"])],
                                "post_id long, ord_key long, ml_tag int, keys array<int>, values array<bigint>, key_tokens array<string>")
    t = FM.doc_format(bow, "TOKENS").collect()
    assert len(t) == 1 and t[0].doc == {"x": 3, "z": 1}  # null ml_tag drops out
    k = FM.doc_format(bow, "keys", ml_tags=[]).first().doc
    assert [(e.id, e.cnt) for e in k] == [(0, 3), (2, 1)]
    import pytest
    with pytest.raises(ValueError):
        FM.doc_format(bow, "bogus")
    oc = spark.createDataFrame([("#1", "l", i, 1 if i < 22 else 0, "m" if i < 22 else "") for i in range(30)],
                               "step string, step_label string, ord_key long, exit_code int, msg string")
    b = O.batch_summary(oc, divisor=1).first()
    assert (b.nr_failure, b.exit_code) == (22, 1)  # more than 20 failures trips the gate
    s = O.step_summary(oc.withColumn("result_class_name", F.lit("R"))).first()
    assert s.msg == "22 of 30 tasks failed." and s.exit_code == 1
    assert K.VERDICT_HIGH == "highly significant"
    v = spark.range(1).select(K.verdict(F.lit(0.97)).alias("v"), K.va_index(F.lit(1.0), F.lit(0.0), F.lit(1.0)).alias("a")).first()
    assert v.v == "significant" and abs(v.a - 1 / np.sqrt(2)) < 1e-12
