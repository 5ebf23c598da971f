"""Small API pieces: dataset store round trips, lemmas, step guards, keys."""

import os
import tempfile

from pyspark.sql import functions as F

from forumlens.functions import scalars as K
from forumlens.operators import graph as G
from forumlens.operators import outcomes as O
from forumlens.operators import posts as P
from forumlens.operators import vocab as V
from forumlens.sources import catalog, store


def test_store_round_trip(spark):
    d = tempfile.mkdtemp(prefix="fl-test-", dir="/tmp")
    df = spark.createDataFrame([("#4", "a", 1, ["x"]), ("#4", "b", 2, ["y"]), ("#5", "a", 3, [])],
                               "step string, step_label string, ord_key long, tokens array<string>")
    store.write_dataset(df, os.path.join(d, "tokens"))
    got = store.scan_step(spark, os.path.join(d, "tokens"), "#4", "a").collect()
    assert [(r.ord_key, list(r.tokens)) for r in got] == [(1, ["x"])]
    store.export_csv(df, os.path.join(d, "csv"))
    lines = spark.read.option("sep", ";").option("header", True).csv(os.path.join(d, "csv")).collect()
    assert len(lines) == 3 and any(r.tokens == '["x"]' for r in lines)
    art = spark.createDataFrame([("#5", "a", "dictionary", '{"n": 3}')],
                                "step string, step_label string, artefact_key string, artefact_value string")
    catalog.put_artefacts(art, os.path.join(d, "artefacts"))
    a = spark.read.parquet(os.path.join(d, "artefacts"))
    assert catalog.get_artefact(a, "#5", "a", "dictionary", "n int").first().value.n == 3
    assert catalog.artefacts_by_step(a, "#5", "a").count() == 1


def test_lemmas_before_stop_words(spark):
    posts = spark.createDataFrame([(1, 1, 0, "cats were running")], "post_id long, ord_key long, ml_tag int, text string")
    lem = spark.createDataFrame([("cats", "cat"), ("were", "be")], "token string, lemma string")
    t = V.tokens_frame(posts, lemmas=lem).first().tokens
    assert list(t) == ["cat", "running"]  # 'be' is a stop word after lemmatizing


def test_step_guards(spark):
    steps = spark.createDataFrame([("#1", "a", 0), ("#2", "b", 1)], "step string, step_label string, exit_code int")
    req = spark.createDataFrame([("#1", "a"), ("#2", "b"), ("#3", "c")], "step string, step_label string")
    assert {(r.step, r.step_label) for r in O.conflicting_steps(req, steps).collect()} == {("#1", "a"), ("#2", "b")}
    reuse = {r.step: r.reusable for r in O.reusable_steps(req, steps).collect()}
    assert reuse == {"#1": True, "#2": False, "#3": False}


def test_keys_stamps_lookup(spark):
    df = spark.createDataFrame([(2, "x", 7)], "step_label long, step string, ord_key long")
    r = df.select(K.composite_key("step_label", "step", "ord_key").alias("k"),
                  K.file_stamp(F.to_timestamp(F.lit("2021-02-03 04:05:06"))).alias("s"),
                  K.int_from_text(F.lit(" 1,234 views"), 6).alias("v"),
                  K.parse_ask_date(F.lit("2021-01-02 03:04:05Z")).alias("d")).first()
    assert r.k == "ord_key:7;step:x;step_label:2"
    assert r.s == "2021_02_03__04_05_06" and r.v == 1234 and str(r.d) == "2021-01-02"
    meta = spark.createDataFrame([(1, 5, "/u/a"), (1, 3, "/u/b"), (2, 1, None)], "post_id long, ord_key long, user_url string")
    docs = spark.createDataFrame([(1,), (2,), (3,)], "post_id long")
    got = {r.post_id: r.user_url for r in G.asker_lookup(meta, docs).collect()}
    assert got == {1: "/u/b", 2: None, 3: None}
    frame = spark.createDataFrame([(1, 0.25, 0.75, 4)], "post_id long, w_topic_0 double, w_topic_1 double, votes int")
    w = P.weighted_metric(frame, "votes", 2).first()
    assert (w.votes_w0, w.votes_w1) == (1.0, 3.0)


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) == {"token", "cnt", "rel", "rank"}
    assert set(E.oracle_sql()) <= set(E.queries())


def test_steps_are_made_anew_when_a_file_changes(spark, tmp_path):
    from forumlens.plans.memo import step
    made = []

    def build():
        made.append(1)
        return len(made)
    folder = str(tmp_path / "tables")
    spark.range(3).write.parquet(f"{folder}/a.parquet")
    assert [step(spark, "s", folder, build), step(spark, "s", folder, build)] == [1, 1]
    assert step(spark, "s", folder, build, "other") == 2
    spark.range(4).write.mode("overwrite").parquet(f"{folder}/a.parquet")
    assert [step(spark, "s", folder, build), step(spark, "s", folder, build)] == [3, 3]
