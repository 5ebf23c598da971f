"""The learned n-gram model recovers the labels of held-out documents."""

from pyspark.sql import functions as F

from forumlens.operators import langid as LI
from forumlens.sources.tables import posts
from tests.conftest import SF_SMALL


def test_held_out_accuracy(spark):
    p = posts(spark, SF_SMALL)
    prof, meta = LI.train_profiles(p.filter(F.col("ml_tag") == 0), "text", "lang")
    test = p.filter(F.col("ml_tag") != 0)
    det = LI.detect(test.select(F.col("post_id").alias("doc_id"), "text"), prof, meta)
    rows = det.join(test.select(F.col("post_id").alias("doc_id"), F.col("lang").alias("label")), "doc_id").collect()
    assert rows
    acc = sum(r.lang == r.label for r in rows) / len(rows)
    assert acc >= 0.95
    r0 = rows[0]
    assert abs(sum(r0.lang_prob_lst) - 1.0) < 1e-9 and r0.lang == r0.lang_lst[0]


def test_char_grams(spark):
    df = spark.createDataFrame([(1, "Ab, ab!"), (2, None)], "id long, text string")
    g = {(r.id, r.gram): r.cnt for r in LI.char_grams(df, "text", ["id"], 2).collect()}
    # " ab ab " -> 1-grams a:2 b:2 (spaces dropped), 2-grams " a":2 "ab":2 "b ":2
    assert g[(1, "a")] == 2 and g[(1, "ab")] == 2 and g[(1, " a")] == 2 and g[(1, "b ")] == 2
    assert not any(k[0] == 2 for k in g)


def test_scores_match_brute_force_and_null_labels_teach_nothing(spark):
    import math
    train = [("aa b", "x"), ("ab ab", "x"), ("cc b", "y"), ("zz zz", None)]
    df = spark.createDataFrame(train, "text string, lang string")
    prof, meta = LI.train_profiles(df)
    ask = spark.createDataFrame([(1, "ab c"), (2, "zz"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in LI.detect(ask, prof, meta).collect()}

    def grams(t):
        return LI._gram_counts(f" {t} ", LI.MAX_N)
    counts = {g: sum((grams(t) for t, l in train if l == g), start=grams("")) for g in "xy"}
    every = set(counts["x"]) | set(counts["y"])
    score = {l: math.log(n / 3) + sum(k * math.log((counts[l][g] + 1) / (sum(counts[l].values()) + len(every)))
                                      for g, k in grams("ab c").items() if g in every) for l, n in (("x", 2), ("y", 1))}
    p = 1 / (1 + math.exp(score["y"] - score["x"]))
    assert got[1].lang == "x" and abs(got[1].lang_prob - p) < 1e-12 and got[1].lang_lst == ["x", "y"]
    for i in (2, 3):  # no known n-gram: the priors
        assert got[i].lang == "x" and abs(got[i].lang_prob - 2 / 3) < 1e-12
    prof, meta = LI.train_profiles(df.where("lang is null"))
    assert [r.lang for r in LI.detect(ask, prof, meta).collect()] == [None] * 3


def test_grams_are_summed_before_they_pile_up():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    letters = np.random.default_rng(2).integers(97, 107, (400, 3000)).astype(np.uint8)
    texts = [("de" if i % 3 else "en", pa.scalar(" " + row.tobytes().decode() + " ")) for i, row in enumerate(letters)]
    peak, got = [], []
    for held in (1 << 14, 1 << 40):
        tracemalloc.start()
        got.append(LI._summed_codes(iter(texts), held_codes=held))
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peak[0] < peak[1] / 5
    assert set(got[0]) == set(got[1]) == {"de", "en"}
    assert all((a == b).all() for lang in got[0] for a, b in zip(got[0][lang], got[1][lang]))
    assert sum(int(n.sum()) for _, n in got[0].values()) == 400 * (3002 + 3001 + 3000) - 800
