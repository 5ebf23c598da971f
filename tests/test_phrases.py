"""Phrase goldens (D5-D8) and a brute-force check of the greedy merge."""

import math
from collections import Counter

from pyspark.sql import functions as F

from forumlens.operators import phrases as PH


def _toks(spark, rows):
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(rows)], "ord_key long, ml_tag int, tokens array<string>")


def _greedy(tokens, pairs):
    out, i = [], 0
    while i < len(tokens):
        if i + 1 < len(tokens) and (tokens[i], tokens[i + 1]) in pairs:
            out.append(tokens[i] + "_" + tokens[i + 1])
            i += 2
        else:
            out.append(tokens[i])
            i += 1
    return out


def test_merge_runs_and_overlap(spark):
    ph = spark.createDataFrame([("a", "b"), ("b", "a")], "a string, b string")
    toks = _toks(spark, [["a", "b", "a", "b"], ["x", "a", "b", "a"], ["q"], []])
    got = {r.ord_key: list(r.tokens) for r in PH.apply_phrases(toks, ph).collect()}
    assert got == {0: ["a_b", "a_b"], 1: ["x", "a_b", "a"], 2: ["q"], 3: []}


def test_min_count_and_threshold(spark):
    # "new york" 20 times -> phrase; "big apple" 19 times -> below min_count
    rows = [["new", "york"]] * 20 + [["big", "apple"]] * 19 + [["new", "apple"]]
    ph = {(r.a, r.b): (r.n_ab, r.score) for r in PH.learn_phrases(_toks(spark, rows)).collect()}
    assert set(ph) == {("new", "york")}
    n = 2 * 40
    pab, pa, pb = 20 / n, 21 / n, 20 / n
    assert math.isclose(ph[("new", "york")][1], math.log(pab / (pa * pb)) / -math.log(pab), rel_tol=1e-12)
    # a threshold above the score drops it
    assert PH.learn_phrases(_toks(spark, rows), threshold=0.99).count() == 0


def test_second_pass_builds_trigram(spark):
    rows = [["new", "york", "city"]] * 25
    ext = PH.extended_tokens(_toks(spark, rows), nr_grams=3, min_count=20).collect()
    toks = list(ext[0].tokens)
    assert toks[:3] == ["new", "york", "city"]
    assert "new_york_city" in toks or "new_york" in toks


def test_greedy_merge_matches_brute_force(spark):
    from forumlens.operators.vocab import tokens_frame
    from forumlens.sources.tables import posts
    from tests.conftest import SF_SMALL
    toks = tokens_frame(posts(spark, SF_SMALL))
    ph = PH.learn_phrases(toks.filter(F.col("ml_tag") == 0), min_count=3)
    pairs = {(r.a, r.b) for r in ph.collect()}
    assert pairs, "fixture should yield phrases at min_count=3"
    got = {r.ord_key: list(r.tokens) for r in PH.apply_phrases(toks, ph).collect()}
    for r in toks.collect():
        assert got[r.ord_key] == _greedy(list(r.tokens), pairs)
    # unigram and pair counts agree with a direct count
    train = [list(r.tokens) for r in toks.filter(F.col("ml_tag") == 0).collect()]
    pc = Counter((t[i], t[i + 1]) for t in train for i in range(len(t) - 1))
    for r in ph.collect():
        assert pc[(r.a, r.b)] == r.n_ab


def test_merge_in_the_row_equals_the_merge_by_joins(spark):
    rows = [["a", "b", "a", "b", "c"], ["b", "c"], ["a"], [], None, ["a", "b", "c", "a"], ["x", "a", "a", "a", "b"], ["a", "b"]]
    toks = spark.createDataFrame([(None if i == 7 else i, 0, t) for i, t in enumerate(rows)], "ord_key long, ml_tag int, tokens array<string>")
    ph = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a"), ("b", "c")], "a string, b string")
    second = spark.createDataFrame([("a_b", "c"), ("a_b", "a_b")], "a string, b string")
    key = lambda r: (str(r.ord_key), r.tokens)
    for p in (ph, ph.limit(0)):
        row, joined = (sorted(map(key, PH.apply_phrases(toks.coalesce(1), p, most=m).collect())) for m in (10, -1))
        assert row == joined and len(row) == 8
    assert ("None", ["a", "b"]) in row
    ext, by_join = (sorted(map(key, PH.extend_by_phrases(toks, [ph, second], most=m).collect())) for m in (10, -1))
    assert ext == by_join and ("0", rows[0] + ["a_b", "a_b"]) in ext and ("5", rows[5] + ["a_b", "a_b_c"]) in ext
    twice = toks.unionByName(toks.where("ord_key in (0, 2)"))  # documents that share a key are joined
    row, joined = (sorted(map(key, PH.apply_phrases(twice, ph, most=m).collect())) for m in (10, -1))
    assert row == joined
    assert "Exchange" not in PH._merge_in_row(toks, ph, "ord_key")._jdf.queryExecution().executedPlan().toString()


def test_counting_by_hash_loses_no_pair(spark, monkeypatch):
    import numpy as np
    r = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    rows = [[words[int(i) % 400] for i in r.zipf(1.3, 60)] for _ in range(300)]
    rows += [[f"o{i}", f"p{i}"] for i in range(4000)] + [[], ["one"], None]
    toks = _toks(spark, rows)
    pairs = PH._pairs(toks).select("a", "b")
    seen = Counter((t[i], t[i + 1]) for t in rows if t for i in range(len(t) - 1))
    for low, high in ((16, 26), (16, 16)):
        monkeypatch.setattr(PH, "MIN_BITS", low)
        monkeypatch.setattr(PH, "MAX_BITS", high)
        for least in (2, 20, 300):  # over 255 the counters stop at 255
            got = Counter((x.a, x.b) for x in PH.reachable(pairs, least, sum(seen.values())).collect())
            assert all(got[p] == n for p, n in seen.items() if n >= least) and all(seen[p] == n for p, n in got.items())
            assert sum(got.values()) < sum(seen.values()) / 1.2
    assert sum(1 for p in got if p[0].startswith("o")) < 200
    exact = PH.learn_phrases(toks, 20, -1.0).collect()
    monkeypatch.setattr(PH, "reachable", lambda pairs, *_: pairs)
    assert sorted(exact) == sorted(PH.learn_phrases(toks, 20, -1.0).collect()) and exact
    assert PH.learn_phrases(toks.limit(0)).count() == 0
