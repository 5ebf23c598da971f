"""Keyed datasets, text assembly, strong components on chains, in-row bags and language scores."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from forumlens.operators import assemble as AM
from forumlens.operators import graph_iter as GI
from forumlens.operators import langid as LI
from forumlens.operators import vocab as V
from forumlens.sources import keyed as KD
from forumlens.sources.scratch import discard, scratch


def files_of(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/data/*/*/*.parquet")}


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_keyed_upsert_and_purge(spark, tmp_path):
    path = str(tmp_path / "store" / "a")
    schema = "id long, name string, at int, modus string"
    base = spark.createDataFrame([(i, f"n{i}", 0, "test" if i % 10 == 0 else "prod") for i in range(200)]
                                 + [(5, "later", 1, "prod")], schema)
    d = KD.create(base, path, ["id"], ["at"], buckets=32)
    state = {r.id: (r.name, r.at, r.modus) for r in d.read().collect()}
    assert len(state) == 200 and state[5][0] == "later"
    before = files_of(path)

    upd = spark.createDataFrame([(7, "seven", 1, "prod"), (7, "seven again", 2, "test"), (1000, "new", 1, "prod")], schema)
    d2 = d.upsert(upd, ["at"])
    state |= {7: ("seven again", 2, "test"), 1000: ("new", 1, "prod")}
    assert {r.id: (r.name, r.at, r.modus) for r in KD.open_dataset(spark, path).read().collect()} == state
    assert {r.id for r in d.read().collect()} == set(range(200))  # the earlier version still reads as it was
    touched = {b for b in d.folders if d.folders[b] != d2.folders[b]}
    assert 1 <= len(touched) <= 2
    assert {f: t for f, t in files_of(path).items() if f in before} == before  # no file was changed
    assert all(d2.folders[b] == d.folders[b] for b in set(d.folders) - touched)
    assert rows_of(d2.fetch(spark.createDataFrame([(7,), (3,), (99999,)], "id long")).select("id")) == [(3,), (7,)]

    other = KD.create(spark.createDataFrame([(1, "x")], "id long, name string"), str(tmp_path / "store" / "b"), ["id"], ["name"], 4)
    assert KD.purge_everywhere(spark, str(tmp_path / "store"), "modus", "test") == {"a": True}
    state = {k: v for k, v in state.items() if v[2] != "test"}
    last = KD.open_dataset(spark, path)
    assert {r.id: (r.name, r.at, r.modus) for r in last.read().collect()} == state and other.read().count() == 1
    assert KD.purge_everywhere(spark, str(tmp_path / "store"), "modus", "nothing") == {"a": False}
    assert KD.vacuum(last) > 0 and {r.id for r in KD.open_dataset(spark, path).read().collect()} == set(state)
    gone = last.purge(F.lit(True))
    assert gone.read().count() == 0 and KD.open_dataset(spark, path).read().columns == ["id", "name", "at", "modus"]
    assert gone.upsert(base.limit(0), ["at"]).version == gone.version


def whole_text(turns):
    """Plain version of the assembled text."""
    turns = sorted(turns)
    asked = turns[0][0]
    answered = min([t for t, r, _ in turns if r == "assistant"], default=10 ** 9)

    def part(t, r):
        return 2 if r == "assistant" else 0 if t == asked else 1 if t < answered else 3
    return " ".join(x for _, _, x in sorted((part(t, r), t, x) for t, r, x in turns if x is not None))


def test_pages_of_conversations_of_any_length(spark):
    convs = {1: [(i, ("user", "assistant", "tool")[i % 3], f"w{i} " * (i % 5)) for i in range(900)],  # most of all turns
             2: [(1, "user", "hello"), (2, "user", None), (3, "assistant", "")], 3: [(1, "user", "x" * 55)], 4: [(2, "assistant", "é" * 25)],
             5: [(1, "user", None)], 6: [(1, "user", "")]}
    rows = [(c, t, r, x) for c, ts in convs.items() for t, r, x in ts] + [(None, 1, "user", "lost")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    pieces = scratch(AM.conversation_pieces(turns), "test-pieces")
    got = {}
    for r in AM.pages(pieces, "conv_id", 20).orderBy("conv_id", "page").collect():
        assert len(r.text) <= 20 and len(got.setdefault(r.conv_id, [])) == r.page
        got[r.conv_id].append(r.text)
    want = {c: whole_text(ts) for c, ts in convs.items() if any(x is not None for _, _, x in ts)}
    assert {c: "".join(p) for c, p in got.items()} == want
    discard(pieces)
    assert AM.pages(AM.conversation_pieces(turns.limit(0)), "conv_id", 20).count() == 0


@pytest.mark.parametrize("n", [30, 120])
def test_strong_components_of_a_chain_take_few_steps(spark, n):
    nodes = spark.range(n).select(F.col("id").alias("node"))
    chain = nodes.where(F.col("node") < n - 1).select(F.col("node").alias("src"), (F.col("node") + 1).alias("dst"))
    cycle = spark.createDataFrame([(n // 2, n // 2 - 5), (3, 3), (0, 1)], "src long, dst long")
    log = []
    got = {r.node: r.scc for r in GI.strongly_connected_components(nodes, chain.unionByName(cycle), log).collect()}
    assert got == {i: n // 2 - 5 if n // 2 - 5 <= i <= n // 2 else i for i in range(n)}
    assert len(log) <= 2 * n.bit_length() ** 2


def test_bags_in_the_row_equal_those_by_join(spark):
    toks = spark.createDataFrame([(1, 1, 0, ["b", "a", "b", "zz"]), (2, 2, 1, []), (3, 3, 0, None), (4, 4, 2, ["new"]), (5, 5, 0, ["a"] * 4)],
                                 "post_id long, ord_key long, ml_tag int, tokens array<string>")
    vocab = spark.createDataFrame([("zz", 0), ("b", 5), ("a", 2)], "token string, token_id int")
    row, joined = (V.bag_of_words(toks, vocab, most=m).orderBy("ord_key").collect() for m in (100, 2))
    assert row == joined and [r["values"] for r in row] == [[1, 1, 2], [], [], [], [4]]
    assert row[0].key_tokens == ["zz", "a", "b"]


def test_only_rare_tokens_of_a_large_dictionary_are_joined(spark):
    rows = [(1, 1, 0, ["b", "a", "b", "zz", "new"]), (1, 1, 0, ["a"]), (None, None, 0, ["b", "zz"]), (4, 4, 2, ["new"]), (5, 5, 0, None)]
    toks = spark.createDataFrame(rows, "post_id long, ord_key long, ml_tag int, tokens array<string>")
    vocab = spark.createDataFrame([("zz", 0, 2), ("b", 5, 9), ("a", 2, 40)], "token string, token_id int, df int")
    assert [vocab.where(V.frequent(vocab, m)).count() for m in (0, 1, 2, 5)] == [0, 1, 2, 3]
    got = [sorted((str(r.ord_key), list(r["keys"]), list(r["values"]), r.key_tokens) for r in V.bag_of_words(toks, vocab, most=m).collect())
           for m in (0, 1, 2, 3)]
    assert got[0] == got[1] == got[2] == got[3]
    assert got[0] == [("1", [0, 2, 5], [1, 1, 2], ["zz", "a", "b"]), ("1", [2], [1], ["a"]), ("4", [], [], []), ("5", [], [], []),
                      ("None", [0, 5], [1, 1], ["zz", "b"])]


def test_language_scores_in_the_row_equal_those_by_join(spark, monkeypatch):
    rows = [(i, t, l) for i, (t, l) in enumerate([("the cat sat on the mat", "en"), ("der hund und die katze", "de"), ("the dog and the cat", "en"),
                                                  ("die maus und der hund", "de"), ("el gato y el perro", "es"), (None, None), ("12 34", None), ("ñandú 🎈 cat", None)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    prof, meta = LI.train_profiles(df)
    strings = LI.train_profiles(df, grams=LI.char_grams(df, "text", ["doc_id", "lang"]).select("lang", "gram", "cnt"))[0]
    assert {(r.lang, r.gram): round(r.logp, 12) for r in prof.collect()} == {(r.lang, r.gram): round(r.logp, 12) for r in strings.collect()}
    in_row = LI.detect(df, prof, meta).orderBy("doc_id").collect()
    monkeypatch.setattr(LI, "IN_ROW_GRAMS", 3)
    joined = LI.detect(df, prof, meta).orderBy("doc_id").collect()
    assert [r.lang for r in in_row] == [r.lang for r in joined] and len(in_row) == 8
    assert all(abs(a.lang_prob - b.lang_prob) < 1e-9 for a, b in zip(in_row, joined))
