"""Operators 11 to 13 against brute force, the mended ones on what they lost, and the registered queries."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from forumlens.llm import (ann_mih, common, decontam, hard_negatives, lang_bitmask, queries, quality_ftrl, superminhash,
                           toxicity_pu, url_filter, vector_codes)
from tests.llm.test_operators import edits_in, odd_docs, sentence

NAN, INF = float("nan"), float("inf")


# ----------------------------------------------------------------------- op 11

@pytest.mark.parametrize("planes, dims", [(4, 5), (10, 64), (20, 24)])
def test_table_lookups_give_inner_products(planes, dims):
    r = np.random.default_rng(planes)
    x = r.integers(-(1 << (planes - 1)), 1 << (planes - 1), (70, dims))
    packed = hard_negatives.pack_planes(x, planes)
    wide = hard_negatives.unpack_planes(packed, planes)
    assert (wide[:, :dims] == x).all() and not wide[:, dims:].any()
    assert (hard_negatives.scores(wide[:9], packed, planes) == x @ x[:9].T).all()


def plain_negatives(rows, anchors):
    """rows: {id: (label, ints)}."""
    out = []
    for a in anchors:
        la, xa = rows[a]
        score = {i: sum(p * q for p, q in zip(x, xa)) for i, (_, x) in rows.items()}
        first = sorted((i for i, (lab, _) in rows.items() if lab == la and i != a), key=lambda i: (-score[i], i))[:5]
        for p in first:
            fits = [i for i, (lab, _) in rows.items() if lab != la and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            for rank, i in enumerate(sorted(fits, key=lambda i: (-score[i], i))[:10], 1):
                out.append((a, p, rank, i, score[p], score[i]))
    return sorted(out)


def test_hard_negatives_match_brute_force(spark, monkeypatch):
    r = np.random.default_rng(4)
    x = np.round(r.standard_normal((260, 12)) * 0.4, 2)
    x[40:60] = x[40]                       # ties
    x[70] = 0                              # a zero vector takes part
    rows = [(i, [float(v) for v in x[i]], int(i % 3 if i < 200 else 0), "x") for i in range(260)]
    odd = [(300, None, 1, "x"), (400, [NAN] * 12, 1, "x"), (401, [None] + [0.1] * 11, 1, "x"), (402, [INF] * 12, 1, "x"), (500, [0.1] * 12, None, "x"),
           (None, [0.1] * 12, 1, "x"), (100, rows[100][1], 1, "again"), (600, [0.5, 0.5], 1, "short"), (601, [], 1, "none")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int, rank string")
    ints = {i: (lab, [int(np.floor(256 * v)) for v in e]) for i, e, lab, _ in rows}
    want = plain_negatives(ints, range(0, 260, 20))
    for rows_a_block, anchors_a_block in ((4096, 4096), (37, 3)):  # one group, and many
        monkeypatch.setattr(hard_negatives, "ROWS", rows_a_block)
        monkeypatch.setattr(hard_negatives, "ANCHORS", anchors_a_block)
        got = hard_negatives.mine(df, F.col("vec_id") % 20 == 0)
        assert sorted(tuple(g) for g in got.collect()) == want and len(want) > 300
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert hard_negatives.mine(df.where("vec_id in (0, 1)"), F.col("vec_id") == 0).count() == 0
    with pytest.raises(ValueError):
        hard_negatives.mine(spark.createDataFrame([(0, [1e9], 1)], "vec_id long, embedding array<double>, label int"), F.col("vec_id") == 0)


# ----------------------------------------------------------------------- op 12

def plain_codes(x, first, rounds=6):
    parts = x.reshape(len(x), 8, -1).transpose(1, 0, 2)
    books = first.reshape(len(first), 8, -1).transpose(1, 0, 2).copy()

    def far(p):
        return ((parts[p][:, None] - books[p][None]) ** 2).sum(2)
    for _ in range(rounds):
        near = [far(p).argmin(1) for p in range(8)]
        for p in range(8):
            for e in range(books.shape[1]):
                if (near[p] == e).any():
                    books[p, e] = np.floor_divide(parts[p][near[p] == e].sum(0), (near[p] == e).sum())
    d = [far(p) for p in range(8)]
    return np.stack([a.argmin(1) for a in d], 1), sum(a.min(1) for a in d), books


@pytest.mark.parametrize("dims, n", [(16, 400), (11, 60), (8, 5)])
def test_vector_codes_match_full_assignment(spark, dims, n):
    r = np.random.default_rng(dims)
    x = np.round(r.standard_normal((n, dims)), 3)
    x[n // 2:n // 2 + 4] = x[1]                                   # repeated vectors, ties between entries
    rows = [(int(i), [float(v) for v in x[i]], None if i % 7 == 0 else int(i % 3), "c") for i in r.permutation(n)]
    odd = [(1000, None, 1, "c"), (1001, [NAN] * dims, 1, "c"), (1002, [None] * dims, 1, "c"), (1003, [0.1] * (dims + 1), 1, "c"), (1004, [], 1, "c")]
    extra = [(None, rows[0][1], 1, "c"), (rows[3][0], rows[3][1], rows[3][2], "c")]
    df = spark.createDataFrame(rows + odd + extra, "vec_id long, embedding array<double>, label int, code string").repartition(3)
    kept = sorted(rows + extra, key=lambda t: (t[0] is None, t[0] or 0))
    ints = np.zeros((len(kept), -(-dims // 8) * 8), np.int64)
    ints[:, :dims] = np.floor(4096 * np.array([t[1] for t in kept]))
    codes, error, books = plain_codes(ints, ints[:16])
    got, found = vector_codes.compress(df)
    assert found.tolist() == books.tolist()
    have = sorted((g.vec_id is None, g.vec_id or 0, bytes(g.code), g.error) for g in got.collect())
    assert have == sorted((t[0] is None, t[0] or 0, bytes(c.astype(np.uint8)), int(e)) for t, c, e in zip(kept, codes, error))
    text = ",".join(str(v) for part in books.tolist() for entry in part for v in entry)
    assert vector_codes.digest(found) == hashlib.sha256(text.encode()).hexdigest()


def test_bounds_spare_work_and_lists_shrink():
    r = np.random.default_rng(0)
    centres = r.integers(-9000, 9000, (16, 4))
    x = centres[r.integers(0, 16, 3000)] + r.integers(-300, 300, (3000, 4))
    part = vector_codes.Part.fresh(x, centres, 4)
    for step in range(4):
        moved = centres + r.integers(-40, 41, centres.shape)
        part.moved(np.sqrt(((moved - centres) ** 2).sum(1).astype(float)) * (1 + vector_codes.SLACK))
        centres = moved
        depth = part.assign(x, centres)
        full = vector_codes.squared(x, centres)
        assert (part.code == full.argmin(1)).all()
        assert (part.bound[:, 0] >= np.sqrt(full.min(1)) * (1 - 1e-12)).all()
        rest = np.sqrt(np.where(np.arange(16) == part.code[:, None], np.inf, full))
        for j in range(part.near.shape[1]):
            assert (part.bound[:, 1 + j] <= rest[np.arange(3000), part.near[:, j]]).all()
        rest[np.arange(3000)[:, None], part.near] = np.inf
        assert (part.bound[:, -1] <= rest.min(1)).all()
        assert (depth == 0).mean() > 0.5
        part = part.shortened(3 if step == 1 else 4)
    assert vector_codes.next_lists({0: 900, 1: 99, 5: 1}, 4) == 2 and vector_codes.next_lists({0: 1, 5: 50}, 4) == 4
    assert vector_codes.next_lists({0: 10}, 4) == 2 and vector_codes.next_lists({0: 1, 3: 10}, 4) == 3


def test_no_vectors_no_codes(spark):
    got, books = vector_codes.compress(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert got.count() == 0 and books.shape[1] == 0


# ----------------------------------------------------------------------- op 13

def plain_set(text):
    w = re.findall(common.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i:i + 4]) for i in range(len(w) - 3)) if len(w) > 3 else frozenset([tuple(w)] if w else [])


def plain_components(docs):
    sets = {i: plain_set(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = list(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(base, n, seed, changes):
    r = np.random.default_rng(seed)
    for _ in range(n):
        w = base.split()
        for k in r.choice(len(w), int(r.integers(0, changes + 1)), replace=False):
            w[k] = f"new{r.integers(1 << 30)}"
        yield " ".join(w)


def test_super_minhash_estimates_and_stops():
    r = np.random.default_rng(1)
    a = np.sort(r.integers(0, 1 << 63, 900, dtype=np.uint64))
    errors = []
    for share in (0.2, 0.5, 0.8, 0.95):
        for trial in range(20):
            k = int(900 * share)
            a = np.sort(r.integers(0, 1 << 63, 900, dtype=np.uint64))
            b = np.sort(np.concatenate([r.choice(a, k, replace=False), r.integers(0, 1 << 63, 900 - k, dtype=np.uint64)]))
            sig = superminhash.super_minhash(np.concatenate([a, b]), np.array([0, 900, 1800]))
            errors.append((sig[0] == sig[1]).mean() - k / (1800 - k))
    assert np.std(errors) < 0.05 and abs(np.mean(errors)) < 0.015
    small = superminhash.super_minhash(np.arange(3, dtype=np.uint64), np.array([0, 1, 1, 3]))
    assert small.shape == (3, superminhash.SLOTS) and not small[1].any() and len(set(small[0])) > 100
    whole = superminhash.super_minhash(a, np.array([0, 900]))  # a set's signature doesn't depend on its neighbours
    assert (superminhash.super_minhash(np.concatenate([a[:7], a]), np.array([0, 7, 907]))[1] == whole[0]).all()


def test_components_match_brute_force(spark, monkeypatch):
    base, other = sentence(120, 1), sentence(90, 2)
    texts = [*near_copies(base, 60, 3, 4), *near_copies(other, 12, 4, 3), *[base] * 9, "A b", "a B", "a b c", "", None, " \t\n", "É b", "é b",
             *[sentence(40, 50 + i) for i in range(30)], "x y z w", "X Y Z W x y z w", sentence(20_000, 9), sentence(20_000, 9) + " more"]
    docs = [(int(i), t) for i, t in zip(np.random.default_rng(5).permutation(len(texts)), texts)]
    df = spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id long, text string, kept string")
    want = plain_components(docs)
    for texts_a_block, bucket in ((1024, 8192), (13, 5)):  # whole components, and blocks of them
        monkeypatch.setattr(superminhash, "BLOCK_TEXTS", texts_a_block)
        monkeypatch.setattr(superminhash, "BUCKET_ROWS", bucket)
        monkeypatch.setattr(superminhash, "LEADERS", 2)
        got = superminhash.near_duplicates(df)
        assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
        rows = got.collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want and len(rows) == len(docs)
        assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    assert superminhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_odd_rows(spark):
    rows = superminhash.near_duplicates(odd_docs(spark)).collect()
    assert len(rows) == 9 and all(r.kept for r in rows)
    repeated = spark.createDataFrame([(4, "one two three four five")] * 3 + [(None, "one two three four five"), (2, "ONE two three four five")],
                                     "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in superminhash.near_duplicates(repeated).collect()))
    assert got == [(0, 2, 2, False), (2, 2, 2, True)] + [(4, 2, 2, False)] * 3


# ------------------------------------------------------------- mended operators

def test_only_probed_entries_are_measured():
    r = np.random.default_rng(2)
    centres = r.standard_normal((40, 32))
    x = centres[r.integers(0, 40, 3000)] + 0.05 * r.standard_normal((3000, 32))
    codes = ann_mih.learn(x, float(np.sqrt((x * x).sum(1).max())), 10)
    q, at, s, probed = ann_mih.search_block(codes, x[:50], x, np.arange(3000), 10)
    assert probed < 0.8 * 50 * 3000
    want = np.argsort(-(x[:50] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(at[q == i]) & set(want[i])) / 10 for i in range(50)]) > 0.9


def matches(items, texts):
    block = decontam.build(list(range(len(items))), items)
    (_, _, buf, offs), = list(common.text_chunks(pa.array(texts, pa.large_string()), 1 << 40))
    return {(int(d), int(i)): int(e) for d, i, e in zip(*decontam.match_chunk(block, buf, offs))}


def test_no_match_is_lost_among_very_many_short_items():
    items = [f"i{k:06d} x{k % 97:03d}z"[:15] for k in range(260_000)]
    texts = [f"doc {k} nothing" for k in range(10_000)]
    texts[9990] = f"here is {items[200_123]} planted"
    assert matches(items, texts) == {(9990, 200_123): 0}


def test_short_items_match_as_whole_words():
    items = ["a", "go", "cat", "four", "eight", "a b c", "seven77", "", "!!", "go"]
    texts = ["Go, cat! goat", "a b c d", "concat", "", "x seven77", "FOUR eight", "is a  B\tc", "four"]

    def plain(t):
        return re.sub("[^a-z0-9]+", " ", t.lower()).strip()
    want = {(d, i): 0 for d, t in enumerate(texts) for i, x in enumerate(items) if plain(x) and f" {plain(x)} " in f" {plain(t)} "}
    assert matches(items, texts) == want and len(want) == 11


def test_long_items_are_aligned():
    r = np.random.default_rng(3)
    item, other = (" ".join("".join(w) for w in r.choice(list("abcdefghij"), (35_000, 5))) for _ in range(2))
    assert len(item) > 200_000
    changed = list(item)
    for k in np.random.default_rng(1).choice(len(item), 150, replace=False):
        changed[k] = "q"  # not a letter of these words
    got = matches([item, other], ["before " + "".join(changed) + " after", "nothing", item])
    changes = sum(a != b for a, b in zip(item, changed))
    assert set(got) == {(0, 0), (2, 0)} and got[2, 0] == 0 and changes - 5 <= got[0, 0] <= changes


def test_alignment_equals_plain_edit_distance():
    r = np.random.default_rng(7)
    letters = np.array(list("abcd "))
    items, texts = [], []
    for _ in range(60):
        t = "".join(r.choice(letters, int(r.integers(30, 120)))).strip() + "z"
        items.append(t)
        w = list(t)
        for _ in range(int(r.integers(0, max(2, len(t) // 9)))):
            k = int(r.integers(0, len(w)))
            w[k] = r.choice(["", "q", w[k] + "b"])
        texts.append("q" * int(r.integers(0, 9)) + "".join(w) + "".join(r.choice(letters, 5)))
    block = decontam.build(list(range(60)), items)
    (_, _, buf, offs), = list(common.text_chunks(pa.array(texts, pa.large_string()), 1 << 40))
    b, lo = decontam.plain(buf, offs)
    got = matches(items, texts)
    for (d, i), e in got.items():
        assert e == edits_in(bytes(block.items[i]).decode(), bytes(b[lo[d]:lo[d + 1]]).decode())
    sure = [i for i in range(60) if edits_in(bytes(block.items[i]).decode(), bytes(b[lo[i]:lo[i + 1]]).decode()) <= block.budget[i]]
    assert {(i, i) for i in sure} <= set(got) and len(sure) > 20


def test_url_training_table_is_bounded_and_has_both_labels(spark):
    urls = ["http://same.com/x"] * 3000 + [f"http://h{i}.com/p{i}" for i in range(3000)] + ["http://x.net/es/1"]
    rows = url_filter.label_by_rules(spark.createDataFrame([(u,) for u in urls], "url string"), most=400).collect()
    assert {r.label for r in rows} == {0, 1} and len(rows) == len({r.url for r in rows}) < 300


# -------------------------------------------------- models against plain versions

def test_ftrl_matches_a_plain_version():
    r = np.random.default_rng(0)
    model = quality_ftrl.Ftrl(30)
    z, n = [0.0] * 30, [0.0] * 30
    a, beta, l1, l2 = quality_ftrl.ALPHA, quality_ftrl.BETA, quality_ftrl.L1, quality_ftrl.L2

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - (l1 if z[i] > 0 else -l1)) / ((beta + n[i] ** 0.5) / a + l2)
    for _ in range(200):
        at, x, y = r.choice(30, 6, replace=False), r.random(6), float(r.integers(0, 2))
        model.learn(at, x, y, 0.7)
        w = [weight(i) for i in at]
        p = 1 / (1 + np.exp(-sum(p * q for p, q in zip(w, x))))
        for i, xi, wi in zip(at, x, w):
            g = 0.7 * (p - y) * xi
            s = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / a
            z[i] += g - s * wi
            n[i] += g * g
    assert np.allclose(model.weights(), [weight(i) for i in range(30)]) and np.count_nonzero(model.weights()) > 5


def test_language_bits_against_plain_sets(spark):
    words = {lang: ["".join(np.random.default_rng(k).choice(list(abc), 6)) for k in range(60)]
             for lang, abc in (("en", "abcdefg"), ("de", "defghij"), ("fr", "klmnopa"))}
    r = np.random.default_rng(8)
    docs = [(i, " ".join(r.choice(words[lang], 30)), lang) for i in range(240) for lang in [("en", "de", "fr")[i % 3]]]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = lang_bitmask.train(lang_bitmask.sample(df, F.col("doc_id") % 4 != 0))
    got = {x.doc_id: x.lang_pred for x in lang_bitmask.predict(df.select("doc_id", "text"), model, ["doc_id"]).collect()}
    known = {lang: set() for lang in words}
    for i, t, lang in docs:
        if i % 4:
            known[lang] |= {f" {t} "[k:k + n] for n in (3, 5) for k in range(len(t) + 3 - n)}
    plain = {i: max(known, key=lambda lang: sum(f" {t} "[k:k + n] in known[lang] for n in (3, 5) for k in range(len(t) + 3 - n)))
             for i, t, _ in docs if i % 4 == 0}
    assert np.mean([got[i] == p for i, p in plain.items()]) > 0.95 and np.mean([p == docs[i][2] for i, p in plain.items()]) > 0.95


# ---------------------------------------------------------- registered queries

SMALL = "/root/testdata/sf0.001"
CONTRACT = {
    "op1_ann_mih": ["query_id", "rank", "vec_id", "score"], "op2_language_bitmask": ["doc_id", "held_out", "lang_pred", "score"],
    "op3_mix_sainte_lague": ["doc_id", "size", "source_size", "target", "taken"],
    "op6_quality_ftrl": ["doc_id", "held_out", "score", "predicted"], "op9_toxicity_pu": ["doc_id", "held_out", "score", "predicted"],
    "op10_url_rules": ["page_id", "host", "path", "rule", "verdict"],
    "op11_hard_negatives": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
    "op12_vector_codes": ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
    "op13_superminhash": ["doc_id", "n_shingles", "component_id", "kept"],
}


@pytest.mark.parametrize("name", CONTRACT)
def test_queries_return_their_columns(spark, name):
    got = queries.queries()[name](spark, SMALL)
    assert set(CONTRACT[name]) <= set(got.columns)
    rows = got.collect()
    table = "embeddings" if name in ("op1_ann_mih", "op11_hard_negatives", "op12_vector_codes") else "pages" if "url" in name else "documents"
    if table != "embeddings" or name == "op12_vector_codes":
        assert len(rows) == spark.read.parquet(f"{SMALL}/{table}.parquet").count()
    if "held_out" in got.columns:
        import zlib

        mod, rest = (3, 1) if name.startswith("op6") else (5, 0)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) and 0 <= r.score <= 1 for r in rows)


def test_held_out_labels_change_no_score(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    for weights, mod, rest in ((queries.quality_weights, 3, 1), (queries.toxicity_weights, 5, 0)):
        turned = labels.withColumn("held", common.fold(F.col("doc_id"), mod) == rest).select(
            "doc_id", *[F.when(F.col("held"), 1 - F.col(c)).otherwise(F.col(c)).cast("int").alias(c) for c in ("quality", "toxic")])
        assert np.array_equal(weights(docs, labels), weights(docs, turned))


def test_toxicity_risk_falls_against_its_slope():
    """The fitted classifier has less of the corrected risk than the constant one, whose negative part is positive."""
    texts = [("nasty " * 3 if i % 4 == 0 else "plain ") + sentence(15, i) for i in range(200)]
    positive = np.array([i % 4 == 0 and i < 100 for i in range(200)])
    slots, w = toxicity_pu.fit(__import__("pandas").Series(texts), positive, 0.25)
    keys = [np.unique(np.concatenate(toxicity_pu.features(buf, offs)[0])) for _, _, buf, offs in common.text_chunks(pa.array(texts, pa.large_string()))]
    doc, slot = (keys[0] >> np.uint64(32)).astype(int), (keys[0] & np.uint64(0xFFFFFFFF)).astype(int)
    dense = np.zeros(toxicity_pu.BUCKETS)
    dense[slots] = w
    f = dense[0] + np.bincount(doc, dense[slot], 200)

    def risk(f):
        p, u = positive, ~positive
        return 0.25 * np.logaddexp(0, -f[p]).mean() + max(0.0, np.logaddexp(0, f[u]).mean() - 0.25 * np.logaddexp(0, f[p]).mean())
    assert risk(f) < risk(np.full(200, np.log(0.25 / 0.75))) - 0.2
    toxic = np.arange(200) % 4 == 0
    assert (f[toxic][:, None] > f[~toxic][None]).mean() > 0.97
