"""Cosine means and permutation statistics against brute force."""

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from forumlens.operators import assort as AS

VEC = {1: [1.0, 0.0], 2: [1.0, 1.0], 3: [0.0, 1.0], 4: [0.0, 0.0], 5: [2.0, 1.0]}
EDGES = [(1, 2), (2, 3), (3, 1), (1, 1), (4, 5), (5, 2), (2, 5)]
ROLES = [(10, 1, 1), (11, 1, 2), (11, 2, 1), (12, 2, 1), (13, 3, 1), (10, 3, 1)]  # (doc, user, r)
DOCV = {10: [1.0, 0.0], 11: [1.0, 1.0], 12: [0.0, 0.0], 13: [0.0, 2.0]}


def _unit(v):
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n > 0 else None


def _cos(a, b):
    return None if a is None or b is None else sum(x * y for x, y in zip(a, b))


def _vecs(spark, table):
    df = spark.createDataFrame([(n, v) for n, v in table.items()], "node long, w array<double>")
    return AS.vector_columns(df, "w", 2)


def _edge_mean(vec_of):
    vals = [c for c in (_cos(vec_of(a), vec_of(b)) for a, b in EDGES) if c is not None]
    return sum(vals) / len(vals)


def _doc_mean(vec_of):
    by_user = defaultdict(list)
    for d, u, r in ROLES:
        by_user[u].append((d, r))
    num = den = 0.0
    for lst in by_user.values():
        for i, (d1, r1) in enumerate(lst):
            for d2, r2 in lst[i + 1:]:
                c = _cos(vec_of(d1), vec_of(d2))
                if c is not None:
                    num += r1 * r2 * c
                    den += r1 * r2
    return num / den


def test_observed_means(spark):
    edges = spark.createDataFrame(EDGES, "src long, dst long")
    got = AS.edge_cosine_mean(edges, _vecs(spark, VEC), 2).first().mean_cosine
    assert abs(got - _edge_mean(lambda n: _unit(VEC[n]))) < 1e-12
    roles = spark.createDataFrame(ROLES, "doc long, user long, r long")
    dv = _vecs(spark, DOCV).withColumnRenamed("node", "doc")
    got = AS.doc_cosine_mean(roles, dv, 2).first().mean_cosine
    assert abs(got - _doc_mean(lambda d: _unit(DOCV[d]))) < 1e-12


def test_permutation_statistics(spark):
    vecs = _vecs(spark, VEC)
    # nodes with a vector come first, then those without, each by node
    nodes = sorted(VEC, key=lambda v: (_unit(VEC[v]) is None, v))
    where = spark.createDataFrame([(v, i) for i, v in enumerate(nodes)], "node long, idx long")
    by_it = defaultdict(dict)
    for r in AS.permutations(where, 5, 6, seed=3).collect():
        by_it[r.it][r.node] = nodes[r.src_idx]   # node takes the vector of this node
    assert all(sorted(m.values()) == sorted(nodes) for m in by_it.values())  # bijections
    assert len({tuple(sorted(m.items())) for m in by_it.values()}) > 1
    edges = spark.createDataFrame(EDGES, "src long, dst long")
    stats = {r.it: r.stat for r in AS.permutation_stats(edges, vecs, 2, 6, seed=3).collect()}
    for it, m in by_it.items():
        assert abs(stats[it] - _edge_mean(lambda n: _unit(VEC[m[n]]))) < 1e-12
    out = AS.permutation_test(edges, vecs, 2, 6, seed=3).first()
    assert out.n_iter == 6 and 0.0 <= out.quantile <= 1.0 and out.verdict


def test_keyed_bijection():
    for n in (1, 2, 3, 5, 64, 65, 1000, 4097):
        for it in range(3):
            assert sorted(AS.keyed_bijection(np.arange(n), n, it, 7)) == list(range(n))
    # places are spread evenly: each of 5 nodes takes each place about equally often
    seen = np.zeros((5, 5))
    for it in range(5000):
        seen[np.arange(5), AS.keyed_bijection(np.arange(5), 5, it, 11)] += 1
    assert seen.min() > 880 and seen.max() < 1120


def test_inverse_of_the_bijection():
    for n in (1, 2, 5, 64, 1000, 4097):
        for it in range(3):
            there = AS.keyed_bijection(np.arange(n), n, it, 7)
            assert (AS.keyed_inverse(there, n, it, 7) == np.arange(n)).all()


def test_cells_and_joins_agree(spark):
    """Blocks of two rows, users split over blocks, a null user and weights: the sums of the
    cells are those of the joins and of a plain loop."""
    r = np.random.default_rng(2)
    vec = {i: [float(x) for x in r.random(2)] if i % 3 else [0.0, 0.0] for i in range(30)}
    vecs = _vecs(spark, vec)
    links = [(int(a), int(b), int(w)) for a, b, w in zip(r.integers(0, 30, 80), r.integers(0, 30, 80), r.integers(1, 4, 80))]
    edges = spark.createDataFrame(links + links[:5], "src long, dst long, weight long")
    held = {(int(d), None if u == 4 else int(u)) for d, u in zip(r.integers(0, 30, 90), r.integers(0, 5, 90))}
    roles = spark.createDataFrame([(d, u, 1 + d % 3) for d, u in sorted(held, key=str)], "doc long, user long, r long")
    for kind in ({"edges": edges}, {"edges": None, "doc_roles": roles}):
        cells = {x.it: x.stat for x in AS.permutation_stats(vecs=vecs, k=2, n_iter=7, seed=5, block_rows=2, **kind).collect()}
        one = {x.it: x.stat for x in AS.permutation_stats(vecs=vecs, k=2, n_iter=7, seed=5, **kind).collect()}
        joins = {x.it: x.stat for x in AS.permutation_stats(vecs=vecs, k=2, n_iter=7, seed=5, vector_bytes=0, **kind).collect()}
        assert set(cells) == set(one) == set(joins) == set(range(7))
        assert all(abs(cells[i] - joins[i]) < 1e-12 and abs(one[i] - joins[i]) < 1e-12 for i in cells)
    nodes = sorted(vec, key=lambda v: (_unit(vec[v]) is None, v))
    for it, stat in {x.it: x.stat for x in AS.permutation_stats(edges, vecs, 2, 3, 5, block_rows=2).collect()}.items():
        of = {v: _unit(vec[nodes[p]]) for v, p in zip(nodes, AS.keyed_bijection(np.arange(30), 30, it, 5))}
        got = [(w, _cos(of[a], of[b])) for a, b, w in links + links[:5]]
        assert abs(stat - sum(w * c for w, c in got if c is not None) / sum(w for w, c in got if c is not None)) < 1e-12


def test_graphs_without_vectors_or_edges(spark):
    none = _vecs(spark, {1: [0.0, 0.0], 2: [0.0, 0.0]})
    edges = spark.createDataFrame([(1, 2)], "src long, dst long")
    assert [x.stat for x in AS.permutation_stats(edges, none, 2, 3).collect()] == [None] * 3
    assert [x.stat for x in AS.permutation_stats(edges.limit(0), _vecs(spark, VEC), 2, 3).collect()] == [None] * 3


def test_cells_look_only_at_rows_that_meet_a_vector(monkeypatch):
    """The round functions are tables, and a cell gathers no more rows than its landed nodes have."""
    calls = []
    monkeypatch.setattr(AS, "_scramble", lambda x, key, f=AS._scramble: calls.append(len(x)) or f(x, key))
    AS.keyed_inverse(np.arange(50_000), 900_000, 0, 7)
    assert sum(calls) <= 6 * 1024  # before: six times the numbers, and again for those walked on
    node = np.array([0, 2, 3, 5, 8])
    nodes, at = AS._places(10, node[[4, 0, 1, 1]])
    assert nodes.tolist() == [0, 2, 8] and at.tolist() == [2, 0, 1, 1]
    start = AS._starts(at, len(nodes))
    assert AS._rows_of(np.array([1, 2]), start).tolist() == [1, 2, 3]
    assert AS._rows_of(np.array([], int), start).tolist() == []
    got = {int(nodes[a]): int(p) for a, p in zip(*AS._landing(nodes, 10, 2, 7)(3))}
    all_of = AS.keyed_bijection(np.arange(10), 10, 3, 7)
    assert got == {int(v): int(all_of[v]) for v in nodes if all_of[v] < 2}


def test_blocks_are_not_copied_for_the_iterations(spark):
    """As many blocks as cores are dealt once and see all iterations; parts of one weight and of one user agree with a loop."""
    vecs = _vecs(spark, {i: [1.0 + i % 4, 1.0 + i % 7] if i % 2 else [0.0, 0.0] for i in range(40)})
    edges = spark.createDataFrame([(i % 40, (i * 7) % 40) for i in range(400)], "src long, dst long")
    rows = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    seen = []

    def cell(first, last, table):
        return pa.table({"it": np.array([last - first], np.int32), "rows": np.array([table.num_rows])})

    for block in (20, 1000):
        got = AS._cells(rows, F.xxhash64("a"), 400, 12, block, cell, "it int, rows long").collect()
        seen.append((sum(r.it * r.rows for r in got), sum(r.rows for r in got)))
    assert [x[0] for x in seen] == [400 * 12] * 2 and seen[0][1] == 400 and seen[1][1] > 400
    one, many = ({r.it: r.stat for r in AS.permutation_stats(edges, vecs, 2, 9, block_rows=n).collect()} for n in (1 << 23, 20))
    assert all(abs(one[i] - many[i]) < 1e-12 for i in range(9))


def test_user_weights_of_users_without_vectors(spark):
    """Only the rows of documents with a vector are shuffled, and all users have a row."""
    from forumlens.operators import graph as G
    roles = spark.createDataFrame([(1, 7, "asker"), (1, 7, "answerer"), (1, 8, "answerer"), (1, 8, "answerer"), (2, 8, "asker"),
                                   (3, 9, "asker"), (None, 5, "asker"), (4, None, "asker")], "doc long, user long, role string")
    vectors = spark.createDataFrame([(1, [0.25, 0.75]), (2, [1.0, 0.0]), (77, [0.5, 0.5])], "doc long, w array<double>")
    got = {r.node: r.w for r in G.user_topic_weights(roles, vectors, 2).collect()}
    assert got == {7: [0.25, 0.75], 8: [0.625, 0.375], 9: [None, None], 5: [None, None], G.ANON: [None, None]}
    plan = G.user_topic_weights(roles, vectors, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_topic_vectors_fold_all_elements(spark, tmp_path):
    from forumlens.sources.tables import topic_vectors
    rows = [(1, [1.0, -2.0, 3.0, 0.5, -0.25]), (2, [4.0]), (3, []), (4, None), (5, [1.0, None, 2.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.post_id: r.w for r in topic_vectors(spark, str(tmp_path), 3).collect()}
    assert got[1] == [1.5 / 6.75, 2.25 / 6.75, 3.0 / 6.75] and got[2] == [1.0, 0.0, 0.0]
    assert got[3] == got[4] == got[5] == [None] * 3
