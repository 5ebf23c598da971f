"""Document formats, class scans, landed text files and component edge cases."""

import pytest

from forumlens.operators import formats as FM
from forumlens.operators import graph_iter as GI
from forumlens.operators.components import components
from forumlens.schemas import PAGE_RAW, POST_RAW
from forumlens.sources import landed as L


def test_all_format_takes_one_step_and_rejects_other_names(spark):
    d = spark.createDataFrame([("#1", 1), ("#2", 2), ("#2", 3), (None, 4)], "step string, ord_key long")
    assert sorted(r.ord_key for r in FM.doc_format(d, "ALL_#2").collect()) == [2, 3]
    assert FM.doc_format(d, "all_#9").isEmpty()
    assert FM.doc_format(d.drop("step"), "all_#2").count() == 4
    for bad in ("all_#", "all_#x", "all_2", "all_#2 "):
        with pytest.raises(ValueError):
            FM.doc_format(d, bad)


def test_scan_classes_training_only_leaves_out_classes_without_split(spark):
    a = spark.createDataFrame([("#3", 0, 1), ("#3", 1, 2), ("#4", 0, 3)], "step string, ml_tag int, ord_key long")
    b = spark.createDataFrame([("#3", 9)], "step string, ord_key long")
    got = L.scan_classes({"a": a, "b": b}, "#3", training_only=True).collect()
    assert [(r.record_class, r.ord_key) for r in got] == [("a", 1)]
    assert L.scan_classes({"a": a, "b": b}, "#3").count() == 3


def test_landed_text_files_have_the_declared_schema(spark, tmp_path):
    for name in ("17.html", "18.html", "notes.html"):
        (tmp_path / name).write_text(f"<p>{name}</p>\nmore")
    for kind, schema, key in (("post", POST_RAW, "post_id"), ("page", PAGE_RAW, "page_nr")):
        d = L.scan_landed(spark, str(tmp_path), kind, "text")
        assert [(f.name, f.dataType) for f in d.schema] == [(f.name, f.dataType) for f in schema]
        got = {r[key]: r.content_raw for r in d.collect()}
        assert got == {17: "<p>17.html</p>\nmore", 18: "<p>18.html</p>\nmore", None: "<p>notes.html</p>\nmore"}


def test_components_of_a_long_chain_with_loops_and_nulls(spark):
    n = 300
    e = [(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000), (5000, 5000), (None, 3), (7, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(e, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000, 5000: 5000}


def test_components_without_nodes_or_edges(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "node long")
    edges = spark.createDataFrame([], "src long, dst long, weight double")
    assert sorted(map(tuple, GI.connected_components(nodes, edges).collect())) == [(1, 1), (2, 2)]
    assert sorted(map(tuple, GI.strongly_connected_components(nodes, edges).collect())) == [(1, 1), (2, 2)]
    assert GI.strongly_connected_components(nodes.limit(0), edges).count() == 0


def test_doc_components_keep_documents_without_a_user(spark):
    r = spark.createDataFrame([(1, 10), (2, 10), (3, None), (4, 11), (5, None)], "doc long, user long")
    assert sorted(map(tuple, GI.doc_components(r).collect())) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)]


def test_iterations_say_whether_they_converged(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node long")
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (1, 3, 1.0)], "src long, dst long, weight double")
    assert not GI.pagerank(nodes, edges, max_iter=1).first().converged
    assert GI.pagerank(nodes, edges).first().converged
