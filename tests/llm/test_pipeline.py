"""The pipeline: each stage on what the last one kept, with planted cases."""

from pyspark.sql import functions as F

import corpus_pipeline
from forumlens.llm import decontam, lsh_forest

SF = "/root/testdata/sf0.001"


def test_stages_work_on_what_was_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    planted = docs.limit(1).select(F.lit(10_000_001).cast("long").alias("doc_id"), F.concat(
        F.lit("Some words before. "), F.lit(item), F.lit(" And some words after.")).alias("text"), "lang", "source", "n_chars")
    docs = docs.unionByName(planted.select(*docs.columns)).withColumn("_score", F.lit("own column"))
    before = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, SF)
        if i < 4:
            assert after.columns == docs.columns, name
            assert after.join(before, "doc_id", "left_anti").count() == 0, name
            assert 0 < after.count() <= before.count(), name
        if name == "near_duplicates":
            classes = lsh_forest.near_duplicates(after)
            assert classes.groupBy("class_id").count().where("count > 1").count() == 0
        if name == "decontamination":
            assert after.where("doc_id = 10000001").count() == 0 and before.where("doc_id = 10000001").count() == 1
            assert decontam.contamination(after, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
        before = spark.createDataFrame(after.toArrow())
    assert "taken" in before.columns and before.count() > 0


def test_stages_take_odd_rows(spark, tmp_path):
    kind = ("doc_id long, text string, lang string, source string, n_chars int, score double, label int, tid string, "
            "class_id string, kept string, bucket string, taken string, size string, TEXT2 array<string>")
    own = (0.25, 7, "t", "c", "k", "b", "v", "z", ["own"])
    long = " ".join(f"word{i}" for i in range(40000))
    rows = [(1, "good day to all of you here", "en", "a", 5, *own)] * 3
    rows += [(2, None, None, None, None, *[None] * 9), (3, "", "en", "b", 0, *own), (4, "", "en", "b", 0, *own),
             (None, "a text that has no id at all", "en", None, 3, *own), (5, long, "de", "a", 1, *own), (6, None, "en", "a", 1, *own)]
    docs = spark.createDataFrame(rows, kind)
    tables = {"labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    nothing, some = str(tmp_path / "nothing"), str(tmp_path / "some")
    for name, schema in tables.items():
        spark.createDataFrame([], schema).write.parquet(f"{nothing}/{name}.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 1, None), (None, 0, 1), (5, None, 0)], tables["labels"]).write.parquet(
        f"{some}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (None, "word77 word78 word79 word80 word81")], tables["benchmark"]).write.parquet(
        f"{some}/benchmark.parquet")
    for folder in (nothing, some):
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            got = stage(spark, docs, folder).collect()
            ids = sorted(x.doc_id or 0 for x in got)
            if i < 4:
                assert all(x.score in (0.25, None) and x.kept in ("k", None) and x.TEXT2 in (["own"], None) for x in got), name
            if name in ("toxicity", "quality") or (name == "decontamination" and folder == nothing) or name == "mixing":
                assert ids == [0, 1, 1, 1, 2, 3, 4, 5, 6], (name, folder)
            elif name == "near_duplicates":
                assert ids == [0, 1, 2, 3, 5, 6], folder
            else:
                assert ids == [0, 1, 1, 1, 2, 3, 4, 6]  # the long text holds the item
            if name == "mixing":
                assert all(x.taken == 0 for x in got if x.doc_id in (2, 3, 4, 6))
            empty = stage(spark, docs.limit(0), folder)
            assert empty.count() == 0 and (i == 4 or empty.columns == docs.columns), name


def test_run_and_registration(spark):
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in names if q[:2] == "op" and q[2].isdigit()}
    assert "pipeline" in names
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "size", "source_size", "target", "taken"]
