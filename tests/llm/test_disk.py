"""What the stages of the pipeline leave on disk."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logtables import scratch
from logtables.llm import jaccard_join, line_dedup


@pytest.fixture
def tables(spark):
    """Names of the scratch tables that came since."""
    root = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(root.glob("logtables/*/*"))
    return lambda: sorted(p.name for p in set(root.glob("logtables/*/*")) - before)


@pytest.fixture
def docs(spark):
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(60)]
    texts += [t + " more" for t in texts[:20]] + texts[:5] + ["", None, " \t"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, texts[2]), (None, texts[3]), (63, texts[63])]
    rows += [(90, "said once\nsaid again"), (90, "said once\nsaid again")]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_near_duplicates_leave_no_sets(docs, tables):
    # F1 of round 4: the keys of all sets, 0.8 of the input, stayed on disk
    kept = jaccard_join.keep_one(docs, 5, 80)
    assert tables() == ["classes", "marks", "repeated", "sets"]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in kept.fillna("", "text").collect())
    want = [(i, t) for i, t in docs.fillna("", "text").distinct().collect() if i is not None and (i < 60 or i >= 85)]
    assert got == sorted(want)


def test_documents_pass_near_duplicates_without_a_shuffle_when_few_go(docs, tables):
    # F1 of round 4: whole documents were shuffled twice to find the few that go
    plan = jaccard_join.keep_one(docs, 5, 80)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_line_dedup_leaves_no_lines(docs, tables):
    line_dedup.drop_recurring(docs).collect()
    assert tables() == ["drops"]


def test_the_pipeline_leaves_one_stage(spark, docs, tables, monkeypatch, tmp_path):
    def stage(spark, docs, sf_dir):
        return scratch.materialise(docs, "inner").withColumn("n", F.lit(1))

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, stage) for n in "abc"] + [("d", lambda s, d, _: d)])
    docs.write.parquet(f"{tmp_path}/in/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/in").count() == docs.count()
    assert tables() == ["c"]
    assert spark.read.parquet(f"{tmp_path}/in/documents.parquet").count() == docs.count()


def test_shuffles_of_a_written_table_go_at_once(spark, tables):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if "shuffle" in files.apply(i).getName()}

    before = shuffles()
    key = (F.col("id") % 7).alias("k")
    out = scratch.materialise(spark.range(1000).groupBy(key).count().repartition(3, "k"), "x")
    assert not shuffles() - before
    assert out.toPandas()["count"].sum() == 1000
