import os

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from cohortlift.llm.catalog import ORACLES, QUERIES
from cohortlift.sources.tables import staged
from tests.llm.helpers import benchmark_hits, near_groups, prose

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's input and output on the small tables."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = staged(stage(spark, docs, SMALL), "stage")
        out[name] = (docs, after)
        docs = after
    return out


def test_stages_keep_the_columns(stages, spark):
    columns = spark.read.parquet(f"{SMALL}/documents.parquet").columns
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name][1].columns == columns


def test_near_dup_stage_by_brute_force(stages):
    before, after = stages["minhash_near_dedup"]
    docs = [tuple(r) for r in before.select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in after.collect()) == [g[0] for g in near_groups(docs, 5, 80) if g[3]]


def test_decontamination_stage_by_brute_force(stages, spark):
    before, after = stages["benchmark_decontamination"]
    docs = [tuple(r) for r in before.select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(r.doc_id for r in after.collect()) == [h[0] for h in benchmark_hits(docs, items) if not h[-1]]


def test_line_stage_cuts_and_keeps(stages):
    before, after = (d.select("doc_id", "text", "n_chars").collect() for d in stages["line_dedup"])
    texts = {r.doc_id: r.text for r in before}
    assert {r.doc_id for r in after} <= set(texts)
    assert all(len(r.text) <= len(texts[r.doc_id]) for r in after)
    # a document goes only if all of it stands in documents that stay
    for i in set(texts) - {r.doc_id for r in after}:
        assert any(t == texts[i] for j, t in texts.items() if j < i) or len(texts[i].split()) < 4000


def test_run_is_the_last_stage(stages, spark):
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(corpus_pipeline.run(spark, SMALL)) == key(stages["bpe_tokens"][1])


def test_stages_take_odd_rows(spark, tmp_path):
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b", "en", "s", 3), (3, "x" * 9000, "en", "s", 9000),
        (4, prose(1, 80), "en", "s", 1), (5, prose(1, 80), "en", "s", 1), (5, prose(1, 80), "en", "s", 1),
    ]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kind).withColumn("score", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got if r.doc_id) == [1, 2, 3, 4] and len(got) == 5
    os.makedirs(f"{tmp_path}/none")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(name, spark):
    df = QUERIES[name](spark, SMALL)
    source = {"op4": "embeddings", "op6": "pages"}.get(name.split("_")[0], "documents")
    rows = spark.read.parquet(f"{SMALL}/{source}.parquet").count()
    assert df.count() == (rows // 50 * 5 if source == "embeddings" else rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(name, spark):
    from tools.compare import compare, connect

    ok, message = compare(spark, connect(SMALL), name, QUERIES[name], ORACLES[name], SMALL)
    assert ok, message
