"""The pipeline: what each stage keeps, its columns, and odd inputs."""

import pytest

import corpus_pipeline
from mediaops.llm import bpe, queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with clashing columns, nulls, copies and junk beside the given ones."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    text = docs.where("lang = 'en' AND n_chars > 800").orderBy("doc_id").first().text
    odd = spark.createDataFrame([(100_001, text, "en", "s", 1), (100_002, text, None, None, None), (100_003, None, "en", "s", 0), (None, "", None, "s", 0),
                                 (100_004, "%%% ### " * 50, "en", "s", 1)], docs.schema)
    docs.unionByName(odd).selectExpr("*", "1 AS kept", "'x' AS score", "2 AS copy", "'y' AS ids").write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns, name
        if name == "quality":
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
            assert 100_001 in ids and 100_002 in ids and not ids & {100_003, 100_004, None}
            labelled = spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 0").collect()
            assert sum(r.doc_id in ids for r in labelled) <= 0.1 * len(labelled)
        if name == "near_duplicates":
            texts = [r.text for r in docs.select("text").collect()]
            assert len(set(texts)) == len(texts) < before
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    words = queries.vocabulary()
    decoded = bpe.decode(last, words, out="t").selectExpr("doc_id", "cast(t AS string) AS t")
    assert sorted((r.doc_id, r.t) for r in decoded.collect()) == sorted((r.doc_id, r.text) for r in docs.collect())


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_entry_lists_ten_operators_and_the_pipeline():
    from __spark_entry__ import oracle_sql
    from __spark_entry__ import queries as registered

    names = registered()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(oracle_sql()) <= set(names)
