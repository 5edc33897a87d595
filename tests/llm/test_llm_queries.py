"""The registered queries over small tables, and the pipeline against its operators one by one."""

from collections import Counter

import pytest

import corpus_pipeline
from helpers import odd_table
from lexflow.llm import queries

TABLES = "documents labels conversations sale_lines".split()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf_dir), con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert Counter(tuple(r[n] for n in names) for r in got.collect()) == Counter(want.fetchall())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_gives_all_documents(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir)
    if "doc_id" in got.columns:
        assert got.select("doc_id").distinct().count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), name)
        now = {r.doc_id for r in docs.collect()}
        assert docs.columns == columns and now <= ids
        ids = now
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == ids
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "private", "packing"]


def test_pipeline_odd_rows(spark, sf_dir, tmp_path):
    """Stages over nulls, blanks, long texts, repeated rows, clashing names, and over no rows at all."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    some = spark.read.parquet(f"{sf_dir}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text")
    odd = odd_table(spark)
    for name, docs in (("odd", odd.unionByName(some, allowMissingColumns=True)), ("empty", odd.limit(0))):
        folder = f"file://{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        before = docs.count()
        for stage, function in corpus_pipeline.STAGES[:-1]:
            after = corpus_pipeline.stored(function(spark, docs, folder), stage)
            assert after.columns == docs.columns and after.count() <= before
            docs, before = after, after.count()
        kept = Counter(r.doc_id for r in docs.select("doc_id").collect())
        pieces = corpus_pipeline.run(spark, folder)
        assert Counter(r.doc_id for r in pieces.where("start = 0").collect()) == kept
        assert (before > 0) == (name == "odd") and kept[50] <= 2
