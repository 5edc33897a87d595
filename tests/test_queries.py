"""Every query over small tables against its SQL on another engine."""

from collections import Counter

import pytest

import __spark_entry__ as entry
from lexflow import oracles, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return v.tolist() if hasattr(v, "tolist") else v


@pytest.fixture(scope="module")
def other(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(n for n in names), Counter(tuple(plain(r[k]) for k in order) for r in values)


@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, other, name):
    got = queries.QUERIES[name](spark, sf_dir)
    want = other.execute(oracles.ORACLE_SQL[name])
    assert rows(got.columns, got.collect()) == rows([d[0] for d in want.description], want.fetchall())


def test_all_queries_have_sql():
    assert set(queries.QUERIES) == set(oracles.ORACLE_SQL)


def test_all_references_are_resolved(spark, sf_dir):
    from lexflow.operators import targets

    articles = queries._known(spark, sf_dir)
    keys = {(r.doc_id, r.law, r.art) for r in targets.first_articles(articles).collect()}
    refs = {f"{r.row_no}/{r.line}/{r.step}/{r.sub}": (r.row_no * 15 // 512, r.law_prefix, r.art) for r in queries._refs(spark, sf_dir, articles).collect()}
    got = [r.ref_id for r in queries.ref_resolve(spark, sf_dir).collect()]
    assert len(got) == len(set(got)) and set(got) == {i for i, k in refs.items() if k in keys}
    assert max(int(i.split("/")[0]) for i in got) > 64



def test_all_words_have_their_place(spark, sf_dir):
    import re

    from lexflow.operators import subjects

    words = {w for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect() for w in re.split(r"[\W\d_]+", r.text or "") if w}
    got = queries.locale_sort(spark, sf_dir).collect()
    ordered = [r.subject for r in subjects.in_display_order(spark.createDataFrame([(r.subject,) for r in got], "subject string")).collect()]
    assert len(got) > 200 and abs(len(got) - len(words)) <= len(words) // 100
    assert [r.subject for r in sorted(got, key=lambda r: r.place)] == ordered and sorted(r.place for r in got) == list(range(1, len(got) + 1))



def test_all_units_have_labels(spark, sf_dir):
    units = queries._statute(spark, sf_dir).units.select("uid").distinct()
    got = queries.marker_labels(spark, sf_dir).collect()
    assert sorted(r.uid for r in got) == sorted(r.uid for r in units.collect()) and all(r.label for r in got)



def test_lines_of_all_languages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    got = queries._lines(spark, sf_dir).selectExpr("(seq - seq % 1000000) / 1000000 as of").distinct()
    assert got.count() == docs.count()
    entries = queries.reference_entries(spark, sf_dir).selectExpr("cast(floor(seq / 1000000) as bigint) as doc_id").distinct().join(docs, "doc_id")
    assert {r.lang for r in entries.select("lang").distinct().collect()} == {r.lang for r in docs.select("lang").distinct().collect()}



def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "lang", "source", "n"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
