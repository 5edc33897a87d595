"""The trigram index against searches through all texts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexflow.operators import search, text_index

SCHEMA = "id long, text string, block int, place string, bucket double"


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    letters = list("abc é\n") + ["Ação", "the ", "😀", "ﬁ"]
    out = ["".join(rnd.choices(letters, k=rnd.randint(0, 30))) for _ in range(150)]
    return [*out, *out[:40], None, "", "a", "ab", "É", "x" * 30_000 + "needle" + "y" * 30_000]


@pytest.fixture(scope="module")
def index(spark, texts):
    rows = spark.createDataFrame([(k if k % 5 else None, t, 1, "p", 2.0) for k, t in enumerate(texts)], SCHEMA).repartition(3)
    return text_index.build(rows, block=16, buckets=4)


@pytest.mark.parametrize("query", ["a", "ab", "é", "abc", "acao", '"c a"', "the a", "😀", "b ação", "needle", "ydoesntoccur", "zz", "", "  ", "xneedley bab", "x" * 20, '"a\nb" c', "fi"])
def test_index_equals_a_scan(spark, texts, index, query):
    whole = spark.createDataFrame([(k if k % 5 else None, t, 1, "p", 2.0) for k, t in enumerate(texts)], SCHEMA)
    want = Counter(tuple(r) for r in search.search_texts(whole, query).collect())
    got = text_index.search(index, query)
    assert got.columns == whole.columns
    assert Counter(tuple(r) for r in got.collect()) == want


def test_search_reads_the_blocks_that_survive(spark, index):
    found = text_index.search(index, "needle")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan or "dynamicPruning" in plan
    assert text_index.candidates(index, ("needle",)).count() == 1
    assert index.lists.selectExpr("max(size(places)) as n").first().n <= 16
    plan = text_index.candidates(index, ("needle",))._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "In(gram" in plan


def test_index_beyond_the_broadcast(spark, texts, index, monkeypatch):
    monkeypatch.setattr(text_index, "BROADCAST", 0)
    assert text_index.search(index, "ab").count() == sum("ab" in search.plain(t) for t in texts if t)


def test_index_of_cards_and_of_nothing(spark, tmp_path):
    cards = search.with_keys(spark.createDataFrame([(1, "Eleição da mesa", "nota"), (2, "outra", "eleicao")], "seq long, text string, footnote_text string"))
    built = text_index.build(cards, F.col("norm_text_fn"), path=f"file://{tmp_path}/index")
    assert sorted(r.seq for r in text_index.search(built, "eleicao").collect()) == [1, 2]
    again = text_index.open_index(cards, f"file://{tmp_path}/index", F.col("norm_text"))
    assert [r.seq for r in text_index.search(again, "eleicao").collect()] == [1]
    none = text_index.build(cards.limit(0))
    assert text_index.search(none, "abc").collect() == [] and text_index.search(none, "a").collect() == []
