"""What stays on disk: shuffles of stored tables, tables that nothing reads again, and how often wide rows are exchanged."""

import time
from pathlib import Path

from lexflow import queries
from lexflow.session import shared_dir, stored


def names(spark):
    root = Path(shared_dir(spark).removeprefix("file://"))
    return {p.name for p in root.iterdir()} if root.exists() else set()


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {p for d in dirs for p in Path(d.getPath()).rglob("shuffle_*.data")}


def exchanges(frame, column):
    """How many exchanges of a frame's plan carry a column."""

    def walk(plan):
        own = plan.nodeName() == "Exchange" and any(plan.output().apply(k).name() == column for k in range(plan.output().size()))
        return own + sum(walk(plan.children().apply(k)) for k in range(plan.children().size()))

    return walk(frame._jdf.queryExecution().executedPlan().inputPlan())


def test_shuffles_of_a_stored_table_are_deleted(spark):
    before, setting = shuffle_files(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own = spark.conf.get(setting)
    table = stored(spark.range(100_000).selectExpr("id % 1000 as a", "id").groupBy("a").count(), "sums")
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and table.count() == 1000 and spark.conf.get(setting) == own


def test_wide_rows_are_exchanged_once(spark, sf_dir):
    """Provisions with their runs are dealt out by article, and by nothing else; cards move none."""
    counts = [exchanges(queries.QUERIES[name](spark, sf_dir), "runs") for name in ("article_cards", "article_markdown", "search_paging", "element_json")]
    assert counts == [1, 1, 0, 1]


def test_a_build_stores_its_rows_once(spark, sf_dir):
    before = names(spark)
    queries._statute(spark, sf_dir)
    assert sorted(n.partition("-")[0] for n in names(spark) - before) == ["articles", "states"]


def test_tables_of_an_edition_go_with_its_tree(spark, sf_dir):
    before = names(spark)
    queries.edition_changes(spark, sf_dir)
    assert {n.partition("-")[0] for n in names(spark) - before} == {"tree"}


def test_states_of_segments_are_stored_once_and_narrow(spark, sf_dir):
    before = names(spark)
    rows = queries._segmented(spark, sf_dir, "footnote_ids")
    assert [n.partition("-")[0] for n in names(spark) - before] == ["states"] and not {"runs", "footnote_ids"} & set(rows.columns)


def test_segmented_bases_are_made_once(spark, sf_dir):
    """What uids are numbered from is stored and goes after that, it isn't exchanged anew for the numbers and for the rows."""
    before = names(spark)
    frame = queries.segmented_uids(spark, sf_dir)
    assert sorted(n.partition("-")[0] for n in names(spark) - before) == ["states", "uids"]
    assert exchanges(frame, "art_run") == exchanges(frame, "base_uid") == 0
