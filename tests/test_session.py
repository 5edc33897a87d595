"""What is broadcast, and how large tasks get."""

from lexflow.plans import views
from lexflow.session import stored


def test_packed_tables_are_not_broadcast(spark, sf_dir):
    """A table of some 40 MB that Parquet packs to a fraction of that is joined by shuffle; one that is measured to be small is broadcast."""
    views.table(spark, sf_dir, "orders")  # settings of the statute queries
    articles = stored(spark.range(400_000, numPartitions=4).selectExpr("xxhash64(id) as block_id", "id as seq", "repeat('art', 10) as law_prefix"), "articles")
    units = stored(spark.range(800_000, numPartitions=4).selectExpr("xxhash64(id div 2) as block_id"), "units")
    whole = units.join(articles, "block_id").groupBy("law_prefix").count()
    few = units.join(articles.where("seq < 10240"), "block_id").groupBy("law_prefix").count()
    assert [r[1] for r in whole.collect()] == [800_000] and [r[1] for r in few.collect()] == [20_480]
    plans = [x._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0] for x in (whole, few)]
    assert ["BroadcastHashJoin" in p for p in plans] == [False, True]


def test_long_methods_are_not_interpreted(spark, sf_dir):
    """A stage whose generated method has over 8,000 bytes, which the JVM never compiles, isn't run as one."""
    views.table(spark, sf_dir, "orders")
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_measured_sizes_leave_room_for_exploded_rows(spark, sf_dir):
    """What is exploded from a measured stage counts by that stage's size, so the limit of the latter is less than the session's 10 MB."""
    views.table(spark, sf_dir, "orders")
    assert int(spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold")) <= (10 << 20) // 8


def test_tasks_are_small(spark, sf_dir):
    """Sorted rows take some fifty times a shuffle's compressed bytes, so a shuffle of 24 MB that won't compress makes six tasks at least."""
    views.table(spark, sf_dir, "orders")
    rows = spark.range(1_000_000).selectExpr("xxhash64(id) as a", "xxhash64(id, 1) as b", "xxhash64(id, 2) as c").repartition("a")
    assert rows.rdd.getNumPartitions() >= 6


def test_large_files_make_more_tasks(spark, sf_dir, tmp_path):
    """A file of some 100 MB is read in splits of 16 MB at most, however few cores there are."""
    views.table(spark, sf_dir, "orders")
    spark.range(0, 5_000_000, 1, 1).selectExpr("xxhash64(id) as a", "xxhash64(id, 1) as b", "xxhash64(id, 2) as c").write.option("parquet.block.size", 4 << 20).parquet(str(tmp_path / "large"))
    assert spark.read.parquet(str(tmp_path / "large")).rdd.getNumPartitions() >= 7
