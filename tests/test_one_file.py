"""Rows as one file: order, bytes, what stands between, and what failures leave."""

import random

import pytest
from pyspark.sql import functions as F

from lexflow.sources import one_file
from lexflow.sources.one_file import OneFile


def test_one_file(spark, tmp_path):
    path = tmp_path / "deep" / "a.txt"
    values = [f"é{k}\n\"x" * (k % 3) for k in range(5000)]
    rows = [(k // 100, k % 100, v or None) for k, v in enumerate(values)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "a int, b int, v string").repartition(7)
    for target in (str(path), f"file://{path}"):
        with OneFile(spark, target) as f:
            f.text("head\n")
            f.rows(frame, "v", ["a", "b"], between=",")
            f.text("|")
            f.rows(frame.where("a = 3"), "v", ["a", -F.col("b")], between=F.when(F.col("b") % 2 == 0, "<>").otherwise(""))
            f.rows(frame.limit(0), "v", ["a"])
            f.text("tail")
        third = "".join(("<>" if b % 2 == 0 and b < 99 else "") + values[300 + b] for b in range(99, -1, -1))
        assert path.read_text() == "head\n" + ",".join(values) + "|" + third + "tail"
        assert [p.name for p in path.parent.iterdir()] == ["a.txt"]


def test_a_failure_leaves_the_old_file(spark, tmp_path):
    path = tmp_path / "a.txt"
    path.write_text("old")
    broken = spark.range(100).select("id", F.when(F.col("id") < 90, F.col("id").cast("string")).otherwise(F.raise_error(F.lit("broken row"))).alias("v"))
    with pytest.raises(Exception, match="broken row"), OneFile(spark, str(path)) as f:
        f.text("new")
        f.rows(broken, "v", ["id"])
    assert path.read_text() == "old" and [p.name for p in tmp_path.iterdir()] == ["a.txt"]


def test_parts_of_attempts_that_failed_stay_out(tmp_path):
    """Only parts that a commit has heard of are joined."""
    writer = one_file.PartsWriter(str(tmp_path), "piece-0000")
    for name, text in (("part-000000-x", "a"), ("part-000000-y", "lost"), ("part-000001-z", "b")):
        (tmp_path / name).write_text(text)
    writer.commit([one_file.Part(1, "part-000001-z", "-", 1), None, one_file.Part(0, "part-000000-x", "", 1)])
    assert (tmp_path / "piece-0000.json").read_text() == '[["part-000000-x", ""], ["part-000001-z", "-"]]'
    writer.abort([one_file.Part(1, "part-000001-z", "-", 1), None])
    assert not (tmp_path / "part-000001-z").exists()
