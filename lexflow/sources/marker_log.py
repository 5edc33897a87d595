"""Markers as a log of events: appended, never changed, folded when read.

An event says that a provision of a document is marked, or no longer, or that all marks of a document (or of all) are gone.
Each append is a folder of its own that appears as a whole or not at all, so writers don't wait for one another and nobody's
events are lost; the state is, for each provision, the last event in the order (at, writer, n). Compaction writes the
folded events as one more folder and only then deletes those that it has read: as an event that is read twice
changes nothing, a crash at any step leaves the same state.
"""

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexflow.operators.targets import PALETTE

#: op is mark, unmark or clear; a clear has no uid, and without doc_id it clears all documents.
EVENTS = "at long, writer string, n long, op string, doc_id long, uid string, colour int"


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _folders(spark: SparkSession, path: str) -> list[str]:
    store, at = _store(spark, path)
    return sorted(str(x.getPath()) for x in store.listStatus(at)) if store.exists(at) else []


def append(events: DataFrame, path: str) -> None:
    """Adds events (EVENTS) to the log at path."""
    events.coalesce(1).write.parquet(f"{path}/{uuid.uuid4().hex}")


def events(spark: SparkSession, path: str) -> DataFrame:
    """All events of the log; none where there is no log yet. A log that can't be read is an error."""
    folders = _folders(spark, path)
    return spark.read.schema(EVENTS).parquet(*folders) if folders else spark.createDataFrame([], EVENTS)


def _order() -> Column:
    return F.struct("at", "writer", "n")


def folded(log: DataFrame) -> DataFrame:
    """The last event of each provision, and the last clear of each document and of all; folding what is folded changes nothing."""
    last = F.max_by(F.struct("at", "writer", "n", "op", "colour"), _order()).alias("e")
    keys = log.withColumn("kind", F.when(F.col("op") == "clear", 1).otherwise(0)).groupBy("kind", "doc_id", F.when(F.col("op") != "clear", F.col("uid")).alias("uid"))
    return keys.agg(last).select("e.at", "e.writer", "e.n", "e.op", "doc_id", "uid", "e.colour")


def markers(log: DataFrame) -> DataFrame:
    """doc_id, uid, colour, at, position of the provisions that are marked; position counts a document's marks from 1, in their order."""
    rows = folded(log)
    clears = rows.where("op = 'clear'").select("doc_id", _order().alias("cleared"))
    whole = clears.where("doc_id is null").agg(F.max("cleared")).scalar()
    marks = rows.where("op = 'mark'").withColumn("order", _order()).join(clears.where("doc_id is not null"), "doc_id", "left")
    kept = marks.where((F.col("cleared").isNull() | (F.col("order") > F.col("cleared"))) & F.coalesce(F.col("order") > whole, F.lit(True)))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("order"))
    return kept.select("doc_id", "uid", "colour", "at", place.alias("position"))


def next_colours(marks: DataFrame, colours: int = PALETTE) -> DataFrame:
    """doc_id, n, colour: for each document with marks the least colour that none has, else their number around the palette."""
    used = marks.groupBy("doc_id").agg(F.count("*").alias("n"), F.collect_set("colour").alias("used"))
    free = F.array_min(F.array_except(F.sequence(F.lit(0), F.lit(colours - 1)), "used"))
    return used.select("doc_id", "n", F.coalesce(free, (F.col("n") % colours).cast("int")).alias("colour"))


def _event(spark: SparkSession, path: str, writer: str, op: str, doc_id: int | None, uid: str | None, colour: int | None) -> None:
    row = (time.time_ns() // 1000, writer, time.monotonic_ns(), op, doc_id, uid, colour)
    append(spark.createDataFrame([row], EVENTS), path)


def toggle(spark: SparkSession, path: str, writer: str, doc_id: int, uid: str) -> bool:
    """Marks a provision that isn't marked, with the document's next colour, or takes its mark away; whether it is marked now."""
    own = markers(events(spark, path)).where(F.col("doc_id") == doc_id)
    if not own.where(F.col("uid") == uid).isEmpty():
        _event(spark, path, writer, "unmark", doc_id, uid, None)
        return False
    free = next_colours(own).first()
    _event(spark, path, writer, "mark", doc_id, uid, free["colour"] if free else 0)
    return True


def clear(spark: SparkSession, path: str, writer: str, doc_id: int | None = None) -> None:
    """Takes all marks of a document away, or all there are."""
    _event(spark, path, writer, "clear", doc_id, None, None)


def compact(spark: SparkSession, path: str) -> None:
    """Folds the log's folders into one; events that come meanwhile stay beside it."""
    folders = _folders(spark, path)
    if len(folders) < 2:
        return
    append(folded(spark.read.schema(EVENTS).parquet(*folders)), path)
    for folder in folders:
        store, at = _store(spark, folder)
        store.delete(at, True)
