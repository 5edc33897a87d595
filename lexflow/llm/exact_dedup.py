"""Exact deduplication with keyed streaming state.

A first pass over the texts writes a slim table: digest of the normalised text, doc_id and content
locator (file and row). Structured Streaming folds that table into disk-backed state (RocksDB, no
watermark, so keys never expire): for each digest the identifier and locator of the row that stays, and
how many rows have it. Texts are aggregated on the map side before they meet the state, so that a digest
held by a third of the corpus sends one row a task. Rows whose digest the state holds more than once are
hits: their full normalised texts are compared, grouped by digest and bytes, again with map-side
combining, and a digest that stands for several texts is split by the texts themselves.

The full-byte check sends only texts of hits. Hits are picked by a broadcast of their digests when those
are counted to be few, and by a shuffled semi-join otherwise.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexflow.llm.common import SPACE, bounded, joined, located, shared_path, stored

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Settings of the streaming run; restored afterwards.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKS,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
    "spark.sql.streaming.stateStore.rocksdb.maxWriteBufferNumber": "2",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",  # stores that no query uses are closed then
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    "spark.sql.streaming.metricsEnabled": "false",
}

#: At most so many digests of hits are broadcast (32 bytes each).
BROADCAST_HITS = 200_000
#: At most so many places of dropped rows are broadcast (16 bytes each).
BROADCAST_DROPPED = 500_000


def normalised(text: Column) -> Column:
    """The text that is compared: null as empty, each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


#: On a local folder, the other kind of checkpoint files starts a process for each link it looks up.
LOCAL_FILES = {"spark.sql.streaming.checkpointFileManagerClass": "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"}


def fold_state(slim: DataFrame, batch_bytes: int = 64 << 30) -> DataFrame:
    """The keyed state after all rows of the stored table slim: digest, keeper, n.

    keeper is the least of (doc_id is null, doc_id, file, row). The stream reads the table's files as they
    were appended, batch_bytes a micro-batch; state survives between batches and runs in the checkpoint.
    """
    spark = slim.sparkSession
    path, state = slim.inputFiles(), shared_path(spark, "dedup-state")
    if not path:
        return slim.select("digest", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row").alias("keeper"), F.lit(0).cast("long").alias("n")).where("false")
    folder = path[0].rsplit("/", 1)[0]
    conf = STATE_CONF | (LOCAL_FILES if state.startswith("file:") else {})
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = spark.readStream.schema(slim.schema).option("maxBytesPerTrigger", str(batch_bytes)).parquet(folder)
        held = rows.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")).alias("keeper"), F.count("*").alias("n"))
        run = held.writeStream.format("noop").outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start()
        run.awaitTermination()
        read = spark.read.format("statestore").load(state)
        value = read.schema["value"].dataType.names
        index = read.select("key.digest", F.col(f"value.{value[0]}").alias("keeper"), F.col(f"value.{value[1]}").alias("n"))
        return stored(index, "dedup-index", 4)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def colliding(docs: DataFrame, index: DataFrame, digest) -> DataFrame:
    """Digests that stand for more than one normalised text, by comparing the full bytes of all hits."""
    hits = bounded(index.where("n > 1").select("digest"), BROADCAST_HITS)
    text = docs.select(normalised(F.col("text")).alias("norm"))
    found = text.select(digest(F.col("norm")).alias("digest"), "norm").join(hits, "digest", "left_semi")
    return found.groupBy("digest", "norm").agg(F.count("*").alias("n")).groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")


def exact_groups(docs: DataFrame, *, digest=sha256, batch_bytes: int = 64 << 30) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, and its place file, row.

    Texts are equal when identical after replacing each run of ASCII white space by one space. Of equal
    texts the row with the smallest doc_id stays. Defined cases: a null text counts as empty, so all empty
    texts are one group; a row without doc_id loses against any row with one, and keep_id is null if none of
    the group has one; of rows that share text and doc_id, exactly one is kept (the first by file and row);
    no rows give no rows; other columns of docs play no part, whatever their names.

    digest maps the normalised text to the key of the state; a weak one costs time, never rightness.
    """
    placed, _, file, row = located(docs.select("doc_id", "text"))
    return _groups(placed, file, row, digest, batch_bytes)


def _groups(placed: DataFrame, file: str, row: str, digest=sha256, batch_bytes: int = 64 << 30) -> DataFrame:
    docs = placed.select("doc_id", F.col(file).alias("file"), F.col(row).alias("row"), normalised(F.col("text")).alias("norm"))
    slim = stored(docs.select("doc_id", "file", "row", digest(F.col("norm")).alias("digest"), *([] if digest is sha256 else [F.sha2("norm", 256).alias("sha")])), "dedup-slim")
    index = fold_state(slim, batch_bytes)
    sha = F.lower(F.hex("digest")) if digest is sha256 else F.col("sha")
    kept = (F.col("keeper.file") == F.col("file")) & (F.col("keeper.row") == F.col("row"))
    out = [F.col("doc_id"), F.col("keeper.doc_id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), sha.alias("text_sha256"), F.col("file"), F.col("row")]
    mixed = colliding(placed.select("text"), index, digest)
    if mixed.isEmpty():
        return joined(slim, index.withColumn("many", F.col("n")), ["digest"]).select(*out)
    mixed = stored(mixed, "dedup-mixed")
    split = docs.withColumn("digest", digest(F.col("norm"))).join(mixed, "digest", "left_semi").withColumn("sha", F.sha2("norm", 256))
    each = split.groupBy("digest", "norm").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")).alias("keeper"), F.count("*").alias("n"))
    apart = split.join(each, ["digest", "norm"]).select(*out[:4], F.col("sha").alias("text_sha256"), *out[5:])
    return slim.join(mixed, "digest", "left_anti").join(index, "digest").select(*out).unionByName(apart)


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_groups keeps, with all their columns, whatever their names.

    Few dropped places are broadcast, more of them leave by a shuffled anti-join. Nulls, ties, repeated rows
    and empty tables: as exact_groups defines them; of rows that are equal in all columns one stays.
    """
    placed, names, file, row = located(docs)
    dropped = stored(_groups(placed, file, row).where("not kept").select(F.col("file").alias(file), F.col("row").alias(row)), "dedup-dropped", 8)
    kept = placed.join(bounded(dropped, BROADCAST_DROPPED), [file, row], "left_anti")
    return kept.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, docs.columns, strict=True)])
