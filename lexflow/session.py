"""What every query needs of its session: settings, and the folder that its executors share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Turns off partitioning-aware unions, which lose rows in Spark 4.1.2.

    There a union of two children with the same hash partitioning keeps it; when adaptive execution then
    coalesces the children's shuffles differently, partitions of one child are read past. The setting holds
    for plans made later, so it stays set for the session.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


#: Bytes of a shuffle that make a task, the parts that a shuffle is dealt into before small ones are joined to that size, and
#: how many times larger rows may be than their files, and than the measured rows that they are exploded from. A task's bytes are compressed ones: its
#: sorts were seen to hold 48 times as many. Beyond 2,000 parts Spark keeps only their mean size. Fixed values.
TASK, PARTS, PACKED, EXPLODED = "4m", 2000, 100, 8
#: Bytes of files that make a task at most: what it sends to a shuffle is sorted unpacked, some fifteen times a table's bytes. Fixed value.
SPLIT = 16 << 20
#: Bytes of byte code up to which HotSpot compiles a method. Fixed value.
COMPILED = 8000
#: The setting by which an execution's shuffle files go when it ends, and not when the driver happens to collect its heap.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def measured(spark: SparkSession) -> SparkSession:
    """prepare, and joins broadcast what adaptive execution has measured to be small, not what its files' size says; tasks keep their size as tables grow.

    Parquet packs the ids, numbers and laws of articles up to a hundredfold, and rows that are exploded count as if they
    weren't. So a table of ten megabytes would be broadcast that is a gigabyte in the driver. An eighth of the session's limit of a broadcast
    holds for measured sizes, as rows exploded from a measured stage count as if they weren't until they are measured themselves; by a file's size only a hundredth of it is. Stages whose generated method is too long for the JVM to compile
    would be interpreted for good, so these run expression by expression. These settings hold for plans made later.
    """
    spark, own, limit = prepare(spark), "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.autoBroadcastJoinThreshold"
    if spark.conf.get(own, None) is None:
        most = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(limit)))
        spark.conf.set(own, str(most if most < 0 else most // EXPLODED))
        spark.conf.set(limit, str(most if most < 0 else most // PACKED))
    if spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) is None:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))))
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK)
    split = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(min(split, SPLIT)))
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(COMPILED))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application within the one that driver and executors share, ``spark.checkpoint.dir`` of the session.

    Where that is unset, a session whose executors are threads of the driver gets a temporary folder for it, as
    in tests; any other is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lexflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lexflow-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, share: int = 1) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts the lineage, survives lost executors.

    share says how many shuffle partitions make one file, for tables whose rows are few and small beside the
    input (ids, edges): it saves files and tasks and grows with the session's number of partitions. The shuffles
    of the write are deleted with its end: its plan is its own, so no later one reads them.
    """
    spark = prepare(df.sparkSession)
    if share > 1:
        df = df.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // share))
    own = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path := shared_path(spark, what))
    finally:
        spark.conf.set(CLEANUP, own)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that no frame will read again."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application; frames that still read them must have been written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
