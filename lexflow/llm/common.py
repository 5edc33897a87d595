"""Things that several corpus operators share: tables, row locators, joins on hot keys and word rules."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexflow.session import prepare, shared_path, stored

__all__ = ["HOT", "ROW_BY_ROW", "SPACE", "bounded", "free_name", "joined", "located", "shared_path", "stored", "table"]

#: ASCII white space, as every word rule of this subpackage sees it.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, read by Spark whatever store the path names."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, columns: list[str]) -> str:
    """name, or the first of name_, name__ and so on that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Plan nodes under which each row of a scan is one row still.
ROW_BY_ROW = {"Project", "Filter", "SubqueryAlias", "LogicalRelation"}


def _plain_scan(docs: DataFrame) -> bool:
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ROW_BY_ROW and node.children().size() == 1:
        node = node.children().apply(0)
    return node.nodeName() == "LogicalRelation" and "_metadata" not in docs.columns


def located(docs: DataFrame) -> tuple[DataFrame, list[str], str, str]:
    """docs with the place of each row, the same on every read; the names of docs' columns there, and those of file and row.

    The place is the Parquet file and the row in it. A frame that isn't a plain scan, or hides the scan's own
    column, is written to the shared folder first. Names that docs has itself aren't taken.
    """
    prepare(docs.sparkSession)
    if not _plain_scan(docs):
        docs = docs.withColumnRenamed("_metadata", free_name("metadata", docs.columns))
        docs = stored(docs, "rows")
    names = docs.columns
    file, row = free_name("__file", names), free_name("__row", names)
    return docs.select("*", F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row)), names, file, row


#: Keys that hold more than one of so many rows are hot; there can't be more than so many of them.
HOT = 10_000


def joined(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """big joined to small, which has each key once and in ``many`` how many rows of big have it.

    The hot keys of a table are few whatever its size, so they are broadcast; the others are shuffled, and no
    task gets more than its share. big is a stored table, as it is read twice.
    """
    total = big.count()
    hot = F.broadcast(small.where(F.col("many") * HOT > total).drop("many"))
    cold = small.where(F.col("many") * HOT <= total).drop("many")
    return big.join(hot, on, how).unionByName(big.join(hot.select(*on), on, "left_anti").join(cold, on, how))


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast only if it is counted to hold no more than so many rows; else joins shuffle it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
