"""A search index: which texts hold which three characters in a row, so that a search reads few texts.

Rows are written once, by blocks of BLOCK, each with its number. For each trigram of the search keys and each block
there is one list of places in the block, in ascending order; Parquet stores such lists as differences
(DELTA_BINARY_PACKED). Lists lie in buckets by a hash of their trigram, so a search reads the buckets and rows of its
trigrams. A term of three characters or more can only stand in a text that has all its trigrams; a shorter one stands in
a text if one of the text's trigrams holds it (a text of under three characters has itself as its only entry). Lists are
intersected block by block; rows of blocks with candidates are read, joined to these, and looked through.

A list has at most BLOCK places, however common its trigram; a frequent term costs lists in proportion to the blocks.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexflow.functions.text import search_key
from lexflow.operators.search import contains_all, parse
from lexflow.session import prepare, shared_path

#: Rows of a block, and buckets of lists. An index is read with the figures it was written with.
BLOCK, BUCKETS = 4_096, 64
SIZE = 3


@dataclass(frozen=True)
class Index:
    """The tables of an index (rows by block, lists by bucket), the names of the rows' own columns, and the key searched in."""

    rows: DataFrame
    lists: DataFrame
    columns: list[str]
    key: Column
    buckets: int


def _names(columns: list[str]) -> tuple[str, str, str]:
    """Names for block, place and bucket that no column has."""
    taken, out = {c.lower() for c in columns}, []
    for name in ("block", "place", "bucket"):
        while name in taken:
            name += "_"
        out.append(name)
    return tuple(out)


def grams_of(key: Column) -> Column:
    """The distinct trigrams of a search key; a shorter one is its own."""
    every = F.regexp_extract_all(key, F.lit("(?s)(?=(.{%d}))" % SIZE), 1)
    return F.when(F.length(key) < SIZE, F.array(key)).otherwise(F.array_distinct(every))


def build(rows: DataFrame, key: Column | None = None, *, path: str | None = None, block: int = BLOCK, buckets: int = BUCKETS) -> Index:
    """An index over rows, written at path or in the shared folder; key is what searches look in (None: the search key of text).

    Defined cases: rows with a null key are kept and never found by a term; repeated rows are rows each; columns of any name are
    carried along; no rows give an empty index.
    """
    spark, key = prepare(rows.sparkSession), search_key(F.col("text")) if key is None else key
    path = path or shared_path(spark, "index")
    at, place, _ = _names(rows.columns)
    number = F.monotonically_increasing_id()
    numbered = rows.withColumn(at, number).withColumns({place: F.col(at) % block, at: F.floor(F.col(at) / block)})
    numbered.withColumn(place, F.col(place).cast("int")).write.partitionBy(at).parquet(f"{path}/rows")
    schema = numbered.withColumn(place, F.col(place).cast("int")).schema
    stored = spark.read.schema(schema).parquet(f"{path}/rows")
    grams = stored.select(F.col(at).alias("block"), F.col(place).alias("place"), F.explode(grams_of(key)).alias("gram"))
    lists = grams.groupBy("gram", "block").agg(F.array_sort(F.collect_list("place")).alias("places"))
    lists = lists.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int")).repartition("bucket").sortWithinPartitions("bucket", "gram", "block")
    lists.write.partitionBy("bucket").option("parquet.writer.version", "v2").parquet(f"{path}/lists")
    return open_index(rows, path, key=key, buckets=buckets)


def open_index(rows: DataFrame, path: str, key: Column | None = None, buckets: int = BUCKETS) -> Index:
    """The index at path over rows of this schema."""
    spark = rows.sparkSession
    at, place, _ = _names(rows.columns)
    kinds = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema], f"{place} int, {at} long"])
    lists = spark.read.schema("gram string, block long, places array<int>, bucket int").parquet(f"{path}/lists")
    return Index(spark.read.schema(kinds).parquet(f"{path}/rows"), lists, rows.columns, search_key(F.col("text")) if key is None else key, buckets)


def candidates(index: Index, terms) -> DataFrame:
    """block, place of the rows that can hold every term."""
    spark = index.lists.sparkSession
    long = sorted({t[k : k + SIZE] for t in terms if len(t) >= SIZE for k in range(len(t) - SIZE + 1)})
    short = sorted({t for t in terms if len(t) < SIZE})
    lists, gram = index.lists, F.col("gram")
    if short:  # any list may have one
        lists = lists.where(F.reduce(F.array(*[F.contains(gram, F.lit(t)) for t in short]), gram.isin(*long) if long else F.lit(False), lambda a, x: a | x))
    else:
        hashes = spark.range(1).select(F.array(*[F.pmod(F.xxhash64(F.lit(g)), F.lit(index.buckets)).cast("int") for g in long])).first()[0]
        lists = lists.where(F.col("bucket").isin(*set(hashes)) & gram.isin(*long))
    wanted = []
    if long:
        own = F.collect_list(F.when(gram.isin(*long), F.col("places")))
        wanted.append(F.when(F.size(own) == len(long), F.aggregate(F.slice(own, 2, len(long)), F.get(own, 0), lambda a, x: F.array_intersect(a, x))))
    for t in short:
        wanted.append(F.array_distinct(F.flatten(F.collect_list(F.when(F.contains(gram, F.lit(t)), F.col("places"))))))
    found = lists.groupBy("block").agg(*[w.alias(f"w{k}") for k, w in enumerate(wanted)])
    every = F.col("w0")
    for k in range(1, len(wanted)):
        every = F.array_intersect(every, f"w{k}")
    return found.select("block", F.explode(every).alias("place"))


#: Candidates (16 bytes each) that are broadcast at most; beyond, the join with rows shuffles.
BROADCAST = 2_000_000


def search(index: Index, query: str) -> DataFrame:
    """The indexed rows whose key has all phrases and words of query, as search.search_texts gives them."""
    terms = parse(query).terms
    if not terms:
        return index.rows.select(*index.columns)
    found = candidates(index, terms)
    at, place, _ = _names(index.columns)
    small = found.limit(BROADCAST + 1).count() <= BROADCAST
    found = found.select(F.col("block").alias(at), F.col("place").alias(place))
    rows = index.rows.join(F.broadcast(found) if small else found, [at, place], "left_semi")
    return rows.where(contains_all(index.key, terms)).select(*index.columns)
