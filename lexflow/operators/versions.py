"""Which version of a provision is in force, and which articles are revoked."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def mark_old(units: DataFrame) -> DataFrame:
    """units, with each child old that the next child of its article renames."""
    block = Window.partitionBy("doc_id", "block_id", "role").orderBy("seq")
    renamed = (F.col("role") == "child") & (F.lead("identifier").over(block) == F.col("identifier"))
    return units.withColumn("is_old_version", F.col("is_old_version") | F.coalesce(renamed, F.lit(False)))


def swap_caputs(units: DataFrame) -> DataFrame:
    """units, where an old caput of an article with children changes roles with the first version of its name that isn't old."""
    block = Window.partitionBy("doc_id", "block_id")
    caput = F.max(F.when((F.col("role") == "caput") & F.col("is_old_version"), F.struct("seq", "identifier"))).over(block)
    rows = units.withColumns({"__caput": caput, "__children": F.max((F.col("role") == "child").cast("int")).over(block)})
    fits = (F.col("role") == "version") & ~F.col("is_old_version") & (F.col("identifier") == F.col("__caput.identifier")) & (F.col("__children") == 1)
    rows = rows.withColumn("__new", F.min(F.when(fits, F.col("seq"))).over(block))
    role = F.when(F.col("__new").isNull(), F.col("role")).when(F.col("seq") == F.col("__new"), "caput").when(F.col("role") == "caput", "version").otherwise(F.col("role"))
    return rows.withColumn("role", role).drop("__caput", "__children", "__new")


def revoked_articles(units: DataFrame) -> DataFrame:
    """doc_id, block_id, is_revoked: the caput is revoked and no child in force isn't."""
    caput = F.max((F.col("role") == "caput") & F.col("is_revoked"))
    alive = F.max((F.col("role") == "child") & ~F.col("is_old_version") & ~F.col("is_revoked"))
    return units.groupBy("doc_id", "block_id").agg((caput & ~alive).alias("is_revoked"))


def resolve(units: DataFrame) -> DataFrame:
    return swap_caputs(mark_old(units))


def next_versions(units: DataFrame) -> DataFrame:
    """Old provisions and the version after each: doc_id, block_id, seq, next_seq, text, next_text.

    Versions of an article come first, then its caput and children. What follows counts as the next version
    if it is another old one of the same name, or the first one in force and of that name (spaces aside) or
    the caput; other old ones are passed over.
    """
    rank = F.when(F.col("role") == "version", 0).when(F.col("role") == "caput", 1).otherwise(2)
    named = F.regexp_replace(F.regexp_extract("text", r"(?U)^(.+?)\s+[-–—]\s", 1), r"(?U)\s+", "")
    rows = units.select("doc_id", "block_id", "seq", "role", "identifier", "text", "is_old_version", F.struct(rank.alias("rank"), "seq").alias("place"), named.alias("ident"))
    rows = rows.withColumn("is_old", F.col("is_old_version") & (F.col("role") != "caput"))
    same = Window.partitionBy("doc_id", "block_id", "is_old", "ident").orderBy("place")
    ahead = Window.partitionBy("doc_id", "block_id").orderBy("place").rowsBetween(1, Window.unboundedFollowing)
    live = F.struct("seq", "text", "identifier", "role", "place")
    rows = rows.withColumns({"old": F.when(F.col("is_old"), F.lead(F.struct("seq", "text", "place")).over(same)), "live": F.first(F.when(~F.col("is_old"), live), ignorenulls=True).over(ahead)})
    squeezed = F.regexp_replace("live.identifier", r"(?U)\s+", "")
    fits = F.col("live").isNotNull() & ((F.col("ident") == "") | (F.col("ident") == squeezed) | (F.col("live.role") == "caput"))
    by_old = F.col("old").isNotNull() & (F.col("live").isNull() | (F.col("old.place") < F.col("live.place")))
    rows = rows.where("is_old").withColumn("next", F.when(by_old, F.struct(F.col("old.seq"), F.col("old.text"))).when(fits, F.struct(F.col("live.seq"), F.col("live.text"))))
    return rows.where("next is not null").select("doc_id", "block_id", "seq", F.col("next.seq").alias("next_seq"), "text", F.col("next.text").alias("next_text"))
