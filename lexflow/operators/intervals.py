"""Ranges of article numbers as intervals: what they hit and what they miss, whatever their width.

A range is covered by dyadic blocks, at most two of each size: block b of level k holds the numbers from b * 2**k to
(b + 1) * 2**k - 1. A number lies in a range if one of its blocks (one a level) is in the cover, so a range join is an equi-join
on (level, block). What no article has is intervals too: the gaps between known numbers are made once, and a range's
dangling parts are the gaps that begin in it and the one that it begins in, cut at its ends.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexflow.operators.subjects import device_lines

#: Numbers lie below 2**LEVELS.
LEVELS = 62
LAST = (1 << LEVELS) - 1
#: Known numbers are ordered within spans of 2**SPAN numbers, and these by their first and last.
SPAN = 16


def cover(lo: Column, hi: Column) -> Column:
    """The blocks (level, block) that make up the numbers from lo to hi; none if hi is below lo."""

    def at(k: Column) -> Column:
        power = F.element_at(F.lit([1 << n for n in range(LEVELS + 1)]), k + 1)
        left, right = F.call_function("shiftright", lo + power - 1, k), F.call_function("shiftright", hi + 1, k)
        first = (left < right) & (left % 2 == 1)
        last = (left < right) & (right % 2 == 1) & (right - 1 >= left + left % 2)
        block = lambda b: F.struct(k.alias("level"), b.alias("block"))
        return F.array_compact(F.array(F.when(first, block(left)), F.when(last, block(right - 1))))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), at))


def blocks_of(number: Column) -> Column:
    """The blocks (level, block) that hold a number, one a level."""
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", number, k).alias("block")))


def within(points: DataFrame, ranges: DataFrame, number: str, lo: str = "lo", hi: str = "hi", on: tuple[str, ...] = ()) -> DataFrame:
    """points joined to the ranges that hold their number; both have the columns of on, which have to be equal."""
    a = points.withColumn("__b", F.explode(blocks_of(F.col(number)))).select("*", F.col("__b.level").alias("__level"), F.col("__b.block").alias("__block")).drop("__b")
    b = ranges.withColumn("__b", F.explode(cover(F.col(lo), F.col(hi)))).select("*", F.col("__b.level").alias("__level"), F.col("__b.block").alias("__block")).drop("__b")
    levels = b.select("__level").distinct()  # at most LEVELS + 1
    return a.join(F.broadcast(levels), "__level").join(b, ["__level", "__block", *on]).drop("__level", "__block")


def ranges_of(entries: DataFrame) -> DataFrame:
    """row_no, subject, sub_subject, line, law_prefix, hint, lo, hi of the entries' ranges that don't run down; they end below LAST."""
    rows = device_lines(entries).where("lo <= hi").where(F.col("lo") < LAST)
    return rows.select("row_no", "subject", "sub_subject", "line", "law_prefix", "hint", "lo", F.least("hi", F.lit(LAST - 1)).alias("hi"))


def numbers_of(articles: DataFrame) -> DataFrame:
    """law_prefix, step, sub, art of the articles that ranges reach: those of a law under its prefix, and all under none; sub is empty for plain numbers."""
    step = F.regexp_extract("art_number", "^([0-9]+)(-[A-Za-z].*)?$", 1).try_cast("long")
    rows = articles.select(F.explode(F.array_distinct(F.array("law_prefix", F.lit("")))).alias("law_prefix"), step.alias("step"), "art_number").where((F.col("step") >= 0) & (F.col("step") < LAST))
    plain = F.col("art_number").rlike("^[0-9]+$")
    return rows.select("law_prefix", "step", F.when(plain, "").otherwise(F.col("art_number")).alias("sub"), F.when(plain, F.col("step").cast("string")).otherwise(F.col("art_number")).alias("art")).distinct()


def range_targets(entries: DataFrame, articles: DataFrame) -> DataFrame:
    """row_no, line, law_prefix, step, art: the known articles that each range reaches, plain and lettered."""
    return within(numbers_of(articles), ranges_of(entries), "step", on=("law_prefix",)).select("row_no", "line", "law_prefix", "step", "art")


def gaps(numbers: DataFrame) -> DataFrame:
    """law_prefix, lo, hi: the numbers from 0 to LAST - 1 that aren't among numbers (law_prefix, step), as intervals; a law without any has none."""
    known = numbers.select("law_prefix", "step", F.shiftright("step", SPAN).alias("span")).distinct()
    spans = known.groupBy("law_prefix", "span").agg(F.max("step").alias("top"))
    over = Window.partitionBy("law_prefix").orderBy("span")
    spans = spans.select("law_prefix", "span", F.lag("top").over(over).alias("below"), F.when(F.lead("span").over(over).isNull(), F.col("top")).alias("end"))
    own = F.lag("step").over(Window.partitionBy("law_prefix", "span").orderBy("step"))
    rows = known.withColumn("previous", own).join(spans, ["law_prefix", "span"])
    below = F.coalesce("previous", "below", F.lit(-1).cast("long"))
    inner = rows.select("law_prefix", (below + 1).alias("lo"), (F.col("step") - 1).alias("hi")).where("lo <= hi")
    return inner.unionByName(spans.where("end is not null").select("law_prefix", (F.col("end") + 1).alias("lo"), F.lit(LAST - 1).alias("hi")))


def dangling_ranges(entries: DataFrame, articles: DataFrame) -> DataFrame:
    """row_no, line, law_prefix, lo, hi: the parts of ranges that have no article with that number, as they stand between known numbers."""
    ranges = ranges_of(entries)
    numbers = numbers_of(articles).where("sub = ''").select("law_prefix", "step")
    free = gaps(numbers).select("law_prefix", F.col("lo").alias("from"), F.col("hi").alias("to"))
    begins = within(free, ranges, "from", on=("law_prefix",))
    holds = within(ranges, free, "lo", "from", "to", on=("law_prefix",)).where("from < lo")
    cut = begins.unionByName(holds.select(begins.columns)).select("row_no", "line", "law_prefix", F.greatest("lo", "from").alias("lo"), F.least("hi", "to").alias("hi"))
    unknown = ranges.join(numbers.select("law_prefix").distinct(), "law_prefix", "left_anti").select("row_no", "line", "law_prefix", "lo", "hi")
    return cut.unionByName(unknown)
