"""Filters over cards as bitmaps: which cards meet a condition, one bit a card, and all conditions by AND.

Cards are numbered once. A condition's bitmap is some rows of (bucket, bits), 32,768 cards each, made by Spark's bitmap aggregates with
map-side combining; conditions meet by an AND for each bucket, and cards look up their own bit. So composing filters moves four
kilobytes a bucket and condition instead of keys, and a bitmap that is stored serves every later view.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexflow.operators.outline import context_headings
from lexflow.operators.search import marked, of_subject, search_cards
from lexflow.session import stored

#: Cards of a bucket.
SIZE = 32_768
BITMAP = "bucket long, bits binary"


def numbered(cards: DataFrame) -> DataFrame:
    """cards, stored, with card: a number of their own."""
    return stored(cards.withColumn("card", F.monotonically_increasing_id()), "cards")


def bitmap(cards: DataFrame) -> DataFrame:
    """The bitmap (bucket, bits) of some numbered cards."""
    return cards.groupBy(F.bitmap_bucket_number("card").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("card")).alias("bits"))


def both(*bitmaps: DataFrame) -> DataFrame:
    """The bitmap of the cards that are in all bitmaps."""
    rows = bitmaps[0].select("bucket", "bits", F.lit(0).alias("k"))
    for k, more in enumerate(bitmaps[1:], 1):
        rows = rows.unionByName(more.select("bucket", "bits", F.lit(k).alias("k")))
    return rows.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n")).where(F.col("n") == len(bitmaps)).select("bucket", "bits")


def either(*bitmaps: DataFrame) -> DataFrame:
    """The bitmap of the cards that are in one of the bitmaps at least."""
    rows = bitmaps[0]
    for more in bitmaps[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def count(bits: DataFrame) -> DataFrame:
    """n: how many cards a bitmap has."""
    return bits.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


def _has(bits: Column, place: Column) -> Column:
    """Whether the bit at a place is set; the first bit of a byte is its lowest."""
    byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, (place % 8).cast("int")) == 1


def within(cards: DataFrame, bits: DataFrame) -> DataFrame:
    """The numbered cards of a bitmap, with all their columns."""
    rows = cards.withColumn("__bucket", F.bitmap_bucket_number("card")).join(bits.select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits")), "__bucket")
    return rows.where(_has(F.col("__bits"), F.bitmap_bit_position("card"))).drop("__bucket", "__bits")


def view(cards: DataFrame, headings: DataFrame, articles: DataFrame, units: DataFrame, *, query: str = "", refs: DataFrame | None = None, markers: DataFrame | None = None) -> DataFrame:
    """doc_id, seq, kind of what stays visible under a subject's references, marks and a search at once, and the headings over it.

    cards are numbered; without any condition all articles stay.
    """
    own = cards.where("kind = 'article'")
    bits = [bitmap(own)]
    if refs is not None:
        bits.append(bitmap(of_subject(own, refs)))
    if markers is not None:
        hit = marked(articles, units, markers).select("doc_id", "seq")
        bits.append(bitmap(own.join(hit, ["doc_id", "seq"], "left_semi")))
    if query:
        bits.append(bitmap(search_cards(own, query)))
    shown = stored(within(own, both(*bits)).select("doc_id", "seq"), "view")
    over = context_headings(headings, articles).join(shown, ["doc_id", "seq"], "left_semi").select("doc_id", F.col("heading_seq").alias("seq")).distinct()
    return shown.withColumn("kind", F.lit("article")).unionByName(over.withColumn("kind", F.lit("heading")))
