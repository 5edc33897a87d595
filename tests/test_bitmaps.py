"""Bitmaps of cards against sets."""

import random

from pyspark.sql import functions as F

from lexflow.operators import bitmaps


def test_bitmaps_equal_sets(spark):
    rnd = random.Random(6)
    cards = bitmaps.numbered(spark.range(120_000).select(F.col("id").alias("seq"), F.lit("article").alias("kind")).repartition(3))
    number = {r.seq: r.card for r in cards.collect()}
    assert len(set(number.values())) == 120_000
    some = [set(rnd.sample(range(120_000), n)) for n in (60_000, 30_000, 50_000)]
    frames = [cards.join(spark.createDataFrame([(x,) for x in s], "seq long"), "seq", "left_semi") for s in some]
    bits = [bitmaps.bitmap(f) for f in frames]
    met = bitmaps.both(*bits)
    assert {r.seq for r in bitmaps.within(cards, met).collect()} == some[0] & some[1] & some[2]
    assert bitmaps.count(bitmaps.either(*bits)).first().n == len(some[0] | some[1] | some[2])
    assert bitmaps.within(cards, met).columns == cards.columns
    none = bitmaps.bitmap(cards.limit(0))
    assert bitmaps.both(bits[0], none).count() == 0 and bitmaps.count(none).first().n == 0 and bitmaps.within(cards, none).count() == 0
