"""Quality rules: repetition limits, then a hashed n-gram likelihood ratio of trusted text against the corpus.

Everything is DataFrame functions. Words and pairs of words of all documents fall into a fixed number of
buckets by their hash; one aggregation, combined on the map side, counts buckets over the whole corpus and
over the trusted documents. The two smoothed multinomials give a weight for each bucket, a table of fixed
size, and a document's score is the mean weight of its words and pairs: a log likelihood ratio for each of
them, so length doesn't count. A document is kept when no base rule fails and its score reaches a fixed
threshold.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexflow.llm.common import SPACE

#: THRESHOLD is the mean log ratio of a word or pair below which a text reads less like the trusted ones than like
#: the corpus at large; it was put into the gap between the scores of documents labelled 0 (up to -0.147) and 1 (from
#: -0.037) at sf0.1. Other corpora need one of their own.
BUCKETS, SMOOTH, THRESHOLD = 1 << 16, 1.0, -0.09
MIN_WORDS, REPEAT_PERCENT = 50, 50
#: Trusted documents that the target's counts come from at most, those with the least hashes of their ids; so many are broadcast.
TRUSTED = 200_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def bound(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def indices(n: Column) -> Column:
    """0 to n - 1; nothing for n below 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def bucket_list(words: Column, buckets: int) -> Column:
    """The buckets of all words and of all pairs of neighbours."""

    def both(w):
        one = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))
        two = F.transform(indices(F.size(w) - 1), lambda i: F.pmod(F.xxhash64(F.get(w, i), F.lit(" "), F.get(w, i + 1)), F.lit(buckets)).cast("int"))
        return F.concat(one, two)

    return bound(words, both)


def repeat_words(words: Column) -> Column:
    """Words that lie in 3-word windows found twice or more in the text."""

    def covered(pairs):
        again = F.filter(pairs, lambda x, k: (F.get(pairs, k - 1)["h"] == x["h"]) | F.coalesce(F.get(pairs, k + 1)["h"] == x["h"], F.lit(False)))
        at = F.array_sort(F.transform(again, lambda x: x["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(at, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])

    def seen(h):
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(bound(pairs, covered))

    def windows(w):
        return F.transform(indices(F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return bound(bound(words, windows), seen)


def bucket_weights(docs: DataFrame, trusted: DataFrame, *, buckets: int = BUCKETS, smooth: float = SMOOTH, most: int = TRUSTED) -> list[float]:
    """For each bucket, log of its share in trusted documents over its share in all; buckets rows reach the driver at most."""
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumn("good", F.lit(1))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id", "left")
    grams = own.select(F.coalesce("good", F.lit(0)).alias("good"), F.explode(bucket_list(words_of(F.col("text")), buckets)).alias("bucket"))
    raw, good = [0] * buckets, [0] * buckets
    for row in grams.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("good").alias("good")).collect():
        raw[row["bucket"]], good[row["bucket"]] = row["n"], row["good"]
    all_raw, all_good = sum(raw) + smooth * buckets, sum(good) + smooth * buckets
    return [math.log((g + smooth) / all_good) - math.log((r + smooth) / all_raw) for g, r in zip(good, raw, strict=True)]


def quality_rules(docs: DataFrame, trusted: DataFrame, *, buckets: int = BUCKETS, smooth: float = SMOOTH, threshold: float = THRESHOLD, most: int = TRUSTED) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score.

    trusted names the documents of the target by doc_id; most of them are counted at most, the corpus is counted whole. Defined cases: a null, empty or blank text has no
    words, fails the base rules and scores 0; without trusted documents every score compares the smoothed
    uniform shares with the corpus; a row without doc_id is judged but never trusted; repeated rows count as often as they
    stand there; no rows give no rows; other columns play no part.
    """
    weights = bucket_weights(docs, trusted, buckets=buckets, smooth=smooth, most=most)
    weights = F.split(F.lit(",".join(f"{w:.9g}" for w in weights)), ",").cast("array<double>")  # one literal after constant folding
    text = F.coalesce("text", F.lit(""))
    mean = lambda g: F.when(F.size(g) == 0, 0.0).otherwise(F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(weights, b)) / F.size(g))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), words_of(text).alias("words"))
    rows = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        bound(bucket_list(F.col("words"), buckets), mean).alias("score"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"), "score")
