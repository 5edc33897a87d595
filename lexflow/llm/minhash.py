"""Near-duplicate documents: one-permutation MinHash, optimal densification, bands, star-shaped candidates.

1. One pass over the whole texts hashes all shingles, by a key that each run draws for itself, so that no text can
   be written to collide with another, and gives, for each document, the size of its shingle set,
   a 128-bit digest of the whole set and the keys of its bands. A single hash per shingle fills BINS bins;
   an empty bin takes the value of a bin that a hash of (bin, attempt) names (Shrivastava, 2017).
2. Documents with the same set form a class, found with map-side combining; its smallest doc_id stands for it.
3. Classes that share a band key form a bucket. Each bucket gives only edges between one centre and its
   members, so edges are linear in bucket entries. Edges are then confirmed on the full sets; a centre of many
   edges is dealt to several tasks.
4. Confirmed links make components. A bucket that still holds several components gets further stars, from
   centres of components drawn evenly, with edges to the members of other components only. Two linked
   documents share about ten buckets, so a link that the first star misses has some ten times as many
   further chances, and it only matters while its ends are in different components.
5. What is left is finished exactly: among the members of buckets that still hold several components, each
   pair across components that meets the threshold shares a shingle in its prefixes (Chaudhuri et al., 2006;
   positions as in Xiao et al., 2008). Frequent shingles are compared in blocks, so that no task takes a
   whole group, and no pair is left out.

Buckets hold each pair at the threshold with probability 1 - (1 - 0.75^4)^32, over 0.99999.
"""

import hashlib
import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexflow.llm.arrow_text import LOWER, chained, grams, mix, randoms, slices, task
from lexflow.llm.common import HOT, bounded, free_name, joined, stored
from lexflow.llm.components import components

BINS, ROWS, SHINGLE, PERCENT, CENTRES = 128, 4, 5, 75, 3
EMPTY = np.uint64(2**64 - 1)

#: At most so many ids (8 bytes each) are broadcast to pick the texts of candidates.
BROADCAST_IDS = 2_000_000

#: An end of more pairs than this that is hot has its set in a task for each so many of them.
PART = 256

#: So many of a shingle's members are about one block; each block meets each other block of its shingle.
BLOCK = 512


def shingle_sets(texts: pa.Array, width: int = SHINGLE, key: bytes = b""):
    """For consecutive rows: (first row, distinct shingle hashes end to end in ascending order per row, how many per row).

    Words are lower-cased (A-Z). A text with fewer words than width has them all as its one shingle.
    """
    for row, words in slices(texts):
        h = words.hashes(seed=11, fold=LOWER, key=key)
        g, _, have = grams(h, words.first, words.counts, width, seed=5)
        ends = np.cumsum(have)
        parts, sizes = [], np.zeros(len(have), np.int64)
        for i, (e, n) in enumerate(zip(ends.tolist(), have.tolist(), strict=True)):
            if n:
                own = np.unique(g[e - n : e])
            elif words.counts[i]:
                at = words.first[i]
                own = chained([h[k : k + 1] for k in range(at, at + words.counts[i])], seed=100 + int(words.counts[i]))
            else:
                continue
            parts.append(own)
            sizes[i] = len(own)
        yield row, np.concatenate(parts) if parts else np.zeros(0, np.uint64), sizes


def signatures(values: np.ndarray, sizes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One-permutation minima of each set, densified; rows of empty sets stay EMPTY."""
    h = mix(values ^ np.uint64(0x5851F42D4C957F2D))
    low = np.uint64(64 - int(bins).bit_length() + 1)
    sig = np.full(len(sizes) * bins, EMPTY)
    np.minimum.at(sig, np.repeat(np.arange(len(sizes)), sizes) * bins + (h >> low).astype(np.int64), h)
    sig = sig.reshape(len(sizes), bins)
    full, out = sig != EMPTY, sig.copy()
    row, col = np.nonzero(~full & (sizes > 0)[:, None])
    attempt = 0
    while len(row):
        donor = (randoms(1000 + attempt, bins) % np.uint64(bins)).astype(np.int64)[col] if attempt < 4000 else (col + attempt) % bins
        got = full[row, donor]
        out[row[got], col[got]] = sig[row[got], donor[got]]
        row, col, attempt = row[~got], col[~got], attempt + 1
    return out


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A key for each band of so many bins; the band's number is part of it."""
    bands = sig.shape[1] // rows
    keys = np.empty((len(sig), bands), np.uint64)
    for b in range(bands):
        keys[:, b] = chained([sig[:, b * rows + k] for k in range(rows)], seed=7000 + b)
    return keys


def _digests(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """128 bits of each set, as two numbers; zeros for an empty one."""
    raw, ends = values.tobytes(), (8 * np.cumsum(sizes)).tolist()
    sums = [hashlib.blake2b(raw[a:e], digest_size=16).digest() if e > a else bytes(16) for a, e in zip([0, *ends], ends, strict=False)]
    return np.frombuffer(b"".join(sums), "<i8").reshape(-1, 2)


def _sketch(bins: int, rows: int, width: int, key: bytes):
    @task
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for row, values, sizes in shingle_sets(batch.column(1), width, key):
                digests = _digests(values, sizes)
                keys = band_keys(signatures(values, sizes, bins), rows)
                some = sizes > 0
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.where(some, keys.shape[1], 0))]).astype(np.int32), pa.array(keys[some].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(row, len(sizes)), pa.array(sizes), pa.array(digests[:, 0]), pa.array(digests[:, 1]), lists], ["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return run


def _full_sets(width: int, key: bytes):
    @task
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for row, values, sizes in shingle_sets(batch.column(1), width, key):
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(values.view(np.int64)))
                digests = _digests(values, sizes)
                yield pa.RecordBatch.from_arrays([ids.slice(row, len(sizes)), pa.array(digests[:, 0]), pa.array(digests[:, 1]), lists], ["doc_id", "set_a", "set_b", "shingles"])

    return run


def sketches(docs: DataFrame, *, bins: int = BINS, rows: int = ROWS, width: int = SHINGLE, key: bytes = b"") -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (the set's identity) and bands of every row with a doc_id."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    return texts.mapInArrow(_sketch(bins, rows, width, key), "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def beside(pairs: DataFrame, rows: DataFrame, sets: DataFrame, end: str, name: str) -> DataFrame:
    """rows of pairs with the set of their end (u or v) under a name; ends of many pairs have their set in several tasks."""
    total = pairs.count()
    hot = pairs.groupBy(end).agg(F.count("*").alias("many")).where((F.col("many") * HOT > total) & (F.col("many") > PART))
    hot = F.broadcast(hot.select(end, F.ceil(F.col("many") / PART).alias("parts")))  # at most HOT rows
    parts = F.coalesce("parts", F.lit(1))
    left = rows.join(hot, end, "left").withColumn("part", F.pmod(F.xxhash64("u", "v"), parts)).drop("parts")
    right = sets.select(F.col("doc_id").alias(end), F.col("shingles").alias(name)).join(hot, end, "left")
    return left.join(right.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts"), [end, "part"]).drop("part")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of a stored table whose full sets meet the threshold."""
    both = beside(pairs, beside(pairs, pairs, sets, "v", "b"), sets, "u", "a").withColumn("both", F.size(F.array_intersect("a", "b")).cast("long"))
    return both.where(100 * F.col("both") >= percent * (F.size("a") + F.size("b") - F.col("both"))).select("u", "v")


def near_duplicates(docs: DataFrame, *, bins: int = BINS, rows: int = ROWS, width: int = SHINGLE, percent: int = PERCENT, centres: int = CENTRES, key: bytes | None = None) -> DataFrame:
    """One row per row of docs with a doc_id: doc_id, n_shingles, component_id, kept, n_links.

    Documents are linked when 100 * |both sets| >= percent * |either set| of their distinct width-word
    shingles; component_id is the smallest doc_id that links reach, the document itself included, and kept
    marks the documents with that id. n_links counts the confirmed links of a document's class to other
    classes, which need not be all. Defined cases: a null or blank text has an empty set and no link; a row without doc_id is
    no node and gives no row; rows that repeat a doc_id are one node and a row each, and if their sets differ, the
    node's is that with the least digest; other columns play no part; no rows give no rows. key keys the hashes of words (None: one drawn for this run).
    """
    key = secrets.token_bytes(16) if key is None else key
    sketch = stored(sketches(docs, bins=bins, rows=rows, width=width, key=key), "minhash")
    own = ["set_a", "set_b", "size"]
    all_rows, empty = sketch.where("n_shingles > 0").withColumn("size", F.col("n_shingles")), sketch.where("n_shingles = 0").select("doc_id", "n_shingles")
    repeated = sketch.groupBy("doc_id").agg(F.count("*").alias("many"), F.min(F.when(F.col("n_shingles") > 0, F.struct("set_a", "set_b", F.col("n_shingles").alias("size")))).alias("least")).where("many > 1")
    nodes, alone = all_rows, repeated.isEmpty()
    if not alone:
        repeated = stored(repeated, "minhash-repeated", 8)
        nodes = all_rows.join(repeated, "doc_id", "left").where(F.col("least").isNull() | (F.struct(*own) == F.col("least"))).drop("many", "least").dropDuplicates(["doc_id"])
        several = repeated.where("least is not null").select("doc_id", "many", "least.*")
        all_rows = all_rows.join(repeated.select("doc_id"), "doc_id", "left_anti").select("doc_id", "n_shingles", *own).unionByName(joined(all_rows.select("doc_id", "n_shingles"), several, ["doc_id"]))
        all_rows = stored(all_rows, "minhash-rows")
    classes = nodes.groupBy(*own).agg(F.min("doc_id").alias("rep"))
    classes = stored(classes, "minhash-classes", 4)
    reps = nodes.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", *own], "left_semi")
    entries = reps.select(F.col("doc_id").alias("rep"), F.col("size").alias("n"), "set_a", "set_b", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.min("rep").alias("centre"), F.count("*").alias("size")).where("size > 1")
    buckets = stored(entries.join(shared, "key"), "minhash-buckets", 2)
    ids = stored(buckets.select(F.col("rep").alias("doc_id"), "set_a", "set_b").distinct(), "minhash-ids", 8)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(bounded(ids.select("doc_id"), BROADCAST_IDS), "doc_id", "left_semi")
    sets = texts.mapInArrow(_full_sets(width, key), "doc_id long, set_a long, set_b long, shingles array<long>")
    if not alone:  # of the rows of a node, one that has its set
        sets = sets.join(bounded(ids, BROADCAST_IDS), ["doc_id", "set_a", "set_b"], "left_semi").dropDuplicates(["doc_id"])
    sets = stored(sets.select("doc_id", "shingles"), "minhash-sets")
    buckets = buckets.drop("set_a", "set_b")

    sizes = buckets.select(F.col("rep").alias("centre"), F.col("n").alias("m")).distinct()
    pairs = buckets.where("rep <> centre").select(F.col("centre").alias("u"), F.col("rep").alias("v"), "n").distinct()
    near = stored(pairs.join(sizes.withColumnRenamed("centre", "u"), "u").where(100 * F.least("n", "m") >= percent * F.greatest("n", "m")).select("u", "v"), "minhash-edges", 4)
    links = stored(confirmed(near, sets, percent), "minhash-links", 4)
    found = components(links)
    edges = stored(_more_edges(buckets.select("key", "rep", "n"), found, percent, centres).join(near, ["u", "v"], "left_anti"), "minhash-edges", 4)
    more = stored(confirmed(edges, sets, percent), "minhash-links", 4)
    if not more.isEmpty():
        links = links.union(more)
        found = components(links)
    left = stored(_left_edges(buckets.select("key", "rep", "n"), found, sets, percent), "minhash-edges", 4)
    more = stored(confirmed(left, sets, percent), "minhash-links", 4)
    if not more.isEmpty():
        links = links.union(more)
        found = components(links)

    degree = links.select(F.explode(F.array("u", "v")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    counts = all_rows.groupBy(*own).agg(F.count("*").alias("many"))
    roots = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left").join(counts, own)
    roots = stored(roots.select(*own, "many", F.coalesce("component", "rep").alias("component"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "minhash-roots", 4)
    out = joined(all_rows.select("doc_id", "n_shingles", *own), roots, own)
    if alone:
        out = out.select("doc_id", "n_shingles", "component", "n_links").unionByName(empty.select("doc_id", "n_shingles", F.col("doc_id").alias("component"), F.lit(0).cast("long").alias("n_links")))
    else:  # an empty row of a node that has a set elsewhere is that node's
        several = several.drop("many").join(roots.drop("many"), own).select("doc_id", "component", "n_links")
        empty = empty.join(several, "doc_id", "left")
        out = out.select("doc_id", "n_shingles", "component", "n_links").unionByName(empty.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")))
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"), "n_links")


def _more_edges(entries: DataFrame, found: DataFrame, percent: int, centres: int) -> DataFrame:
    """For buckets (key, rep, n) that hold several components: edges from further centres to the members of other components.

    A centre's component is drawn evenly from those of the bucket, by a hash of component, key and turn.
    """
    labelled = entries.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    drawn = [F.min(F.struct(F.xxhash64("component", "key", F.lit(k)).alias("draw"), F.xxhash64("rep", "key", F.lit(k)).alias("own"), F.col("rep").alias("centre"), F.col("component").alias("of"), F.col("n").alias("m"))) for k in range(centres)]
    mixed = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.array_distinct(F.array(*drawn)).alias("centres")).where("low <> high").select("key", F.inline("centres"))
    edges = labelled.join(mixed, "key").where((F.col("component") != F.col("of")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m")))
    return edges.select(F.least("rep", "centre").alias("u"), F.greatest("rep", "centre").alias("v")).distinct()


def _left_edges(entries: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs (u, v) across components that can meet the threshold, of the members of buckets that hold several components.

    Shingles are ordered: those of one component first, which no such pair shares, then rare ones. A pair that
    meets the threshold has its first shared shingle where enough of both sets is still to come.
    """
    labelled = entries.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    members = stored(labelled.join(mixed, "key").select(F.col("rep").alias("doc_id"), "component", "n").distinct(), "minhash-left", 8)
    tokens = sets.join(bounded(members, BROADCAST_IDS), "doc_id").select("doc_id", "component", "n", F.explode("shingles").alias("token"))
    tokens = stored(tokens, "minhash-tokens")
    common = tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token", "df", F.col("df").alias("many"))
    own = Window.partitionBy("doc_id")
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "token"))
    prefix = joined(tokens, stored(common, "minhash-common", 4), ["token"]).withColumn("place", place).where(100 * (F.col("n") - F.col("place") + 1) >= percent * F.col("n")).select("doc_id", "component", "n", "token", "place")
    prefix = stored(prefix, "minhash-prefixes", 4)
    blocks = prefix.groupBy("token").agg(F.count("*").alias("many"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token", "many", F.ceil(F.col("many") / BLOCK).alias("blocks"))
    dealt = joined(prefix, stored(blocks, "minhash-blocks", 4), ["token"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    a = dealt.select("token", F.col("block").alias("i"), every.alias("j"), F.col("doc_id").alias("u"), F.col("component").alias("cu"), F.col("n").alias("nu"), F.col("place").alias("pu"))
    b = dealt.select("token", every.alias("i"), F.col("block").alias("j"), F.col("doc_id").alias("v"), F.col("component").alias("cv"), F.col("n").alias("nv"), F.col("place").alias("pv"))
    most = F.least(F.col("nu") - F.col("pu"), F.col("nv") - F.col("pv")) + 1
    enough = 100 * most >= percent * (F.col("nu") + F.col("nv") - most)
    pairs = a.hint("merge").join(b, ["token", "i", "j"]).where((F.col("u") < F.col("v")) & (F.col("cu") != F.col("cv")) & enough)
    return pairs.select("u", "v").distinct()


def drop_near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs but those of documents that near_duplicates doesn't keep, with all their columns, whatever their names.

    A row without doc_id stays, and so do rows with null or blank texts; rows that repeat a kept doc_id all stay;
    no rows give no rows. Few dropped ids are broadcast; more of them leave by a shuffled anti-join.
    """
    dropped = near_duplicates(docs, **parameters).where("not kept").select("doc_id").distinct()
    name = free_name("__dropped", docs.columns)
    dropped = bounded(stored(dropped, "minhash-dropped", 8), BROADCAST_IDS).withColumnRenamed("doc_id", name)
    return docs.join(dropped, docs["doc_id"] == dropped[name], "left_anti")
