import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import TEXTS, odd_table, pairs, table, thue_morse
from pyspark.sql import functions as F

from lexflow.llm import common, components, exact_dedup, minhash, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def random_texts(seed, n=150):
    """Texts that share passages, are near copies of one another, or repeat themselves."""
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(45)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.randint(1, 120))] for _ in range(n // 3)]
    out = []
    for k in range(n):
        own = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 5])):
            own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
        if rnd.random() < 0.25:
            at = rnd.randint(0, len(own))
            own[at:at] = passage[: rnd.choice([19, 20, 21, 45])]
        if rnd.random() < 0.1:
            own += ["same"] * rnd.randint(1, 60)
        out.append((k * 7 % 1000, " ".join(own) if rnd.random() < 0.9 else "\n".join(own)))
    return out


# exact


def exact_model(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = Counter()
    for norm, ids in groups.items():
        known = [i for i in ids if i is not None]
        for i in ids:
            out[i, min(known) if known else None, len(ids), hashlib.sha256(norm.encode()).hexdigest()] += 1
    return out


def got_exact(frame):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in frame.collect())


def weak(norm):
    return F.unhex(F.substring(F.sha2(norm, 256), 1, 1).cast("string").substr(1, 1))


@pytest.mark.parametrize("digest", [exact_dedup.sha256, weak])
def test_exact_groups(spark, digest):
    docs = odd_table(spark)
    got = exact_dedup.exact_groups(docs, digest=digest)
    assert got_exact(got) == exact_model(pairs(docs))
    kept = got.where("kept").groupBy("text_sha256").count().collect()
    assert {r["count"] for r in kept} == {1} and len(kept) == got.select("text_sha256").distinct().count()


def test_exact_batches_share_state(spark):
    docs = table(spark, random_texts(1) + random_texts(1)).repartition(6)
    got = exact_dedup.exact_groups(docs, batch_bytes=1)
    assert got_exact(got) == exact_model(pairs(docs))


def test_drop_copies(spark):
    docs = odd_table(spark)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    norms = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in pairs(left)]
    assert len(norms) == len(set(norms)) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in pairs(docs)})
    assert (0, TEXTS[0]) in pairs(left) and (1, TEXTS[1]) not in pairs(left)


def test_exact_empty(spark):
    assert exact_dedup.exact_groups(table(spark, [])).count() == 0
    assert exact_dedup.drop_copies(table(spark, [])).count() == 0


# components


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 440)] + [(900, k) for k in range(901, 960)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    frame = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.component for r in components.components(frame).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components.components(frame.limit(0)).count() == 0


# near


def near_model(rows):
    fold = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
    sets = {}
    for i, t in rows:
        w = [x.translate(fold) for x in words(t)]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {(i, len(s), find(i), find(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize("seed", [5, 6])
def test_near_duplicates(spark, seed):
    rows = list(dict(random_texts(seed)).items())
    got = minhash.near_duplicates(table(spark, rows))
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()} == near_model(rows)


def test_near_odd_rows(spark):
    docs = odd_table(spark)
    got = minhash.near_duplicates(docs).collect()
    rows = [(i, t) for i, t in pairs(docs) if i is not None]
    assert len(got) == len(rows) and {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == near_model(rows)
    assert minhash.near_duplicates(table(spark, [])).count() == 0
    left = minhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns and {i for i, _ in pairs(left)} == {r.doc_id for r in got if r.kept} | {None}


def family(seed, pairs=150, size=240, changes=5):
    """Linked pairs of copies of one text; the copies of different pairs are mostly below the threshold."""
    rnd = random.Random(seed)
    base = [f"b{k}" for k in range(size)]
    out = []
    for k in range(pairs):
        own = list(base)
        for c in range(2):
            for at in rnd.sample(range(size), changes):
                own[at] = f"m{k}.{c}.{at}"
            out.append((2 * k + c, " ".join(own)))
    return out


def test_near_pairs_within_a_family(spark, monkeypatch):
    rows = family(4)
    want = near_model(rows)
    assert 50 < sum(kept for *_, kept in want) < 200
    got = minhash.near_duplicates(table(spark, rows))
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()} == want
    monkeypatch.setattr(minhash, "BLOCK", 16)
    got = minhash.near_duplicates(table(spark, rows))
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()} == want


# passages


def passages_model(rows, width=20):
    first, texts = {}, {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = words(t)
        texts[i, t] = w
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), (i, k))
    out = Counter()
    for i, t in rows:
        w = texts[i, t]
        gone = set()
        for k in range(len(w) - width + 1):
            at = first[tuple(w[k : k + width])]
            if at != (i, k):
                gone.update(range(k, k + width))
        out[i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("seed", [8, 9, 10])
def test_passages(spark, seed):
    rows = list(dict(random_texts(seed)).items())
    got = substrings.without_repeats(table(spark, rows), with_text=True)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == passages_model(rows)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got.collect())


def test_passages_come_from_equal_names(monkeypatch):
    """Rounds that name symbols differently from text to text lose anchors that a passage shares, and so its repeats."""
    passage = " ".join(f"p{k}" for k in range(200))
    ((_, words),) = substrings.slices(pa.array([passage + " a b c", "x y " + passage]))
    right = substrings.recompress

    def salted(*symbols):
        name, lo, hi, own = right(*symbols)
        return substrings.mix(name ^ own.astype(np.uint64)), lo, hi, own

    def shared():
        name, own, a, b = substrings.anchors(words)
        both = set(name[own == 0].tolist()) & set(name[own == 1].tolist())
        return sum(int(z - y) + 1 for n, o, y, z in zip(name.tolist(), own.tolist(), a.tolist(), b.tolist(), strict=True) if o == 1 and n in both)

    assert shared() == 200 - 19  # all windows of the passage
    monkeypatch.setattr(substrings, "recompress", salted)
    assert shared() < 20


def test_words_that_weak_hashes_confuse(spark):
    a, b = thue_morse(1024)
    c, d = thue_morse(4096)
    head, tail = " ".join(f"h{k}" for k in range(12)), " ".join(f"t{k}" for k in range(12))
    rows = [(k, f"{head} {w} {tail}") for k, w in enumerate((a, b, c, d, a))]
    got = substrings.without_repeats(table(spark, rows))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == passages_model(rows)
    rows += [(10, f"a {a}"), (11, f"a {b}"), (12, f"A {a}")]
    near = minhash.near_duplicates(table(spark, rows))
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near.collect()} == near_model(rows)


def test_near_repeated_ids_with_other_texts(spark):
    one, two = " ".join(f"w{k}" for k in range(40)), " ".join(f"v{k}" for k in range(40))
    rows = [(1, one), (50, one), (50, two), (60, two), (70, None), (70, one), (80, "")]
    got = minhash.near_duplicates(table(spark, rows)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    of = {}
    for r in got:
        assert of.setdefault(r.doc_id, r.component_id) == r.component_id and r.kept == (r.component_id == r.doc_id)
    assert of[1] == of[70] == 1 and of[80] == 80 and {of[50], of[60]} in ({1, 60}, {50})


def test_places_of_odd_frames(spark, tmp_path):
    """Rows have places of their own in frames that aren't plain scans, or that have columns named like those of places."""
    path = f"file://{tmp_path}/docs"
    table(spark, [(k, f"text {k % 3}") for k in range(9)]).write.parquet(path)
    docs = spark.read.parquet(path)
    twice = docs.crossJoin(spark.range(2).select("id")).drop("id")
    assert exact_dedup.drop_copies(twice).count() == 3 and exact_dedup.drop_copies(docs.withColumn("_metadata", F.lit(1))).columns[-1] == "_metadata"
    assert substrings.without_repeats(twice).count() == 18


def test_passages_by_shuffle_only(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)
    rows = list(dict(random_texts(12)).items())
    got = substrings.without_repeats(table(spark, rows))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == passages_model(rows)
    near = minhash.near_duplicates(table(spark, rows))
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near.collect()} == near_model(rows)


def test_passages_odd_rows(spark):
    docs = odd_table(spark)
    rows = [r for r in pairs(docs) if r[0] not in (None, 50)]
    got = substrings.without_repeats(docs).where("doc_id is not null and doc_id <> 50")
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == passages_model(rows)
    assert substrings.without_repeats(docs).count() == docs.count()
    assert substrings.without_repeats(table(spark, [])).count() == 0


def test_unions_keep_all_rows(spark):
    common.prepare(spark)
    a = spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count()
    b = spark.range(5000).selectExpr("id % 900 as k").groupBy("k").count()
    assert a.union(b).groupBy("k").agg(F.count("*")).count() == 900
