"""Ranks in groups, fill-in-the-middle and best-fit packing against plain versions, over odd and no rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from datetime import datetime
from itertools import combinations_with_replacement

import numpy as np
import public_tokenizers
import pytest
from helpers import TEXTS, odd_table, pairs

from lexflow.llm import best_fit, fill_middle, ranking

WORDS = public_tokenizers.path("word_bpe_49k.json")
LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz, pos long, part string, n0 int, at long, file string, `a b` int"


def some_lines(n, seed=3):
    rnd = random.Random(seed)
    pick = lambda *x: rnd.choice((*x, None))
    rows = []
    for _ in range(n):
        day = datetime(2024, rnd.randint(1, 3), rnd.randint(1, 28)) if rnd.random() < 0.9 else None
        rows.append((pick(1, 2, 7, 12, 5, -3, 2**62), pick(1, 2, 3), pick(0, 4, 9, -1), pick(1, 1, 1, 2), pick(1, 9, 10, 25, 50, -1), pick(0.5, 1.005, 99.99, -2.0), pick(0.0, 0.03, 0.1), "x", day, 7, "p", 1, 2, "f", 3))
    return rows + rows[: n // 3] + rows[:5] * 4


def plain_ranks(rows):
    groups = defaultdict(list)
    up = lambda v: (v is None, v or 0)
    for sale, line, item, vendor, quantity, amount, discount, _, day, *_ in rows:
        key = (vendor, -1 if item is None else item % 5, -1 if day is None else 100 * day.year + day.month)
        if sale is not None and zlib.crc32(str(sale).encode()) % 5 == 0:
            key = (-1, -1, -1)
        bucket = None if quantity is None else quantity // 10
        percent = None if discount is None else int(np.floor(100 * discount + 0.5))
        cents = None if amount is None else int(np.floor(100 * amount + 0.5))
        pair = (bucket is not None, -(bucket or 0), percent is not None, percent or 0)
        groups[key].append((pair, up(sale), up(line), up(quantity), up(cents), (sale, line, quantity, percent, cents)))
    out = []
    for key, found in groups.items():
        found.sort(key=lambda r: r[:5])
        ties, first = Counter(r[0] for r in found), {}
        for pos, r in enumerate(found, 1):
            first.setdefault(r[0], pos)
            out.append((*key, pos, first[r[0]], *r[5], ties[r[0]]))
    return out


@pytest.mark.parametrize("light", [1, 8, 100_000])
@pytest.mark.parametrize("most", [None, 2])
def test_ranked_lines(spark, light, most):
    rows = some_lines(400)
    got = ranking.ranked_lines(spark.createDataFrame(rows, LINES), most, light=light, size=16)
    want = [(*r[:4], r[3], *r[5:]) for r in plain_ranks(rows) if most is None or r[3] <= most]
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert {t for _, t in got.dtypes} == {"bigint"}


@pytest.mark.parametrize("place", ["min", "max"])
@pytest.mark.parametrize("most", [None, 4])
@pytest.mark.parametrize("light", [2, 1000])
def test_places_of_ties(spark, place, most, light):
    rows = [(g, v) for g in (1, 2, None) for v in (5, 5, 5, 3, 3, 9, None, None)] + [(3, None)]
    got = ranking.ranked(spark.createDataFrame(rows, "g long, v long"), ["g"], [("v", False, True)], 1, most=most, place=place, light=light)
    want = []
    for g in (1, 2, None, 3):
        own = sorted((v is not None, v or 0) for x, v in rows if x == g)
        for pos, v in enumerate(own, 1):
            at = own.index(v) + 1 if place == "min" else len(own) - own[::-1].index(v)
            if most is None or at <= most:
                want.append((g, v[1] if v[0] else None, pos, at, own.count(v)))
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_heavy_groups_beyond_the_broadcast(spark, monkeypatch):
    """Groups that are heavy and yet hold less than one of HOT rows are routed by a shuffle."""
    monkeypatch.setattr(ranking, "HOT", 3)
    rows = some_lines(300, 5)
    got = ranking.ranked_lines(spark.createDataFrame(rows, LINES), None, light=10, size=16)
    assert Counter(map(tuple, got.collect())) == Counter((*r[:4], r[3], *r[5:]) for r in plain_ranks(rows))


def test_copies_of_one_row_are_dealt_out(spark):
    """A group of equal rows alone is spread over the partitions of the sort."""
    got = ranking.ranked_lines(spark.createDataFrame(some_lines(1)[:1] * 2000, LINES), None, light=100)
    rows = got.collect()
    assert sorted(r.pos for r in rows) == list(range(1, 2001)) and {r.tied for r in rows} == {2000}


def test_ranks_of_no_rows(spark):
    assert ranking.ranked_lines(spark.createDataFrame([], LINES)).collect() == []
    with pytest.raises(ValueError, match="place"):
        ranking.ranked(spark.createDataFrame([], LINES), ["part"], [("pos", True, True)], 1, place="dense")


def plain_middle(text, doc_id, plain=10, suffix_first=20):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < suffix_first:
        return n, "spm", a, b - a, "<S>" + suffix + "<P>" + prefix + "<M>" + middle
    return n, "psm", a, b - a, "<P>" + prefix + "<S>" + suffix + "<M>" + middle


def middles(frame):
    out = frame.select("doc_id", "text", "fim.*", fill_middle.restored(frame["fim.output"], frame["fim.form"]).alias("back")).collect()
    return [(r.doc_id, r.text, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output), r.output_sha256, r.back) for r in out]


def test_fill_middle(spark):
    from helpers import table

    more = [(100 + k, t) for k, t in enumerate(["<P>", "a<S>b", "<M", "<<S", "S>", "<P" * 9, "é\n\r\n$1 \\ $", "👩‍👩‍👧" * 40, "<S" + "P><M" * 3] * 12)]
    rows = middles(fill_middle.fill_middle(odd_table(spark).unionByName(table(spark, more))))
    assert len(rows) == len(TEXTS) + 5 + len(more)
    for doc_id, text, got, digest, back in rows:
        assert got == plain_middle(text, doc_id)
        assert digest == hashlib.sha256(got[-1].encode()).hexdigest() and back == (text or "")
    assert {r[2][1] for r in rows} == {"plain", "psm", "spm"}


def test_fill_middle_of_a_very_long_text(spark):
    text = "é<b\n" * 750_000
    (row,) = middles(fill_middle.fill_middle(spark.createDataFrame([(3, text)], "doc_id long, text string"), plain=0))
    assert row[2][:2] != ("plain",) and row[2] == plain_middle(text, 3, plain=0) and row[4] == text


def test_fill_middle_by_other_units(spark):
    import regex

    docs = spark.createDataFrame([(k, "éa👩‍👩‍👧 b\r\nc" * 5) for k in range(30)], "doc_id long, text string")
    for _, text, (n, form, a, b, output), _, back in middles(fill_middle.fill_middle(docs, unit=r"\X", plain=0)):
        ends = [0, *(m.end() for m in regex.finditer(r"\X", text))]
        assert n == len(ends) - 1 and a in ends and a + b in ends and back == text and form != "plain" and len(output) == len(text) + 9


def test_fill_middle_columns(spark):
    docs = spark.createDataFrame([(1, "ab", 5, 6, 7)], "doc_id long, text string, fim long, form int, output int")
    out = fill_middle.fill_middle(docs)
    assert out.columns == [*docs.columns, "fim_"] and out.select("fim", "fim_.n").first() == (5, 2)
    assert fill_middle.fill_middle(docs.limit(0)).collect() == []
    with pytest.raises(ValueError, match="marks"):
        fill_middle.fill_middle(docs, marks=("<", "<P>", "<M>"))


def checked_pieces(rows, docs, size, end):
    """rows (with ids) are whole pieces of docs and lie gapless in sequences; how many sequences there are."""
    from tokenizers import Tokenizer

    library, want = Tokenizer.from_file(WORDS), Counter()
    for doc_id, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end]
        for k, start in enumerate(range(0, len(ids), size)):
            raw = np.array(ids[start : start + size], "<u4").tobytes()
            want[doc_id, k, start, len(raw) // 4, zlib.crc32(raw)] += 1
            assert not rows or any(r.ids == raw for r in rows if r.doc_id == doc_id)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    own = defaultdict(list)
    for r in rows:
        own[r.sequence_id].append((r.offset, r.length))
    for found in own.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= size
    return len(own)


@pytest.mark.parametrize("counts", [200_000, 0])
@pytest.mark.parametrize("size", [4096, 16])
def test_best_fitted(spark, monkeypatch, size, counts):
    monkeypatch.setattr(best_fit, "COUNTS", counts)
    docs = odd_table(spark).repartition(3, "doc_id")
    pieces = best_fit.best_fitted(docs, WORDS, size=size, ids_too=True)
    rows = pieces.collect()
    n = checked_pieces(rows, pairs(docs), size, 1)
    assert n <= -(-sum(r.length for r in rows) // size) + 1
    whole = {r.sequence_id: r.ids for r in best_fit.sequences(pieces).collect()}
    assert len(whole) == n and all(whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == r.ids for r in rows)


def test_best_fitted_empty(spark):
    assert best_fit.best_fitted(odd_table(spark).limit(0), WORDS).collect() == []


def test_best_fitted_documents(spark, sf_dir):
    """On the test documents no more sequences than plain best fit, and close to what their ids need."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = best_fit.best_fitted(docs, WORDS).collect()
    counts = np.bincount([r.length for r in rows], minlength=4097)
    n = len({r.sequence_id for r in rows})
    assert n <= sum(k for _, k in best_fit.best_fit(counts, 4096)) and n <= 1.02 * sum(r.length for r in rows) / 4096 + 1


@pytest.mark.parametrize("seed", range(12))
def test_plan(seed):
    """Every piece is placed once, no sequence is too long, and exact combinations are found where there are any."""
    rnd = random.Random(seed)
    size = rnd.choice([7, 30, 64])
    pieces = [rnd.randint(1, rnd.choice([3, size])) for _ in range(rnd.randint(0, 300))]
    counts = np.bincount(pieces, minlength=size + 1)
    got = best_fit.patterns(counts, size)
    total = Counter()
    for pattern, times in got:
        assert times > 0 and sum(length * k for length, k in pattern.items()) <= size
        for length, k in pattern.items():
            total[length] += k * times
    assert total == Counter(pieces)
    placed = set()
    for length, start, times, sequence, offset in best_fit.plan(counts, size).tolist():
        own = [x for x in best_fit.plan(counts, size).tolist() if x[0] == length and x[1] > start]
        stop = min((x[1] for x in own), default=counts[length])
        for nth in range(start, stop):
            turn, place = divmod(nth - start, times)
            cells = {(sequence + place, offset + turn * length + k) for k in range(length)}
            assert not placed & cells
            placed |= cells
    assert len(placed) == sum(pieces)


def test_complements_find_what_there_is():
    """One, two or three lengths for a gap, whenever a search through all finds some, also with indexes that are out of date."""
    rnd = random.Random(8)
    for _ in range(40):
        size = 40
        counts = np.array([0] + [rnd.choice([0, 0, 1, 2]) for _ in range(size)])
        index = best_fit.Complements(counts)
        for length in rnd.sample(range(1, size + 1), 10):  # used up since
            index.left[length] = 0
        have = [length for length in range(1, size + 1) if index.left[length]]
        for gap in range(1, size + 1):
            some = [c for k in (1, 2, 3) for c in combinations_with_replacement(have, k) if sum(c) == gap and all(index.left[x] >= m for x, m in Counter(c).items())]
            found = index.exact(gap, Counter())
            assert (found is None) == (not some)
            if found:
                assert tuple(sorted(found)) in some


def test_few_pieces_need_no_more_than_the_best():
    """Against a search through all ways to pack, on pieces that exact combinations fit."""

    def least(pieces, size):
        best = len(pieces)

        def go(k, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if k == len(pieces):
                best = len(bins)
                return
            for i in {bins.index(b) for b in bins if b >= pieces[k]}:
                go(k + 1, sorted([*bins[:i], bins[i] - pieces[k], *bins[i + 1 :]]))
            go(k + 1, sorted([*bins, size - pieces[k]]))

        go(0, [])
        return best

    rnd, more = random.Random(2), 0
    for _ in range(60):
        size = 20
        pieces = sorted((rnd.randint(1, size) for _ in range(9)), reverse=True)
        n = sum(k for _, k in best_fit.patterns(np.bincount(pieces, minlength=size + 1), size))
        more += n - least(pieces, size)
    assert more <= 2
