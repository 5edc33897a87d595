import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import odd_table, pairs, table, thue_morse

from lexflow.llm import arrow_text, encoders, packing, piece_lattice, token_store

BYTES, WORDS, PIECES = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def library(path, texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_equals_library(path):
    import random

    rnd = random.Random(4)
    letters = list("ab AB'\n\t  é́ΣςİıI12$#.,\x1c\x85\x01²ªß") + ["'s", " <|endoftext|>", "日", "👍", "  "]
    texts = ["".join(rnd.choices(letters, k=rnd.randint(0, 40))) for _ in range(4000)] + [None, ""]
    assert [x.tolist() for x in encoders.Encoder(path)(pa.array(texts))] == library(path, texts)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_tells_words_apart(path):
    e = encoders.Encoder(path)
    for text in [" ".join(thue_morse(n)) for n in (1024, 4096)] + ["abcdefgh" * 2, "abcdefgh" * 2 + "\0", "abcdefghijklmno", "abcdefghijklmnop"]:
        assert [x.tolist() for x in e(pa.array([text]))] == library(path, [text])


def test_units_with_one_hash(monkeypatch):
    """Units that differ are told apart even where all hashes are equal."""
    monkeypatch.setattr(encoders, "mix", lambda x: np.zeros_like(x))
    monkeypatch.setattr(arrow_text, "mix", lambda x: np.zeros_like(x))
    texts = ["one two three two", "four one " + "long" * 9 + " " + "long" * 10]
    e = encoders.Encoder(BYTES)
    assert [x.tolist() for t in texts for x in e(pa.array([t]))] == library(BYTES, texts)


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(encoders, "KEEP", 5)
    texts = [f"word{k} other{k % 3}" for k in range(50)]
    e = encoders.Encoder(BYTES)
    assert [x.tolist() for t in texts for x in e(pa.array([t]))] == library(BYTES, texts)


def test_encoder_keeps_frequent_units(monkeypatch):
    texts = [f"word{k} other{k % 3} again" for k in range(30)]
    e = encoders.Encoder(BYTES)
    for _ in range(3):
        assert [x.tolist() for t in texts for x in e(pa.array([t]))] == library(BYTES, texts)
        known = len(e.keys)
        e.rest()
        assert 0 < len(e.keys) < known and e.used == e.sizes.sum()
    monkeypatch.setattr(encoders, "FREQUENT", 1)
    next(iter(e(pa.array([" ".join(texts)]))))
    e.rest()
    assert len(e.keys) == 0
    assert [x.tolist() for x in e(pa.array(texts))] == library(BYTES, texts)


def test_token_store(spark):
    docs = odd_table(spark)
    rows = sorted(pairs(docs), key=lambda r: (r[0] is not None, r[0] or 0))
    got = token_store.token_store(docs, BYTES, shards=3).collect()
    assert len(got) == len(rows)
    want, start = {}, 0
    for (i, _), ids in zip(rows, library(BYTES, [t for _, t in rows]), strict=True):
        a = np.array([*ids, 2], "<u4")
        want.setdefault(i, []).append((start, len(a), zlib.crc32(a.tobytes())))
        start += len(a)
    plain = {i: v for i, v in want.items() if len(v) == 1}
    assert {r.doc_id: [(r.start, r.n_tokens, r.ids_crc32)] for r in got if r.doc_id in plain} == plain
    for i in (None, 50):  # repeated keys, in any order
        assert sorted((r.n_tokens, r.ids_crc32) for r in got if r.doc_id == i) == sorted((n, c) for _, n, c in want[i])
    ends = sorted((r.start, r.n_tokens) for r in got)
    assert [a + n for a, n in ends[:-1]] == [a for a, _ in ends[1:]] and ends[0][0] == 0
    assert token_store.token_store(table(spark, []), BYTES).count() == 0


def test_shard_access(spark, tmp_path):
    docs = table(spark, [(k * 3, f"text number {k}") for k in range(200)])
    catalog = token_store.write_shards(docs, BYTES, shards=2)
    uris = [r.uri for r in catalog.select("uri").distinct().collect()]
    assert len(uris) == 2
    readers = [token_store.ShardReader(u) for u in uris]
    for k in range(200):
        found = [x for x in (r.get(k * 3) for r in readers) if x is not None]
        assert len(found) == 1 and found[0].tolist() == [*library(BYTES, [f"text number {k}"])[0], 2]
    assert all(r.get(k) is None for r in readers for k in (1, 2, 700, -5))


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    slots = token_store.PerfectHash.build(keys).slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    assert token_store.PerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [-1] * 3


def check_pack(rows, documents, longest=4096):
    """Each id in one piece, sequences gapless and a power of two."""
    parts, ends = {}, {}
    for doc, start, length, crc, total, sequence, offset, *_ in rows:
        ids = documents[doc]
        assert total == len(ids) and crc == zlib.crc32(ids[start : start + length].tobytes())
        parts.setdefault(doc, []).append((start, length))
        ends.setdefault(sequence, []).append((offset, length))
    assert set(parts) == set(documents)
    for doc, own in parts.items():
        at = 0
        for start, length in sorted(own):
            assert start == at and length > 0
            at += length
        assert at == len(documents[doc])
    for own in ends.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= longest and at & (at - 1) == 0


@pytest.mark.parametrize("seed", range(4))
def test_pack(seed):
    rnd = np.random.default_rng(seed)
    documents = {k: rnd.integers(0, 50_000, int(n)).astype("<u4") for k, n in enumerate(np.concatenate([rnd.integers(1, 700, 300), rnd.integers(1, 30_000, 20), [1, 4096, 4097, 8192]]))}
    rows = list(packing.pack(((k, v.tobytes()) for k, v in documents.items()), block=1 << 15))
    check_pack(rows, documents)
    load = {}
    for r in rows:
        load[r[8]] = load.get(r[8], 0) + r[2]
    assert min(sorted(load.values())[1:]) > 0


def test_packed(spark):
    docs = odd_table(spark).where("doc_id is not null and doc_id <> 50")
    rows = pairs(docs)
    documents = {i: np.array([*ids, 2], "<u4") for (i, _), ids in zip(rows, library(WORDS, [t for _, t in rows]), strict=True)}
    got = [tuple(r) for r in packing.packed(docs, WORDS).collect()]
    check_pack(got, documents)
    whole = packing.packed(odd_table(spark), WORDS)
    assert whole.where("start = 0").count() == odd_table(spark).count()
    assert packing.packed(table(spark, []), WORDS).count() == 0


@pytest.mark.parametrize("block", [piece_lattice.BLOCK, 100])
def test_pieces_equal_library(spark, block):
    import sentencepiece

    docs, model = odd_table(spark), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = piece_lattice.encoded(docs, PIECES, block=block, with_ids=True).collect()
    want = sorted((str(i), model.encode(t or "")) for i, t in pairs(docs))
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == want
    for r in got:
        assert r.n_pieces == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert r.decoded_sha256 == hashlib.sha256(model.decode(list(r.ids)).encode()).hexdigest()
    assert piece_lattice.encoded(table(spark, []), PIECES).count() == 0


def test_pieces_of_like_words(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [(k, " ".join(thue_morse(n))) for k, n in enumerate((32, 1024, 4096))] + [(9, "été d'Été naïve Ünï ñandú l’œuvre x²y 1234,56 a\u00a0b ÿþ")]
    got = {r.doc_id: list(r.ids) for r in piece_lattice.encoded(table(spark, rows), PIECES, with_ids=True).collect()}
    assert got == {i: model.encode(t) for i, t in rows}


def test_units_cross_no_piece():
    import random

    import sentencepiece

    with open(PIECES, "rb") as f:
        model = piece_lattice.Model.read(f.read())
    own, rnd = sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(3)
    letters = list("abeinrst AEST  019.,;-'\"#\n\té\u00a0ñß\u0100ж日👍▁$") + ["the", " of", "tion"]
    cuts, ranks = model.cuts(), {p: (r, i) for p, r, i, _ in model.ranked()}
    for _ in range(400):
        text = "".join(rnd.choices(letters, k=rnd.randint(1, 60)))
        (_, data, bounds) = next(piece_lattice.buffers(piece_lattice._spaced(pa.array([text]), model.prefix)))
        at = [*piece_lattice._unit_starts(data, bounds, cuts).tolist(), len(data)]
        units = [data.tobytes()[a:b].decode().replace(" ", piece_lattice.SPACE) for a, b in zip(at[:-1], at[1:], strict=True)]
        assert [i for u in units for i in model.merge(u, ranks)] == own.encode(text)


def test_viterbi(spark):
    """A unigram model made by hand, against all segmentations."""
    pieces = {"▁": -3.0, "▁a": -2.0, "a": -2.5, "b": -2.6, "ab": -3.5, "ba": -3.1, "aba": -6.0, "▁ab": -4.9, "bb": -5.5}
    names = ["<unk>", *pieces]
    model = piece_lattice.Model("unigram", names, [0.0, *pieces.values()], [piece_lattice.UNKNOWN] + [piece_lattice.NORMAL] * len(pieces), True)
    low = min(pieces.values()) - 10

    def best(u):
        if not u:
            return 0.0, []
        options = []
        for k in range(1, len(u) + 1):
            if u[:k] in pieces or (k == 1):
                score, rest = best(u[k:])
                options.append((pieces.get(u[:k], low) + score, [names.index(u[:k]) if u[:k] in pieces else -ord(u[0]), *rest]))
        return max(options)

    units = ["▁abab", "▁", "▁bbaab", "▁acb", "ba"]
    frame = spark.createDataFrame([(u,) for u in units], "unit string")
    got = {r.unit: r.ids for r in piece_lattice.dictionary(frame, model).collect()}
    for u in units:
        ids = got[u]
        score = sum(pieces[names[i]] if i > 0 else low for i in ids)
        assert abs(score - best(u)[0]) < 1e-9
        assert [i if i > 0 else 0 for i in ids] == model.best_path(u)
