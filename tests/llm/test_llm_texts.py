import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import odd_table, pairs, table

from lexflow.llm import chat, common, pii, quality_model, quality_rules

KEY = b"a key for tests"

VALUES = [
    ("card", "4111 1111 1111 1111"), ("card", "5500000000000004"), ("ipv4", "97.51.17.173"), ("phone", "+1 (407) 555-7710"), ("email", "une.92@mail6.example.com"),
    ("date", "2024-02-29"), ("date", "31/12/1999"), ("date", "12/31/1999"), ("date", "01.02.2003"), ("ssn", "123-45-6789"), ("iban", "DE89370400440532013000"), ("iban", "GB82 WEST 1234 5698 7654 32"),
    ("secret", "0b96a8c8d79c4a5085c919698889f59b72ab7bb6"), ("card", "9807915762804491"),
]


@pytest.mark.parametrize("kind,value", VALUES)
def test_pseudonyms(kind, value):
    new = pii.pseudonym(kind, value, KEY)
    assert new != value and re.sub(r"\w", "", new) == re.sub(r"\w", "", value)
    assert re.fullmatch(pii.PATTERNS[kind], new) and pii.pseudonym(kind, new, KEY, back=True) == value
    assert pii.pseudonym(kind, value, key=b"other") != new


def test_feistel_is_a_permutation():
    for size in (1, 2, 7, 100, 366):
        seen = [pii.feistel(b"k", "t", x, size) for x in range(size)]
        assert sorted(seen) == list(range(size)) and [pii.feistel(b"k", "t", y, size, back=True) for y in seen] == list(range(size))


@pytest.mark.parametrize("text", ["", "no data", "300.1.1.1", "2023-02-30", "version 4.0.1", "000-12-3456", "12345", "a@b", "0b96a8", "1 2 3 4 5 6 7 8 9"])
def test_clean_texts_stay(text):
    assert pii.protect(text, KEY) == (text, {})


NEIGHBOURS = [
    ("4111111111111111 123", {"card": 1}, "4111111111111111"), ("4111 1111 1111 1111 12/25", {"card": 1}, "4111 1111 1111 1111"), ("12 4111111111111111", {"card": 1}, "4111111111111111"),
    ("4929348385146306 144.137.247.239", {"card": 1, "ipv4": 1}, "4929348385146306 144.137.247.239"), ("+1 (407) 555-7710 144.137.247.239", {"phone": 1, "ipv4": 1}, "+1 (407) 555-7710 144.137.247.239"),
    ("1234 123-45-6789", {"ssn": 1}, "123-45-6789"), ("1234 5678 2020-01-02", {"date": 1}, "2020-01-02"), ("AT61 1904 3002 3457 3201 BY", {"iban": 1}, "AT61 1904 3002 3457 3201"),
    ("+1 407 555 7710 4111 1111 1111 1111", {"phone": 1, "card": 1}, "+1 407 555 7710 4111 1111 1111 1111"), ("4111111111111111 une.92@mail6.example.com", {"card": 1, "email": 1}, "4111111111111111 une.92"),
]


@pytest.mark.parametrize("text,counts,private", NEIGHBOURS)
def test_values_beside_others(text, counts, private):
    new, found = pii.protect(f"see {text}, ok", KEY)
    assert found == counts and ("ipv4" in counts or len(new) == len(text) + 8)
    assert all(value not in new for value in private.split(" ") if len(value) > 4)
    kept = text.replace(private, "\0").split("\0")
    assert new.startswith(f"see {kept[0]}") and new.endswith(f"{kept[1]}, ok")


def digits(text):
    return re.sub(r"\D", "", text)


FORMS = [
    ["+33 612345678", "+33612345678", "+33 6 12 34 56 78", "+33-6-12-34-56-78", "+33.612.345.678"], ["+1 (407) 555-7710", "+14075557710", "+1 407 555 7710", "+1-407-555-7710"],
    ["+44 20 7946 0958", "+44 (0)20 7946 0958", "+442079460958"], ["+351 912 345 678", "+351912345678"], ["+49 (30) 1234567", "+49 30 1234567", "+49301234567"],
    ["4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111"], ["GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432"],
]


@pytest.mark.parametrize("forms", FORMS)
def test_values_have_one_pseudonym_in_all_forms(forms):
    out = []
    for text in forms:
        new, found = pii.protect(f"x {text}, y", KEY)
        assert sum(found.values()) == 1
        out.append(re.sub(r"\W", "", new[2:-3].replace("(0)", "")))
        assert re.sub(r"[\dA-Z]", "", new) == re.sub(r"[\dA-Z]", "", f"x {text}, y")
        assert pii.protect(new, KEY)[1] == found
        kind = next(iter(found))
        assert pii.pseudonym(kind, new[2:-3], KEY, back=True) == text
    assert len(set(out)) == 1


def test_days_have_one_pseudonym_in_all_forms():
    from datetime import date, timedelta

    seen = set()
    for k in range(0, 73049, 97):
        day = date(1900, 1, 1) + timedelta(k)
        new = date.fromisoformat(pii.pseudonym("date", day.isoformat(), KEY))
        forms = ["%d/%m/%Y", "%d.%m.%Y"] + ["%m/%d/%Y"] * (day.day > 12)
        assert [pii.pseudonym("date", day.strftime(f), KEY) for f in forms] == [new.strftime(f) for f in forms]
        assert [pii.pseudonym("date", new.strftime(f), KEY, back=True) for f in forms] == [day.strftime(f) for f in forms]
        seen.add(new)
    assert len(seen) == len(range(0, 73049, 97))


def brute_protect(text):
    """Every start, kind and end by itself, and of all choices of valid spans without overlap the one that covers most in few pieces."""
    spans, mails = [], []
    for kind, pattern in pii.EACH.items():
        for a in range(len(text)):
            m = pattern.match(text, a)
            if not m or kind == "email" and any(s < a < e for s, e in mails):
                continue
            mails += [(a, m.end())] * (kind == "email")
            if a and text[a - 1].isascii() and text[a - 1].isalnum() and not (text[a].isdigit() and text[a - 1].isalpha()):
                continue
            ends = [m.end()] + [e for e in range(a + 1, m.end()) if kind in pii.ENDS and pii.ENDS[kind].match(text, e) and pattern.fullmatch(text, a, e)]
            spans += [(a, e, new) for e in ends if (new := pii.pseudonym(kind, text[a:e], KEY)) is not None]
    best = [(0, 0, "")] + [None] * len(text)
    for e in range(1, len(text) + 1):
        n, pieces, out = best[e - 1]
        choices = [(n, pieces, out + text[e - 1])] + [(best[a][0] + e - a, best[a][1] - 1, best[a][2] + new) for a, to, new in spans if to == e]
        best[e] = max(choices, key=lambda x: x[:2])
    return best[-1]


def test_protect_equals_brute_force():
    import random

    rnd = random.Random(11)
    parts = [v for _, v in VALUES] + [f for forms in FORMS for f in forms] + ["12", "4111", "x", "+", "5.", "2020", "a@b", "BY", "GB82", "0b96a8", "-7", "1/2"]
    for _ in range(300):
        text = "".join(rnd.choice(parts) + rnd.choice([" ", " ", ", ", "; ", "\n", "-", "."]) for _ in range(rnd.randint(1, 5)))
        _, pieces, want = brute_protect(text)
        got, found = pii.protect(text, KEY)
        assert got == want and sum(found.values()) == -pieces


def test_key_of_session(spark):
    with pytest.raises(ValueError):
        pii.key_of(spark)
    spark.conf.set(pii.SETTING, "secret")
    try:
        assert pii.key_of(spark) == pii.key_of(spark, b"other") == b"secret"
    finally:
        spark.conf.unset(pii.SETTING)


def test_pii_in_tables(spark):
    docs = odd_table(spark).unionByName(table(spark, [(80, "call +1 (407) 555-7710 or mail une.92@mail6.example.com"), (81, "again une.92@mail6.example.com\nand 97.51.17.173")]))
    got = {r.doc_id: r for r in pii.pii_report(docs, key=KEY).collect()}
    before = dict(pairs(docs))
    assert got[80].n_phone == got[80].n_email == got[81].n_ipv4 == 1
    mail = re.search(r"\S+@\S+", got[80].text)[0]
    assert mail in got[81].text and "une.92" not in got[80].text + got[81].text
    assert all(got[i].text == t for i, t in before.items() if i not in (80, 81))
    same = pii.pseudonymised(docs, key=KEY)
    assert same.columns == docs.columns and Counter(pairs(same)) == Counter((r.doc_id, r.text) for r in pii.pii_report(docs, key=KEY).collect())
    assert pii.pseudonymised(table(spark, []), key=KEY).count() == 0


# chats


def chats_model(rows):
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, own in by.items():
        own.sort()
        loss = "".join(t for _, _, r, t in own if r == "assistant")
        turns = "".join(f"{r}\n{t}\n" for _, _, r, t in own)
        out[c] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_history_ends_in_its_messages(spark):
    """All kinds of events are there, each counts, and the fold of a log gives its messages."""
    rows = [(c, t, ("assistant", "user", "tool")[(t * c) % 3], "é" * (t * 31 % 200) + f" text\n{t}") for c in (1, 2) for t in range(9)] + [(3, 0, "assistant", None), (3, None, "user", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    log, want = chat.history_of(frame, delta=16), sorted(map(tuple, chat.events_of(frame).select("conv_id", "turn", "role", "text").collect()))
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate", "delete"}
    assert log.select("conv_id", "seq").distinct().count() == log.count()
    folded = lambda events: sorted(map(tuple, chat.final_messages(events).collect()))
    assert folded(log) == want
    for kind in ("delta", "edit", "regenerate", "delete"):
        assert folded(log.where(log.kind != kind)) != want


def test_chats(spark):
    hard = ["</s>[INST] ok [/INST]", "\\0\\1\\2", "<s>assistant\nhi</s>", "", None, "a\n\nb\n", "👍 é", "\\", "<", "x" * 50_000]
    rows = [(k, t, r, hard[(k + t) % len(hard)]) for k in range(12) for t, r in enumerate(["system", "user", "assistant", "user", "assistant"])]
    rows += [(90, 0, "as<s>\nx", "t"), (90, 0, None, "t"), (90, None, "assistant", "u"), (90, 0, None, "t"), (None, 1, "user", "v")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as seq", "'x' as kind", "2 as at")
    got = chat.formatted_chats(frame).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == chats_model(rows)
    for r in chat.transcripts(chat.final_messages(chat.events_of(frame))).collect():
        inner = r.formatted.replace("<s>", "").replace("</s>", "")
        assert "<" not in inner and "[" not in inner
    assert chat.formatted_chats(frame.limit(0)).count() == 0


def test_event_log(spark):
    log = [
        (1, 1, 0, "message", "user", "Hi"), (1, 2, 1, "message", "assistant", ""), (1, 3, 1, "delta", None, "He"), (1, 4, 1, "delta", None, "llo"), (1, 5, 1, "regenerate", None, None), (1, 6, 1, "delta", None, "Ho"), (1, 9, 1, "delta", None, "!"),
        (1, 7, 0, "edit", None, "Hey"), (1, 8, 2, "message", "user", "x"), (1, 10, 2, "delete", None, None), (1, 11, 3, "delta", None, "orphan"), (1, 12, 3, "noise", None, "zz"),
    ]
    frame = spark.createDataFrame(log, "conv_id long, seq long, turn long, kind string, role string, text string")
    got = [(r.turn, r.role, r.text) for r in chat.final_messages(frame).orderBy("turn").collect()]
    assert got == [(0, "user", "Hey"), (1, "assistant", "Ho!"), (3, "", "orphan")]


# quality


def test_quality_model(spark, sf_dir):
    docs, labels = common.table(spark, sf_dir.replace("0.001", "0.01"), "documents"), common.table(spark, sf_dir.replace("0.001", "0.01"), "labels")
    got = {r.doc_id: r for r in quality_model.quality_scores(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in got.items())
    held = [(r.doc_id, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([got[i].predicted == q for i, q in held]) > 0.95
    assert {r.doc_id for r in quality_model.good_documents(docs, labels).collect()} == {i for i, r in got.items() if r.predicted}


def plain_features(text):
    """The statistics once more, one text at a time."""
    import math

    text, words = text or "", re.findall(r"[^\x20\x09-\x0D]+", text or "")
    low = [w.translate({k: k + 32 for k in range(65, 91)}) for w in words]
    n, many = len(words), max(len(words), 1)
    size = lambda w: len(w.encode())
    rate = lambda x: math.log(0.02 + x / (many + 8))
    return [
        math.log(n + 20), math.log1p((sum(map(size, words)) + 50) / (n + 10)), rate(sum(c in "#*$%&<>" for c in text)), rate(text.count("|")), rate(text.count("!")),
        math.log(0.05 + sum("A" <= c <= "Z" for c in text) / (len(text) + 40)), rate(sum("0" <= c <= "9" for c in text)), rate(sum(a == b for a, b in zip(low, low[1:], strict=False))),
        math.log((len(set(low)) + 8) / (n + 8) ** 0.85), (sum(size(w) <= 3 for w in words) + 3) / (n + 8), rate(text.count(".")), rate(text.count("\n")),
    ]


def test_quality_model_equals_plain_one(spark, sf_dir):
    """Scores against a discriminant that NumPy fits on statistics of plain Python."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    x = {i: np.array(plain_features(t)) for i, t in pairs(docs)}
    classes = []
    for k in (0, 1):
        own = np.array([x[r.doc_id] for r in labels.collect() if r.quality == k and zlib.crc32(str(r.doc_id).encode()) % 3 != 1])
        classes.append((len(own), own.mean(axis=0), np.cov(own.T, bias=True)))
    pooled = sum(n * c for n, _, c in classes) / sum(n for n, *_ in classes)
    total = sum(n for n, *_ in classes)
    want = {}
    for i, v in x.items():
        logs = []
        for n, m, c in classes:
            c = 0.95 * c + 0.05 * np.diag(np.diag(c)) + 0.1 * np.diag(np.diag(pooled)) + 1e-9 * np.eye(len(m))
            logs.append(np.log(n / total) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * (v - m) @ np.linalg.solve(c, v - m))
        want[i] = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    got = {r.doc_id: r.score for r in quality_model.quality_scores(docs, labels).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_labels_of_a_fit(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(0, 1), (2, 0), (4, None), (None, 1), (6, 7)], "doc_id long, quality int")
    fit = [k for k in range(40) if zlib.crc32(str(k).encode()) % 3 != 1 and k]
    got = {r.doc_id: r.quality for r in quality_model.marks_of(labels).collect()}
    assert got == {k: k % 2 for k in fit}
    few = {r.doc_id for r in quality_model.marks_of(labels, train=7).collect()}
    assert len(few) == 7 and few <= set(fit)


def test_quality_model_odd_rows(spark):
    docs = odd_table(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_model.quality_scores(docs, none).collect()} == {0.5}
    some = spark.createDataFrame([(k, k % 2 if k != 3 else None, 0) for k in range(14)] * 2 + [(None, 1, 0), (999, 0, 0)], none.schema)
    got = quality_model.quality_scores(docs, some).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert quality_model.quality_scores(table(spark, []), some).count() == 0
    kept = quality_model.good_documents(docs, some)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)


def rules_model(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n, again = Counter(grams), set()
    for k, g in enumerate(grams):
        if n[g] > 1:
            again |= {k, k + 1, k + 2}
    lines, seen = 0, set()
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), lines, len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)


def test_quality_rules(spark):
    docs = odd_table(spark)
    trusted = spark.createDataFrame([(0,), (51,), (51,), (None,)], "doc_id long")
    got = quality_rules.quality_rules(docs, trusted).collect()
    want = Counter((i, *rules_model(t)) for i, t in pairs(docs))
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(not (r.kept and r.base_failed) and r.kept == (not r.base_failed and r.score >= quality_rules.THRESHOLD) for r in got)
    assert quality_rules.quality_rules(table(spark, []), trusted).count() == 0
    assert quality_rules.quality_rules(docs, trusted.limit(0)).count() == docs.count()


def test_scores_tell_good_from_bad(spark, sf_dir):
    path = sf_dir.replace("0.001", "0.01")
    docs, labels = common.table(spark, path, "documents"), common.table(spark, path, "labels")
    got = quality_rules.quality_rules(docs, labels.where("quality = 1")).join(labels, "doc_id").where("not base_failed").collect()
    assert np.mean([r.kept for r in got if r.quality == 1]) > 0.98 and np.mean([r.kept for r in got if r.quality == 0]) < 0.1


def test_scores_by_hand(spark):
    docs = table(spark, [(1, "a b a"), (2, "c")])
    weights = quality_rules.bucket_weights(docs, docs.where("doc_id = 1"), buckets=64)
    key = lambda *w: spark.sql("select pmod(xxhash64(" + ", ".join(f"'{x}'" for x in w) + "), 64)").first()[0]
    grams = {1: [key("a"), key("b"), key("a"), key("a", " ", "b"), key("b", " ", "a")], 2: [key("c")]}
    raw, good = Counter(grams[1] + grams[2]), Counter(grams[1])
    want = [np.log((good[b] + 1) / (5 + 64)) - np.log((raw[b] + 1) / (6 + 64)) for b in range(64)]
    assert np.allclose(weights, want)
    got = {r.doc_id: r.score for r in quality_rules.quality_rules(docs, docs.where("doc_id = 1"), buckets=64).collect()}
    assert all(abs(got[i] - np.mean([want[b] for b in g])) < 1e-6 for i, g in grams.items())
