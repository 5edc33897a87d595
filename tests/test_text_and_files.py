"""Accents, highlighting, word differences, and files that a build reads and writes."""

import json
import random
import tracemalloc
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexflow import session
from lexflow.functions import text as T
from lexflow.operators import diff, search
from lexflow.sources import sinks


def one(spark, value):
    return spark.range(1).select(value.alias("x")).first().x


def test_accents_of_all_scripts(spark):
    letters = "".join(c for c in map(chr, range(0xC0, 0x2000)) if unicodedata.category(c)[0] == "L")
    without = lambda s: "".join(c for c in unicodedata.normalize("NFD", s) if not "\u0300" <= c <= "\u036f")
    assert without(one(spark, T.strip_accents(F.lit(letters)))) == without(letters)
    for text in ("Český Şehir őr", "Ação ÚNICA", "Ελλάδα Ώρα", "Ёлка й", "a\u0301\u0323b"):
        assert one(spark, T.search_key(F.lit(text))) == T.plain(text) == without(text.lower())


def test_texts_are_found_by_their_own_letters(spark):
    rows = spark.createDataFrame([("Český Şehir őr",), ("Tiếng Việt",), ("Ελλάδα",)], "text string")
    for query, n in (("Český", 1), ("Şehir", 1), ("őr", 1), ("cesky sehir or", 1), ("viet", 1), ("ΕΛΛΑΔΑ", 1), ("x", 0)):
        assert search.search_texts(rows, query).count() == n


@pytest.mark.parametrize(
    "text,phrases,words,want",
    [
        ("a & b amp", [], ["amp"], "a &amp; b <mark>amp</mark>"),
        ("x < lt > y", [], ["lt", "gt"], "x &lt; <mark>lt</mark> &gt; y"),
        ("R&D and R&amp;D", [], ["R&D", "amp"], "<mark>R&amp;D</mark> and R&amp;<mark>amp</mark>;D"),
        ("um  dois", ["um dois"], ["dois"], "<mark>um  dois</mark>"),
        ("Ação\ufdd0", [], ["acao"], "<mark>Ação</mark>"),
        ("<b>", [], [], "&lt;b&gt;"),
    ],
)
def test_highlight_of_escaped_texts(spark, text, phrases, words, want):
    assert one(spark, T.highlight(F.lit(text), phrases, words)) == want


def table_diff(old, new):
    """The whole table of common lengths, and the way back through it."""
    a, b = old.split(), new.split()
    c = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            c[i + 1][j + 1] = c[i][j] + 1 if x == y else max(c[i][j + 1], c[i + 1][j])
    out, i, j = [], len(a), len(b)
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append(("eq", a[i]))
        elif j and (not i or c[i][j - 1] >= c[i - 1][j]):
            j -= 1
            out.append(("ins", b[j]))
        else:
            i -= 1
            out.append(("del", a[i]))
    return out[::-1]


def test_word_diff_equals_table():
    rnd = random.Random(7)
    for _ in range(1500):
        letters = "abcdefgh"[: rnd.choice([1, 2, 3, 8])]
        old, new = (" ".join(rnd.choice(letters) for _ in range(rnd.randint(0, 25))) for _ in range(2))
        assert diff.word_diff(old, new) == table_diff(old, new)
    assert diff.word_diff(None, "a") == [("ins", "a")] and diff.word_diff("a", None) == [("del", "a")]


def test_word_diff_takes_little_memory():
    rnd = random.Random(8)
    old, new = (" ".join(str(rnd.randrange(300)) for _ in range(4000)) for _ in range(2))
    tracemalloc.start()
    parts = diff.word_diff(old, new)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 12 << 20 and [w for o, w in parts if o != "ins"] == old.split() and [w for o, w in parts if o != "del"] == new.split()


def test_edited_tables(spark, tmp_path):
    path, schema = f"{tmp_path}/markers", "uid string, position int"
    assert sinks.load_table(spark, path, schema).collect() == []
    for rows in ([("a", 1)], [("a", 1), ("b", 2)]):
        sinks.save_table(spark.createDataFrame(rows, schema), path)
        assert sorted(map(tuple, sinks.load_table(spark, path, schema).collect())) == rows
    sinks.save_table(sinks.load_table(spark, path, schema).where("uid = 'b'"), path)
    assert [tuple(r) for r in sinks.load_table(spark, path, schema).collect()] == [("b", 2)]


def test_files_of_the_driver(spark, tmp_path):
    for path in (f"{tmp_path}/a/x.txt", f"file://{tmp_path}/b/x.txt"):
        sinks.write_text(path, "á\nb", spark)
        assert sinks.read_text(spark, path) == "á\nb"
    sinks.write_dumps(f"{tmp_path}/dumps", {"one": '{"a":[1]}'})
    assert json.loads((tmp_path / "dumps" / "one.json").read_text()) == {"a": [1]}


def test_shared_folder(spark):
    path = session.shared_path(spark, "thing")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir")) and spark.sparkContext.applicationId in path
    kept = session.stored(spark.range(5), "five")
    assert kept.count() == 5
