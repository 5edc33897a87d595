import random

import pytest
from pyspark.sql import functions as F

from lexflow.operators import classify, diff, export, markdown, outline, render, search, structure, targets, versions
from lexflow.plans import statute
from lexflow.schemas import FOOTNOTE_DEFS, LAWS, PARAGRAPHS
from model import build as model

PLAIN = (False, False, False, None, None)


def paragraphs(spark, rows, doc_id=1):
    """rows: text, or (text, {centered, struck, indent, notes})."""
    out = []
    for seq, row in enumerate(rows):
        text, own = row if isinstance(row, tuple) else (row, {})
        out.append((doc_id, seq, text, [(text, False, False, own.get("struck", False), None, None)], own.get("centered", False), own.get("struck", False), own.get("indent", 0), "", own.get("notes", [])))
    return spark.createDataFrame(out, PARAGRAPHS)


CASES = [
    ("Art. 43º - O Presidente", {}, "ARTIGO", "Art. 43º", "43"),
    ("Art. 183º-A - x", {}, "ARTIGO", "Art. 183º-A", "183-A"),
    ("Art. 4ºA - x", {}, "ARTIGO", "Art. 4ºA", "4-A"),
    ("Art. 4º-C. Texto", {}, "ARTIGO", "Art. 4º-C", "4-C"),
    ("Art. 4º-I - x", {}, "ARTIGO", "Art. 4º", "4"),
    ("Art. 10º - Texto", {"centered": True}, "SUBTITLE", "Art. 10º - Texto", ""),
    ("TITULO II", {"centered": True}, "TITULO", "TITULO II", ""),
    ("título ii", {"centered": True}, "TITULO", "título ii", ""),
    ("CAPÍTULO I", {"centered": True}, "CAPITULO", "CAPÍTULO I", ""),
    ("SEÇÃO I", {"centered": True}, "SECAO", "SEÇÃO I", ""),
    ("SUBSEÇÃO I", {"centered": True}, "SUBSECAO", "SUBSEÇÃO I", ""),
    ("TÍTULO I", {}, "OTHER", "", ""),
    ("Paragrafo unico - Texto", {}, "PARAGRAFO_UNICO", "Parágrafo único", ""),
    ("§ 10. - Texto", {}, "PARAGRAFO_NUM", "§ 10º", ""),
    ("§ 1.º - Texto", {}, "PARAGRAFO_NUM", "§ 1º", ""),
    ("§ 2° - Texto", {}, "PARAGRAFO_NUM", "§ 2º", ""),
    ("lV - Texto", {}, "INCISO", "IV", ""),
    ("XI – Texto", {}, "INCISO", "XI", ""),
    ("a) Texto", {}, "ALINEA", "a)", ""),
    ("1) Texto", {"indent": 700}, "SUB_ALINEA", "1)", ""),
    ("1) Texto", {}, "ITEM_NUM", "1)", ""),
    ("3 - Texto numerado", {}, "ITEM_NUM", "3", ""),
    ("Art.\xa05º - x", {}, "ARTIGO", "Art. 5º", "5"),
    ("\xa0", {}, "EMPTY", "", ""),
    ("   ", {"centered": True}, "EMPTY", "", ""),
    ("", {}, "EMPTY", "", ""),
]


def test_classification(spark):
    got = classify.classify(paragraphs(spark, [(t, o) for t, o, *_ in CASES])).orderBy("seq").collect()
    assert [(r.unit_type, r.identifier, r.art_number) for r in got] == [c[2:] for c in CASES]


NOTES = [
    ("x (Redação dada pela Res. 1)", "(Redação dada pela Res. 1)"),
    ("x (Incluida pela Res. 1 (de 2 (dois))) y", "(Incluida pela Res. 1 (de 2 (dois)))"),
    ("x (revogado", "(revogado"),
    ("x (outro)", ""),
    ("(a) x (Renumerado (b", "(Renumerado (b"),
    ("", ""),
]


def test_amendment_notes(spark):
    got = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(NOTES)], "k int, text string").select("k", classify.amendment_note(F.col("text")).alias("n")).orderBy("k").collect()
    assert [r.n for r in got] == [n for _, n in NOTES]


POOL = [
    ("TÍTULO I", {"centered": True}), ("CAPÍTULO I", {"centered": True}), ("CAPÍTULO II\nDOS FATOS", {"centered": True}), ("SEÇÃO I", {"centered": True}), ("SUBSEÇÃO I", {"centered": True}),
    ("DA CÂMARA", {"centered": True}), ("DA CÂMARA", {"centered": True}), ("NORMA: Lei A", {"centered": True}), ("NORMA: Lei B", {"centered": True}), ("ATO DAS DISPOSIÇÕES TRANSITÓRIAS", {"centered": True}),
    *[(f"Art. {n} - x", {}) for n in ("1º", "1º", "2º", "2º-A")], ("Art. 1º - old", {"struck": True}), ("Art. 2º - s", {"notes": [5]}), ("Art. 3º - p", {"notes": [1, 2]}),
    ("§ 1º - x", {}), ("§ 1º - y", {"notes": [1]}), ("Parágrafo único - x", {"notes": [2]}), ("I - x", {}), ("I - x", {"struck": True}), ("II - x", {"notes": [2, 9]}), ("a) x", {}), ("b) x", {}), ("1) x", {"indent": 700}), ("1) x", {}), ("2 - x", {}), ("texto", {}), ("", {}),
]
DEFS = {1: ("public", ""), 2: ("private", ""), 5: ("summary", "resumo"), 6: ("summary", "outro")}


@pytest.fixture(scope="module")
def streams():
    rnd = random.Random(7)
    return {k: [rnd.choice(POOL) for _ in range(rnd.randint(0, 45))] for k in range(120)}


@pytest.mark.parametrize("segment", [None, 7])
def test_structure_equals_a_sequential_reading(spark, streams, segment):
    rows = None
    for k, s in streams.items():
        part = [(k, i, t, [(t, False, False, o.get("struck", False), None, None)], o.get("centered", False), o.get("struck", False), o.get("indent", 0), "", o.get("notes", [])) for i, (t, o) in enumerate(s)]
        rows = part if rows is None else rows + part
    frame = spark.createDataFrame(rows, PARAGRAPHS)
    defs = spark.createDataFrame([(k, kind, s, []) for k, (kind, s) in DEFS.items()], FOOTNOTE_DEFS)
    built = statute.build(frame, defs, segment=segment)
    kinds = {(r.doc_id, r.seq): r for r in classify.classify(frame).collect()}
    heads = sorted((r.doc_id, r.seq, r.level, r.text, r.subtitle, r.data_section) for r in built.headings.collect())
    arts = sorted((r.doc_id, r.seq, r.art_number, r.is_adt, r.law_name, r.summary) for r in built.articles.collect())
    units = sorted((r.doc_id, r.seq, r.role, r.uid, r.is_old_version) for r in built.units.collect())
    notes = sorted((r.doc_id, r.seq, r.fn_id, r.is_private, r.number) for r in built.footnotes.collect())
    want = [], [], [], []
    for k, s in streams.items():
        own = [{"unit_type": kinds[k, i].unit_type, "text": kinds[k, i].text, "art_number": kinds[k, i].art_number, "identifier": kinds[k, i].identifier, "centered": o.get("centered", False), "struck": o.get("struck", False), "notes": o.get("notes", [])} for i, (_, o) in enumerate(s)]
        hs, bs = model(own, DEFS)
        want[0].extend((k, *h) for h in hs)
        for b in bs:
            want[1].append((k, b["seq"], b["number"], b["adt"], b["law"], b["summary"]))
            for role, us in (("caput", [b["caput"]]), ("child", b["children"]), ("version", b["versions"])):
                want[2].extend((k, u["seq"], role, u["uid"], u["old"]) for u in us)
                want[3].extend((k, u["seq"], *n) for u in us for n in u["notes"])
    assert heads == sorted(want[0])
    assert arts == sorted(want[1])
    assert units == sorted(want[2])
    assert notes == sorted(want[3])


UNITS = "doc_id long, block_id long, seq long, role string, unit_type string, identifier string, uid string, text string, is_old_version boolean, is_revoked boolean"


def units(spark, rows):
    return spark.createDataFrame([(1, 1, k, role, "", ident, f"u{k}", f"{ident} - t{k}", old, revoked) for k, (role, ident, old, revoked) in enumerate(rows)], UNITS)


def test_versions(spark):
    got = versions.resolve(units(spark, [("caput", "Art. 1", False, False), *[("child", i, False, False) for i in ("I", "I", "I", "II", "I")]])).orderBy("seq").collect()
    assert [r.is_old_version for r in got] == [False, True, True, False, False, False]


@pytest.mark.parametrize(
    "rows,want",
    [
        ([("caput", "A", False, True)], True),
        ([("caput", "A", False, True), ("child", "I", False, True)], True),
        ([("caput", "A", False, True), ("child", "I", False, False)], False),
        ([("caput", "A", False, False), ("child", "I", False, True)], False),
        ([("caput", "A", False, True), ("child", "I", True, False)], True),
    ],
)
def test_revocation(spark, rows, want):
    assert versions.revoked_articles(versions.resolve(units(spark, rows))).first().is_revoked is want


def test_caput_swap(spark):
    rows = [("version", "A", False, False), ("caput", "A", True, False), ("child", "I", False, False)]
    assert [r.role for r in versions.resolve(units(spark, rows)).orderBy("seq").collect()] == ["caput", "version", "child"]
    assert [r.role for r in versions.resolve(units(spark, rows[:2])).orderBy("seq").collect()] == ["version", "caput"]


STREAM = [
    ("NORMA: Estatuto", {"centered": True}), ("TÍTULO I", {"centered": True}), ("DA CÂMARA", {"centered": True}), ("CAPÍTULO I", {"centered": True}),
    ("Art. 1º - A Câmara <x>.", {"notes": [1]}), "§ 1º - Um.", "I - inciso;", "a) letra;", ("1) item", {"indent": 700}), "II - dois (Redação dada pela Res. 1);", "II - dois novo;",
    ("Art. 2º - old", {"struck": True}), "Art. 2º. New.", "Parágrafo único - PU", ("NORMA: Lei", {"centered": True}), "Art. 1º - outro", "§ 1º - Eleição",
]


@pytest.fixture(scope="module")
def built(spark):
    defs = spark.createDataFrame([(1, "public", "", [([("nota", *PLAIN)], False), ([("dentro", *PLAIN)], True)])], FOOTNOTE_DEFS)
    return statute.build(paragraphs(spark, STREAM), defs, spark.createDataFrame([("Lei", "LO")], LAWS))


def test_html(built):
    html = render.document_html(built.headings, built.articles, built.units).first().html
    assert '<div class="card card-titulo nivel-titulo" data-section="tit1">TÍTULO I<br>DA CÂMARA</div>' in html
    assert '<p><span class="unit-id" data-uid="art1">Art. 1º</span> — A Câmara &lt;x&gt;.<sup class="footnote-ref" data-note="1">[1]</sup></p>' in html
    assert '<strong>Nota 1:</strong> nota<div class="fn-indent">dentro</div>' in html
    assert 'data-uid="art1p1Iasub1" data-path="§ 1º,I,a,1">1)</span> — item</p>' in html
    assert '<p class="old-version art-para" data-ident="II">II - dois (Redação dada pela Res. 1); <span class="amendment-note">(Redação dada pela Res. 1)</span></p>' in html
    assert 'data-art="1" data-law="LO"' in html and 'data-uid="artLO1p1_2"' in html


def test_markdown(built):
    text = markdown.document_markdown(built.headings, built.articles, built.units).first().markdown
    assert text.startswith("# Estatuto\n\n# TÍTULO I — DA CÂMARA\n\n## CAPÍTULO I\n\n#### Art. 1\n\nA Câmara <x>.\n\n> **Nota 1:** nota dentro\n\n**§ 1º** — Um.")
    assert "\n\n---\n\n*Versões anteriores deste artigo:*\n\n*[Versão supersedida]* II - dois" in text
    assert "#### Art. LO:1" in text and text.endswith("**§ 1º** — Eleição\n")


def test_json(built):
    import json

    whole = json.loads(export.document_json(export.element_json(built.headings, built.articles, built.units)).first().json)["elements"]
    assert [e["type"] for e in whole] == ["heading"] * 3 + ["article"] * 2 + ["heading", "article"]
    assert "summary" not in whole[3] and whole[-1]["law_prefix"] == "LO" and "bold" not in whole[3]["caput"]["runs"][0]


def test_outline(built):
    rows = outline.systematic_index(built.headings, built.articles).collect()
    assert [(r.section_id, r.depth, r.is_leaf, r.art_range) for r in rows] == [("tit1", 0, False, ""), ("cap1", 1, True, "(art. 1º–2º)"), ("norma2", 0, True, "(art. 1º)")]
    assert {r.section_id for r in outline.outline_matches(outline.systematic_index(built.headings, built.articles), "capitulo").collect()} == {"tit1", "cap1"}


def test_search(built):
    cards = statute.cards(built).cache()
    seqs = lambda q: [r.seq for r in search.search_cards(cards, q).orderBy("seq").collect()]
    assert seqs("eleicao") == [15] and seqs('"a camara" um') == [4] and seqs("nota") == [] and seqs("r nota") == [4]
    assert seqs("a1") == [4] and seqs("aLO1") == [15] and seqs("a7") == []
    view = search.filtered_view(cards, built.headings, built.articles, query="inciso").orderBy("seq").collect()
    assert [(r.seq, r.kind) for r in view] == [(0, "heading"), (1, "heading"), (3, "heading"), (4, "article")]


def test_targets(spark, built):
    refs = spark.createDataFrame([("a", 1, "", "1", "§ 1º,I"), ("b", 1, "LO", "1", "caput"), ("c", 1, "", "2", "§ú"), ("d", 1, "", "1", "XX"), ("e", 1, "", "9", "")], "ref_id string, doc_id long, law_prefix string, art string, detail string")
    got = {r.ref_id: (r.target, r.target_seq) for r in targets.resolve_refs(refs, built.articles, built.units).collect()}
    assert got == {"a": ("unit", 6), "b": ("caput", 15), "c": ("unit", 13), "d": ("card", 4)}
    strict = {r.ref_id for r in targets.resolve_refs(refs, built.articles, built.units, fallback=False).collect()}
    assert strict == {"a", "b", "c"}


def test_markers(spark, built):
    markers = spark.createDataFrame([(1, "art1p1Ia", 0), (2, "gone", 1)], "position int, uid string, colour int")
    labels = {r.uid: r.label for r in targets.marker_labels(markers, built.units, built.articles).collect()}
    assert labels == {"art1p1Ia": "1,§1,I,a", "gone": "gone"}
    assert targets.next_colour(markers) == 2
    assert [r.uid for r in targets.toggle_marker(markers, "gone").collect()] == ["art1p1Ia"]
    assert [r.colour for r in targets.toggle_marker(markers, "new").orderBy("position").collect()] == [0, 1, 2]
    assert targets.clear_markers(markers).count() == 0


def test_diff(built):
    got = {r.seq: [tuple(p) for p in r.parts] for r in diff.version_diffs(built.units).collect()}
    assert got[9] == [("eq", "II"), ("eq", "-"), ("eq", "dois"), *[("del", w) for w in "(Redação dada pela Res. 1);".split()], ("ins", "novo;")]
    assert diff.word_diff("a b", "b c") == [("del", "a"), ("eq", "b"), ("ins", "c")]
    assert diff.word_diff("", "x") == [("ins", "x")] and diff.word_diff("", "") == []


def test_empty(spark):
    empty = statute.build(spark.createDataFrame([], PARAGRAPHS))
    assert empty.headings.count() == empty.articles.count() == empty.units.count() == 0
    assert structure.elements(empty.headings, empty.articles).count() == 0
