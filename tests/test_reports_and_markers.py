"""Reports that leave nothing out, the log of markers under crashes and several writers, tables saved in part."""

import random

import pytest
from pyspark.sql import functions as F

from lexflow.operators import checks, search, targets
from lexflow.sources import marker_log, sinks

ISSUES = checks.ISSUES + ", place array<long>"


def test_issue_report_is_whole(spark):
    rows = [("vide", "aviso", f"m{k:03}", "" if k % 2 else "c", [k]) for k in range(130)] + [("ref_cruzada", "erro", "e", "x", [1]), ("outra", "aviso", "o", "", [2])]
    lines = sinks.issue_report(spark.createDataFrame(rows, ISSUES).repartition(5)).splitlines()
    assert lines[0] == "== Referências cruzadas: 1 erro" and lines[1] == "  [erro] e (x)" and lines[2] == "== Vide: 130 aviso"
    assert lines[3:133] == [f"  [aviso] m{k:03}" + ("" if k % 2 else " (c)") for k in range(130)]
    assert lines[133:] == ["== outra: 1 aviso", "  [aviso] o", "Total: 1 erro, 131 aviso"]
    assert sinks.issue_report(spark.createDataFrame([], ISSUES)) == "Nenhum problema.\n"


def test_lint_text_is_whole(spark):
    texts = ["Art. x", "§ nada", "Art. 3 - y", "l - z", "§ outra", "Art. 10 - w"]
    rows = spark.createDataFrame([(1, k, t, False) for k, t in enumerate(texts)], "doc_id long, seq long, text string, is_centered boolean")
    lines = sinks.lint_text(checks.document_lint(rows), rows).splitlines()
    assert lines[0] == "Parágrafos lidos: 6 | Problemas encontrados: 5"
    assert [x for x in lines if x.startswith("[")] == [f"[{c}] {checks.CODE_LABELS[c]}  ({n} ocorrência{'s' * (n > 1)})" for c, n in (("PARA_UNMATCHED", 2), ("ART_UNMATCHED", 1), ("ART_NO_ORDINAL", 1), ("INCISO_L", 1))]
    assert lines[2:8] == ["  Contexto : (antes do 1º artigo)", f"  Problema : {checks.FAULTS['PARA_UNMATCHED']}", "  Texto    : § nada", "  Contexto : Art. 3", f"  Problema : {checks.FAULTS['PARA_UNMATCHED']}", "  Texto    : § outra"]
    assert sinks.lint_text(checks.document_lint(rows.limit(0)), rows.limit(0)).splitlines() == ["Parágrafos lidos: 0 | Problemas encontrados: 0"]


def plain_state(events):
    marks = {}
    for at, writer, n, op, doc_id, uid, colour in sorted(events, key=lambda e: e[:3]):
        if op == "clear":
            marks = {k: v for k, v in marks.items() if doc_id is not None and k[0] != doc_id}
        elif op == "mark":
            marks.pop((doc_id, uid), None)
            marks[doc_id, uid] = (colour, at)
        else:
            marks.pop((doc_id, uid), None)
    return {k: v for k, v in marks.items()}


def some_events(seed, n=60):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        op = rnd.choices(["mark", "unmark", "clear"], [6, 3, 1])[0]
        doc_id = rnd.choice([1, 2, 3]) if op != "clear" or rnd.random() < 0.7 else None
        out.append((rnd.randint(0, 30), rnd.choice("ab"), k, op, doc_id, None if op == "clear" else f"u{rnd.randint(0, 4)}", rnd.randint(0, 7) if op == "mark" else None))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_log_equals_a_sequential_reading(spark, seed):
    events = some_events(seed)
    log = spark.createDataFrame(events + events[:20], marker_log.EVENTS)
    for rows in (log, marker_log.folded(log), marker_log.folded(log).unionByName(log.limit(10))):
        got = marker_log.markers(rows).collect()
        assert {(r.doc_id, r.uid): (r.colour, r.at) for r in got} == plain_state(events) and len(got) == len(plain_state(events))
        assert sorted((r.doc_id, r.position) for r in got) == [(d, k + 1) for d in (1, 2, 3) for k in range(sum(r.doc_id == d for r in got))]


def test_marks_of_two_writers(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    assert marker_log.markers(marker_log.events(spark, path)).collect() == []
    assert marker_log.toggle(spark, path, "a", 1, "art1") and marker_log.toggle(spark, path, "b", 2, "art1") and marker_log.toggle(spark, path, "b", 1, "art2")
    assert not marker_log.toggle(spark, path, "a", 2, "art1")
    state = lambda: sorted((r.doc_id, r.uid, r.colour, r.position) for r in marker_log.markers(marker_log.events(spark, path)).collect())
    assert state() == [(1, "art1", 0, 1), (1, "art2", 1, 2)]
    # a writer that decided by an older state takes nobody's mark away
    marker_log._event(spark, path, "c", "mark", 1, "art2", 5)
    assert [x[:3] for x in state()] == [(1, "art1", 0), (1, "art2", 5)]
    marker_log.clear(spark, path, "c", 1)
    assert state() == []


def test_compaction_loses_nothing(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/log"
    events = some_events(9)
    for k in range(0, 60, 20):
        marker_log.append(spark.createDataFrame(events[k : k + 20], marker_log.EVENTS), path)
    state = lambda: {(r.doc_id, r.uid): (r.colour, r.at) for r in marker_log.markers(marker_log.events(spark, path)).collect()}
    want = plain_state(events)
    (tmp_path / "log" / "half").mkdir()  # an append that was cut short
    (tmp_path / "log" / "half" / "_temporary").mkdir()
    real, calls = marker_log._store, []

    def dying(spark, at):
        if at.startswith(f"file:{tmp_path}/log/"):
            calls.append(at)
            if len(calls) == 2:
                raise OSError("died between two deletions")
        return real(spark, at)

    monkeypatch.setattr(marker_log, "_store", dying)
    with pytest.raises(OSError, match="died"):
        marker_log.compact(spark, path)
    monkeypatch.setattr(marker_log, "_store", real)
    assert state() == want
    marker_log.compact(spark, path)
    assert state() == want and len(marker_log._folders(spark, path)) == 1
    marker_log.compact(spark, path)
    late = (0, "a", 0, "mark", 1, "u9", 3)  # older than all that was folded, and of a provision without events
    marker_log.append(spark.createDataFrame([late], marker_log.EVENTS), path)
    assert state() == plain_state([*events, late])


def test_a_log_that_cannot_be_read_is_an_error(spark, tmp_path):
    (tmp_path / "log" / "x").mkdir(parents=True)
    (tmp_path / "log" / "x" / "part-0.parquet").write_text("broken")
    with pytest.raises(Exception, match="(?i)parquet"):
        marker_log.events(spark, f"file://{tmp_path}/log").collect()


def test_markers_belong_to_documents(spark):
    units = spark.createDataFrame([(d, 1, d, "art1", "Art. 1", "", ) for d in (1, 2)], "doc_id long, block_id long, seq long, uid string, identifier string, path string")
    articles = spark.createDataFrame([(d, 1, "1", "") for d in (1, 2)], "doc_id long, block_id long, art_number string, law_prefix string")
    marks = spark.createDataFrame([(2, "art1", 0)], "doc_id long, uid string, colour int")
    assert [r.doc_id for r in search.marked(articles, units, marks).collect()] == [2]
    assert sorted(r.doc_id for r in search.marked(articles, units, marks.drop("doc_id")).collect()) == [1, 2]
    assert targets.marker_labels(marks, units, articles).count() == 1


def test_next_colours(spark):
    marks = spark.createDataFrame([(1, c) for c in (0, 1, 3)] + [(2, c) for c in range(8)] + [(2, 0)], "doc_id long, colour int")
    assert sorted(map(tuple, marker_log.next_colours(marks).collect())) == [(1, 3, 2), (2, 9, 1)]


@pytest.mark.parametrize("step", ["written", "half written", "moved"])
def test_a_save_that_was_cut_short(spark, tmp_path, step):
    path, schema = f"{tmp_path}/t", "a int"
    old, new = spark.createDataFrame([(1,)], schema), spark.createDataFrame([(2,)], schema)
    sinks.save_table(old, path)
    new.coalesce(1).write.parquet(f"{path}.new")
    if step == "half written":
        (tmp_path / "t.new" / "_SUCCESS").unlink()
    if step != "written":
        (tmp_path / "t").rename(tmp_path / "t.old")
    got = [r.a for r in sinks.load_table(spark, path, schema).collect()]
    assert got == ([2] if step == "moved" else [1])
    sinks.save_table(spark.createDataFrame([(3,)], schema), path)
    assert [r.a for r in sinks.load_table(spark, path, schema).collect()] == [3] and not (tmp_path / "t.old").exists()
    (tmp_path / "t" / next(p.name for p in (tmp_path / "t").glob("part-*"))).write_text("broken")
    (tmp_path / "t" / next(p.name for p in (tmp_path / "t").glob(".part-*.crc"))).unlink()
    with pytest.raises(Exception, match="(?i)parquet"):
        sinks.load_table(spark, path, schema).agg(F.count("a")).collect()
