import json
import zipfile

from lexflow.operators import side_documents, subjects
from lexflow.plans import statute
from lexflow.sources import config, ooxml, sinks

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def run(text, flags=""):
    return f"<w:r><w:rPr>{flags}</w:rPr><w:t>{text}</w:t></w:r>"


def para(*runs, props=""):
    return f"<w:p><w:pPr>{props}</w:pPr>{''.join(runs)}</w:p>"


CENTER = '<w:jc w:val="center"/>'


def docx(path, body, notes="", links=""):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        if notes:
            z.writestr("word/footnotes.xml", f"<w:footnotes {W}>{notes}</w:footnotes>")
        if links:
            z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
    return str(path)


def note(number, *runs, kind=""):
    return f'<w:footnote w:id="{number}"{kind}>{para("<w:r><w:footnoteRef/></w:r>", *runs)}</w:footnote>'


def main_docx(path):
    body = "".join(
        [
            para(run("TÍTULO I"), props=CENTER),
            para(run("Art. 1º - "), run("A Casa", "<w:b/>"), '<w:r><w:footnoteReference w:id="2"/></w:r>', '<w:r><w:footnoteReference w:id="3"/></w:r>', '<w:r><w:footnoteReference w:id="4"/></w:r>', '<w:hyperlink r:id="r1"><w:r><w:t>lei</w:t></w:r></w:hyperlink>'),
            "<w:tbl><w:tr><w:tc>" + para(run("na tabela")) + "</w:tc></w:tr></w:tbl>",
            para(run("I - "), run("riscado", "<w:strike/>"), props='<w:ind w:left="720"/>'),
            para(run("§ x")),
        ]
    )
    notes = '<w:footnote w:id="0" w:type="separator"/>' + note(2, run("pública")) + note(3, run("b segredo b ")) + note(4, run("s Resumo"))
    return docx(path, body, notes, f'<Relationship Id="r1" Type="{ooxml.HYPERLINK}" Target="http://x.org"/>')


def xlsx(path):
    cell = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    sheet = lambda rows: '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + "".join(f'<row r="{n}">{"".join(cell(f"{c}{n}", v) for c, v in r.items())}</row>' for n, r in rows) + "</sheetData></worksheet>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Normas" r:id="a"/><sheet name="Assuntos" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/worksheets/s1.xml", sheet([(1, {"A": "Prefixo", "B": "Nome"}), (2, {"A": "LO", "B": "Lei"}), (3, {"A": "LX", "B": "Lei"})]))
        z.writestr("xl/worksheets/s2.xml", sheet([(1, {"A": "Assunto"}), (3, {"A": "Mesa", "C": "1\n7,II", "D": "Nada"}), (4, {"B": "sem assunto", "C": "1"})]))
    return str(path)


def test_docx(spark, tmp_path):
    path = main_docx(tmp_path / "a.docx")
    rows = ooxml.read_docx(spark, path).orderBy("seq").collect()
    assert [r.text for r in rows] == ["TÍTULO I", "Art. 1º - A Casalei", "I - riscado", "§ x"]
    assert rows[0].is_centered and rows[1].footnote_ids == [2, 3, 4] and rows[1].runs[2].hyperlink_url == "http://x.org" and rows[1].runs[1].bold
    assert rows[2].has_strike and rows[2].indent_left == 720
    public = {r.fn_id: r.kind for r in ooxml.read_footnotes(spark, path).collect()}
    assert public == {2: "public", 4: "summary"}
    private = {r.fn_id: r for r in ooxml.read_footnotes(spark, path, include_private=True).collect()}
    assert private[3].kind == "private" and private[3].paragraphs[0].runs[0].text == "segredo b " and private[4].summary == "Resumo"
    assert ooxml.read_lint(spark, path).count() == 4


def test_xlsx(spark, tmp_path):
    path = xlsx(tmp_path / "a.xlsx")
    assert [tuple(r) for r in subjects.laws(ooxml.read_laws(spark, path)).collect()] == [("Lei", "LX")]
    rows = subjects.entries(ooxml.read_subjects(spark, path)).collect()
    assert [(r.row_no, r.subject, r.vides) for r in rows] == [(3, "Mesa", ["Nada"])]


def side(path):
    bold = "<w:b/>"
    return docx(path, "".join([para(run("antes – Art. 3.")), para(run("Leis"), props='<w:pStyle w:val="Heading1"/>'), para(run("GRUPO", bold)), para(run("Lei "), run("forte &amp; cia", bold), run(" – Art. 10, II.")), para(), para(run("VAZIO", bold))]))


def test_side_documents(spark, tmp_path):
    rows = ooxml.read_styled(spark, side(tmp_path / "r.docx"))
    got = side_documents.reference_groups(rows).collect()
    assert [r.category for r in got] == ["Geral", "Leis"]
    assert [g.title for g in got[1].groups] == ["GRUPO", "VAZIO"]
    assert (got[0].groups[0].title, got[0].groups[0].entries[0].html, got[0].groups[0].entries[0].art_ref) == ("", "antes", "3")
    assert (got[1].groups[0].entries[0].html, got[1].groups[0].entries[0].art_ref) == ("Lei <b>forte &amp; cia</b>", "10, II")
    assert side_documents.information_html(rows).first().html.startswith("<p>antes – Art. 3.</p>\n<h3>Leis</h3>")


def test_build(spark, tmp_path):
    main_docx(tmp_path / "a.docx"), xlsx(tmp_path / "a.xlsx"), side(tmp_path / "r.docx")
    (tmp_path / "c.toml").write_text(f"[sources]\ndocx = '{tmp_path}/a.docx'\nxlsx = '{tmp_path}/a.xlsx'\nreferencias = '{tmp_path}/r.docx'\ninformacoes = '{tmp_path}/absent.docx'\n[output]\nchatbot = '{tmp_path}/out'\nprivate = '{tmp_path}/private'\n")
    own = config.load(str(tmp_path / "c.toml"))
    assert statute.run(spark, own) == 1  # a reference to article 7 dangles
    page, private = (tmp_path / "out/index.html").read_text(), (tmp_path / "private/index.html").read_text()
    assert "segredo" not in page and "segredo" in private and "Resumo" in page
    assert "# TÍTULO I" in (tmp_path / "out/statute.md").read_text() and "## Mesa" in (tmp_path / "out/subjects.md").read_text()
    assert "- Lei **forte & cia** — Art. 10, II" in (tmp_path / "out/references.md").read_text()
    assert json.loads((tmp_path / "out/statute.json").read_text())[0]["elements"][0]["type"] == "heading"
    report = (tmp_path / "out/report.txt").read_text()
    assert "Art. 7 não encontrado" in report and "PARA_UNMATCHED" in report


def test_config(tmp_path):
    assert config.load(str(tmp_path / "none.toml")) == config.Config()
    (tmp_path / "bad.toml").write_text("= broken")
    assert config.load(str(tmp_path / "bad.toml"), lenient=True) == config.Config()


def test_sinks(spark, tmp_path):
    assert sinks.assemble("a{{x}}b{{y}}{{x}}", {"x": "{{y}}"}) == "a{{y}}b{{y}}{{y}}"
    table = spark.createDataFrame([(1, "u")], "position int, uid string")
    sinks.save_table(table, f"{tmp_path}/m")
    sinks.save_table(spark.read.parquet(f"{tmp_path}/m").union(table), f"{tmp_path}/m")
    assert spark.read.parquet(f"{tmp_path}/m").count() == 2


def test_build_dumps(spark, tmp_path):
    """The files for a look inside are JSON, the page's data too, and the lint report has its findings."""
    main_docx(tmp_path / "a.docx"), xlsx(tmp_path / "a.xlsx"), side(tmp_path / "r.docx")
    own = config.Config(docx=f"{tmp_path}/a.docx", xlsx=f"{tmp_path}/a.xlsx", references=f"{tmp_path}/r.docx", information=f"{tmp_path}/r.docx", export_dir=f"{tmp_path}/out")
    statute.run(spark, own, template="{{systematic}}\n{{subjects}}\n{{references}}\n{{summaries}}\n{{information}}\n{{unknown}}{{", debug_dir=f"{tmp_path}/debug")
    parts = (tmp_path / "out/index.html").read_text().split("\n")
    data = [json.loads(p) for p in parts[:5]]
    assert parts[5] == "{{unknown}}{{" and data[0][0]["title"] == "TÍTULO I" and data[1][0]["subject"] == "Mesa" and data[2][1]["category"] == "Leis" and data[3] == {"1": "Resumo"} and data[4].startswith("<p>antes") and "<\\/p>" in parts[4]
    dumps = {p.stem: json.loads(p.read_text()) for p in (tmp_path / "debug").iterdir()}
    assert set(dumps) == {"parsed_document", "systematic_index", "subject_index", "references", "validation_report"}
    assert dumps["subject_index"] == data[1] and [e["type"] for e in dumps["parsed_document"][0]["elements"]] == ["heading", "article"] and any(i["category"] == "docx" for i in dumps["validation_report"])
    assert "Texto    : § x" in (tmp_path / "out/lint.txt").read_text()
