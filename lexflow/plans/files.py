"""Office files made of the test views, as rows of bytes: what the readers are checked with.

A document's paragraphs make one DOCX file, some thousand rows of the sheet one XLSX file; files are made and read in
tasks, a file a row.
"""

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexflow.plans import views
from lexflow.sources.ooxml import HYPERLINK, LAW_SHEET, R, S, W

FILES = "doc_id long, path string, content binary"
#: Rows of the sheet that a workbook has.
ROWS = 1_000


def _archive(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _run(text: str, flags: str = "") -> str:
    return f'<w:r><w:rPr>{flags}</w:rPr><w:t xml:space="preserve">{escape(text)}</w:t></w:r>'


def _paragraph(row) -> str:
    """One of the view's paragraphs: two runs around a separator, every fifth text a link, every seventh paragraph in a table."""
    flags = "<w:strike/>" if row.has_strike else ""
    head, dash, rest = row.text.partition(" - ")
    runs = _run(head + dash, "<w:b/>" + flags) + (_run(rest, flags) if dash else "")
    if row.seq % 5 == 1:
        runs = f'<w:hyperlink r:id="r{row.seq % 3}">{runs}</w:hyperlink>'
    note = "" if pd.isna(row.fn_id) else f'<w:r><w:footnoteReference w:id="{int(row.fn_id)}"/></w:r>'
    props = ('<w:pStyle w:val="Heading1"/>' if row.is_centered else "") + f'<w:ind w:left="{row.indent_left}"/>' + ('<w:jc w:val="center"/>' if row.is_centered else "")
    p = f"<w:p><w:pPr>{props}</w:pPr>{runs}{note}</w:p>"
    return f"<w:tbl><w:tr><w:tc>{p}</w:tc></w:tr></w:tbl>" if row.seq % 7 == 3 else p


def _docx(rows: pd.DataFrame) -> pd.DataFrame:
    rows, spaces = rows.sort_values("seq"), f'xmlns:w="{W[1:-1]}" xmlns:r="{R[1:-1]}"'
    notes = ['<w:footnote w:id="-1" w:type="separator"/>']
    for r in rows.dropna(subset=["kind"]).drop_duplicates("fn_id").itertuples():
        text = {"public": "note", "private": "b note", "summary": "s sum"}[r.kind] + f" {int(r.fn_id)}"
        notes.append(f'<w:footnote w:id="{int(r.fn_id)}"><w:p><w:r><w:footnoteRef/></w:r>{_run(text)}</w:p></w:footnote>')
    links = "".join(f'<Relationship Id="r{k}" Type="{HYPERLINK}" Target="http://x.org/{k}"/>' for k in range(2))  # the third has no target
    content = _archive(
        {
            "word/document.xml": f"<w:document {spaces}><w:body>{''.join(map(_paragraph, rows.itertuples()))}</w:body></w:document>",
            "word/footnotes.xml": f"<w:footnotes {spaces}>{''.join(notes)}</w:footnotes>",
            "word/_rels/document.xml.rels": f'<Relationships xmlns="x">{links}</Relationships>',
        }
    )
    doc_id = int(rows["doc_id"].iloc[0])
    return pd.DataFrame({"doc_id": [doc_id], "path": [f"{doc_id}.docx"], "content": [content]})


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A DOCX file for each document of the view."""
    rows = views.paragraphs(spark, sf_dir).select("doc_id", "seq", "text", "is_centered", "has_strike", "indent_left", F.get("footnote_ids", F.lit(0)).alias("fn_id"))
    return rows.withColumn("kind", F.expr(views.FOOTNOTE_KIND)).groupBy("doc_id").applyInPandas(_docx, FILES)


def _xlsx(rows: pd.DataFrame) -> pd.DataFrame:
    def cell(column: str, n: int, text: str) -> str:
        return f'<c r="{column}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>' if text else ""

    def sheet(found) -> str:
        return f'<worksheet xmlns="{S[1:-1]}"><sheetData>' + "".join(f'<row r="{n}">{"".join(cell(c, n, t) for c, t in zip("ABCDE", texts, strict=False))}</row>' for n, texts in found) + "</sheetData></worksheet>"

    main = [(1, ("Assunto", "Sub", "Dispositivos", "Vide"))]
    main += [(int(r.n), (r.subject, r.sub_subject, r.devices, r.see_also)) for r in rows.sort_values("n").itertuples()]
    laws = [(1, ("Prefixo", "Nome")), (2, ("LX", "Lei 1")), (3, ("LO", "Lei 1 ")), (4, ("", "Lei 9")), (5, (" CF", "Lei 2"))]
    book = f'<workbook xmlns="{S[1:-1]}" xmlns:r="{R[1:-1]}"><sheets><sheet name="{LAW_SHEET}" r:id="a"/><sheet name="Assuntos" r:id="b"/></sheets></workbook>'
    rels = '<Relationships xmlns="x"><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="/xl/worksheets/s2.xml"/></Relationships>'
    content = _archive({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/worksheets/s1.xml": sheet(laws), "xl/worksheets/s2.xml": sheet(main)})
    doc_id = int(rows["doc_id"].iloc[0])
    return pd.DataFrame({"doc_id": [doc_id], "path": [f"{doc_id}.xlsx"], "content": [content]})


def workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheet in files of ROWS rows: every 17th row isn't there, every 13th has no subject, every 19th blanks around it."""
    rows = views.subject_sheet(spark, sf_dir).where("row_no % 17 <> 5")
    subject = F.when(F.col("row_no") % 13 == 4, " ").when(F.col("row_no") % 19 == 6, F.concat(F.lit("  "), "subject", F.lit("  "))).otherwise(F.col("subject"))
    rows = rows.select(F.floor(F.col("row_no") / ROWS).alias("doc_id"), (F.col("row_no") % ROWS + 2).alias("n"), subject.alias("subject"), "sub_subject", "devices", "see_also")
    return rows.groupBy("doc_id").applyInPandas(_xlsx, FILES)
