"""DOCX and XLSX files as tables.

Files are read by Spark as binary rows, so any store and any number of files will do; each file is parsed in
the worker that has it (lexflow.sources.docx_source reads large files from a mounted store without holding them). Spark's XPath
doesn't see name spaces, so parsing is Python's. Documents are parsed as a stream: a paragraph is forgotten once its row is made, and rows
leave in batches.
"""

import io
import itertools
import re
import zipfile
from collections.abc import Iterator
from types import SimpleNamespace
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexflow.schemas import FOOTNOTE_DEFS, PARAGRAPHS, STYLED, SUBJECT_ROWS

#: Name spaces and a relation's type, as the file formats have them. Fixed values.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
HYPERLINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/hyperlink"

TEXT, TAB, BREAK, FLAGS, BOLD, ITALIC, STRIKE, PROPERTIES, RUN, LINK, NOTE, ID = (W + name for name in ("t", "tab", "br", "rPr", "b", "i", "strike", "pPr", "r", "hyperlink", "footnoteReference", "id"))

LAW_SHEET = "Normas"

#: Rows that leave a parser together.
BATCH = 1_000
#: Bytes of a part that are parsed together.
CHUNK = 1 << 16


def archive(data) -> zipfile.ZipFile:
    """A file's archive, of its bytes or of an open file or path."""
    return data if isinstance(data, zipfile.ZipFile) else zipfile.ZipFile(io.BytesIO(data) if isinstance(data, bytes) else data)


def _part(data, name: str):
    z = archive(data)
    try:
        return ElementTree.fromstring(z.read(name))
    except KeyError:
        return None


def children(data, name: str, above: tuple[str, ...], tag: str) -> Iterator:
    """The elements of a tag that stand right below a path of tags in a part, one at a time; nothing else of the part is held."""
    z = archive(data)
    if name not in z.namelist():
        return
    target, done = _wanted((*above, tag))
    parser = ElementTree.XMLParser(target=target)
    with z.open(name) as part:
        while text := part.read(CHUNK):
            parser.feed(text)
            yield from done
            done.clear()
    parser.close()
    yield from done


def _wanted(path: tuple[str, ...]) -> tuple[SimpleNamespace, list]:
    """A parser's target that makes the elements at a path from the root and no others, and the list that they are added to."""
    done, builder, depth, found, inside = [], None, 0, 0, 0

    def start(tag, attributes):
        nonlocal builder, depth, found, inside
        if builder is not None:
            inside += 1
            builder.start(tag, attributes)
            return
        if depth == found and tag == path[found]:
            found += 1
        depth += 1
        if found == len(path):
            builder, inside = ElementTree.TreeBuilder(), 1
            builder.start(tag, attributes)

    def end(tag):
        nonlocal builder, depth, found, inside
        if builder is not None:
            builder.end(tag)
            inside -= 1
            if inside:
                return
            done.append(builder.close())
            builder = None
        depth -= 1
        found = min(found, depth)

    def data(text):
        if builder is not None:
            builder.data(text)

    return SimpleNamespace(start=start, end=end, data=data, close=lambda: None), done


def _number(text: str | None, default: int | None = 0) -> int | None:
    try:
        return int(text or "")
    except ValueError:
        return default


def _run(el, url: str = "", anchor: str = "") -> dict:
    """A run: its texts, then its tabs, then its breaks; a flag's presence counts, whatever its value."""
    texts, tabs, breaks, flags = [], 0, 0, None
    for c in el:
        tag = c.tag
        if tag == TEXT:
            texts.append(c.text or "")
        elif tag == FLAGS:
            flags = {f.tag for f in c} if flags is None else flags
        elif tag == TAB:
            tabs += 1
        elif tag == BREAK:
            breaks += 1
    flags = flags or ()
    return {"text": "".join(texts) + "\t" * tabs + "\n" * breaks, "bold": BOLD in flags, "italic": ITALIC in flags, "strike": STRIKE in flags, "hyperlink_url": url or None, "hyperlink_anchor": anchor or None}


def _property(p, path: str, name: str) -> str | None:
    for above in p.findall(PROPERTIES):
        el = above.find(W + path)
        if el is not None:
            return el.get(W + name)
    return None


def links(data) -> dict[str, str]:
    """Targets of hyperlinks by relation id; none without that part."""
    root = _part(data, "word/_rels/document.xml.rels")
    rows = [] if root is None else [r for r in root if r.tag.rpartition("}")[2] == "Relationship" and HYPERLINK in r.get("Type", "")]
    return {r.get("Id", ""): r.get("Target", "") for r in rows}


def body_paragraphs(data) -> Iterator:
    """The body's own paragraphs; those inside tables aren't."""
    return children(data, "word/document.xml", (f"{W}document", f"{W}body"), f"{W}p")


def paragraphs(data) -> Iterator[dict]:
    """Rows of PARAGRAPHS without doc_id."""
    target = links(data)
    for seq, p in enumerate(body_paragraphs(data)):
        runs, notes = [], []
        for child in p:
            if child.tag == RUN:
                ref = child.find(NOTE)
                if ref is not None and (n := _number(ref.get(ID), None)) is not None:
                    notes.append(n)
                runs.append(_run(child))
            elif child.tag == LINK:
                runs += [_run(r, target.get(child.get(f"{R}id", ""), ""), child.get(f"{W}anchor", "")) for r in child.findall(RUN)]
        runs = [r for r in runs if r["text"]]
        size = lambda rs: sum(len(r["text"].strip()) for r in rs)
        mark = p.find(f"{W}bookmarkStart")
        yield {
            "seq": seq,
            "text": "".join(r["text"] for r in runs).strip(),
            "runs": runs,
            "is_centered": _property(p, "jc", "val") == "center",
            "has_strike": 2 * size([r for r in runs if r["strike"]]) > size(runs),
            "indent_left": _number(_property(p, "ind", "left")),
            "bookmark_name": "" if mark is None else mark.get(f"{W}name", ""),
            "footnote_ids": notes,
        }


def lint_paragraphs(data) -> Iterator[dict]:
    """Paragraphs as the document lint sees them: all runs below, no breaks."""
    for seq, p in enumerate(body_paragraphs(data)):
        text = "".join("".join([t.text or "" for t in r.findall(TEXT)]) + "\t" * len(r.findall(TAB)) for r in p.iter(RUN))
        yield {"seq": seq, "text": text.strip(), "is_centered": _property(p, "jc", "val") == "center", "indent_left": _number(_property(p, "ind", "left"))}


def _begins(text: str, letter: str) -> bool:
    return text[:2].lower() == f"{letter} "


def footnote_definitions(data, include_private: bool = False) -> Iterator[dict]:
    """Rows of FOOTNOTE_DEFS: public notes, private ones ("b …") if asked for, and summaries ("s …")."""
    for note in children(data, "word/footnotes.xml", (f"{W}footnotes",), f"{W}footnote"):
        number = _number(note.get(f"{W}id"), None)
        if number is None or note.get(f"{W}type") in ("separator", "continuationSeparator"):
            continue
        paras = []
        for p in note.findall(f"{W}p"):
            runs = [_run(r) for r in p.findall(f"{W}r") if r.find(f"{W}footnoteRef") is None]
            paras.append({"runs": [r for r in runs if r["text"]], "indent": (_property(p, "ind", "left") or "0") != "0"})
        first = next((p for p in paras if "".join(r["text"] for r in p["runs"]).strip()), {"runs": []})
        text = "".join(r["text"] for r in first["runs"]).strip()
        kind = "public"
        if text.lower() == "b" or _begins(text, "b"):
            if not include_private:
                continue
            kind = "private"
            for r in first["runs"]:
                start = r["text"].lstrip()
                if _begins(start, "b"):
                    r["text"] = r["text"].replace("b ", "", 1).replace("B ", "", 1)
                    break
                if start.strip().lower() == "b" and start.lower() == "b":
                    r["text"] = ""
                    break
        elif _begins(text, "s"):
            kind = "summary"
        yield {"fn_id": number, "kind": kind, "summary": text[2:].strip() if kind == "summary" else "", "paragraphs": paras}


def styled_paragraphs(data) -> Iterator[dict]:
    """Rows of STYLED: each run's first text, whether all that has text is bold, and the style."""
    for seq, p in enumerate(body_paragraphs(data)):
        runs = []
        for r in p.findall(RUN):
            t, flags = r.find(TEXT), r.find(FLAGS)
            runs.append({"text": "" if t is None else t.text or "", "bold": flags is not None and flags.find(BOLD) is not None})
        text = "".join(r["text"] for r in runs)
        yield {"seq": seq, "style": _property(p, "pStyle", "val"), "runs": runs, "text": text, "all_bold": all(r["bold"] for r in runs if r["text"].strip()), "is_empty": not text.strip()}


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheets(data: bytes) -> dict[str, list[list[str | None]]]:
    """Cell texts of each sheet by rows, in the workbook's order; a row stands at its own number."""
    book, rels, strings = _part(data, "xl/workbook.xml"), _part(data, "xl/_rels/workbook.xml.rels"), _part(data, "xl/sharedStrings.xml")
    targets = {r.get("Id"): r.get("Target") for r in (rels if rels is not None else [])}
    shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in (strings.findall(f"{S}si") if strings is not None else [])]
    out = {}
    for sheet in book.iter(f"{S}sheet"):
        target = targets[sheet.get(f"{R}id")]
        root, rows = _part(data, target.lstrip("/") if target.startswith("/") else f"xl/{target}"), []
        for el in root.iter(f"{S}row"):
            cells: dict[int, str | None] = {}
            for c in el.findall(f"{S}c"):
                at = _column(c.get("r")) if c.get("r") else len(cells)
                v = c.find(f"{S}v")
                if c.get("t") == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{S}t"))
                elif v is not None:
                    cells[at] = shared[int(v.text)] if c.get("t") == "s" else v.text
            while len(rows) < int(el.get("r", len(rows) + 1)) - 1:
                rows.append([])
            rows.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
        out[sheet.get("name")] = rows
    return out


def subject_rows(data: bytes) -> list[dict]:
    """Rows of SUBJECT_ROWS of the first sheet that isn't the laws', below its header."""
    book = sheets(data)
    main = next((rows for name, rows in book.items() if name != LAW_SHEET), [])
    width = max(map(len, main), default=0)
    cell = lambda row, k: (row[k] or "") if k < len(row) else ""
    return [{"row_no": n, "subject": cell(r, 0), "sub_subject": cell(r, 1), "devices": cell(r, 2), "see_also": cell(r, 3), "width": width} for n, r in enumerate(main[1:], 2)]


def law_rows(data: bytes) -> list[dict]:
    """row_no, law_prefix, law_name of the laws' sheet; none without it."""
    cell = lambda row, k: (row[k] or "") if k < len(row) else ""
    return [{"row_no": n, "law_prefix": cell(r, 0), "law_name": cell(r, 1)} for n, r in enumerate(sheets(data).get(LAW_SHEET, [])[1:], 2)]


def parsed(files: DataFrame, parse, schema: str) -> DataFrame:
    """The rows that parse gives for each of files (doc_id, path, content), with doc_id and path."""
    schema = f"doc_id long, path string, {schema}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for doc_id, name, content in zip(*(batch.column(c) for c in ("doc_id", "path", "content")), strict=True):
                found = iter(parse(content.as_py()))
                while rows := list(itertools.islice(found, BATCH)):
                    own = [[doc_id.as_py()] * len(rows), [name.as_py()] * len(rows)] + [[r[c] for r in rows] for c in arrow.names[2:]]
                    yield pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(own, arrow, strict=True)], schema=arrow)

    return files.select("doc_id", "path", "content").mapInArrow(run, schema)


def read_files(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    """parsed for the files at path; doc_id is a hash of a file's path."""
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("doc_id"), "path", "content")
    return parsed(files, parse, schema)


LINT = "seq long, text string, is_centered boolean, indent_left int"
LAW_ROWS = "row_no int, law_prefix string, law_name string"


def _without_doc(schema: str) -> str:
    return schema.removeprefix("doc_id long, ")


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    return read_files(spark, path, paragraphs, _without_doc(PARAGRAPHS))


def read_footnotes(spark: SparkSession, path: str, include_private: bool = False) -> DataFrame:
    return read_files(spark, path, lambda data: footnote_definitions(data, include_private), FOOTNOTE_DEFS)


def read_styled(spark: SparkSession, path: str) -> DataFrame:
    return read_files(spark, path, styled_paragraphs, STYLED)


def read_lint(spark: SparkSession, path: str) -> DataFrame:
    return read_files(spark, path, lint_paragraphs, LINT)


def read_subjects(spark: SparkSession, path: str) -> DataFrame:
    return read_files(spark, path, subject_rows, SUBJECT_ROWS)


def read_laws(spark: SparkSession, path: str) -> DataFrame:
    return read_files(spark, path, law_rows, LAW_ROWS)
