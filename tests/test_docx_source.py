"""The docx format: the same rows as the parsers, pushed conditions, large files in little memory."""

import subprocess
import sys
import zipfile

import pytest
from pyspark.sql import functions as F
from test_sources import CENTER, W, docx, main_docx, para, run

from lexflow.sources import docx_source, ooxml


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("docx")
    main_docx(at / "a.docx")
    docx(at / "b.docx", "".join(para(run(f"Art. {k} - x"), props=CENTER if k % 5 == 0 else "") for k in range(3000)))
    docx(at / "c.docx", "")
    docx_source.register(spark)
    return at


@pytest.mark.parametrize("table,read", [("paragraphs", ooxml.read_docx), ("lint", ooxml.read_lint), ("styled", ooxml.read_styled), ("footnotes", ooxml.read_footnotes)])
def test_format_equals_the_readers(spark, folder, table, read):
    got, want = spark.read.format("docx").option("table", table).load(str(folder)), read(spark, f"{folder}/*.docx")
    assert got.dtypes == want.dtypes and got.count() == want.count() > 0
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_private_footnotes(spark, folder):
    got = spark.read.format("docx").options(table="footnotes", private="true").load(f"file://{folder}/a.docx")
    assert sorted(r.kind for r in got.collect()) == ["private", "public", "summary"]


def test_conditions_choose_files_and_end_reading(spark, folder):
    rows = spark.read.format("docx").load(f"{folder}/*.docx")
    doc_id = spark.range(1).select(F.xxhash64(F.lit(f"file:{folder}/b.docx"))).first()[0]
    some = rows.where((F.col("doc_id") == doc_id) & (F.col("seq") <= 10) & F.col("is_centered"))
    assert [r.seq for r in some.orderBy("seq").collect()] == [0, 5, 10]
    assert rows.where(F.col("path").isin(f"file:{folder}/a.docx", "file:/none.docx")).count() == 4
    assert rows.where("path = 'file:/none.docx'").count() == 0
    reader = docx_source.DocxReader(rows.schema, {"path": str(folder)})
    left = list(reader.pushFilters([docx_source.EqualTo(("doc_id",), doc_id), docx_source.LessThan(("seq",), 7), docx_source.EqualTo(("text",), "x")]))
    assert [f.attribute for f in left] == [("text",)] and [p.path for p in reader.partitions()] == [f"file:{folder}/b.docx"]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 7


def test_unknown_table(spark, folder):
    with pytest.raises(Exception, match="table is one of"):
        spark.read.format("docx").option("table", "pictures").load(str(folder)).count()


def test_large_file_in_little_memory(spark, folder, tmp_path):
    """120 MB of XML with a table of 20 MB in it, a reader's process staying below 250 MB."""
    path = tmp_path / "large.docx"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z, z.open("word/document.xml", "w") as f:
        f.write(f"<w:document {W}><w:body>".encode())
        f.write(("<w:tbl>" + ("<w:tr><w:tc>" + para(run("na tabela " * 10)) + "</w:tc></w:tr>") * 100_000 + "</w:tbl>").encode())
        for k in range(100):
            f.write("".join(para(run(f"Art. {k} - " + "palavra " * 100)) for _ in range(1000)).encode())
        f.write(b"</w:body></w:document>")
    schema = spark.read.format("docx").load(str(folder)).schema.json()
    code = f"""
import resource, sys
sys.path.insert(0, {str(docx_source.__file__.rsplit('/lexflow/', 1)[0])!r})
from lexflow.sources import docx_source
from pyspark.sql.types import StructType
import json
schema = StructType.fromJson(json.loads({schema!r}))
reader = docx_source.DocxReader(schema, {{"path": {str(path)!r}}})
print(sum(b.num_rows for p in reader.partitions() for b in reader.read(p)), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    n, most = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert n == 100_000 and most < 250
