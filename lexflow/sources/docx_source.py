"""DOCX files as a Spark data source: spark.read.format("docx").option("table", …).load(path).

    register(spark)
    spark.read.format("docx").load("/mnt/laws/*.docx").where("seq < 100")

A partition is one part of one archive; its XML is read as a stream and leaves in Arrow batches, so a task holds a batch
of paragraphs, whatever the file's size. Conditions on path and doc_id choose files, and an upper bound of seq ends
the reading of each; Spark checks what is left. Files are opened by path in driver and workers, so the path has to be mounted on
all of them; for other stores lexflow.sources.ooxml reads the same tables from Spark's binary files.
"""

import glob
import itertools
import os

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexflow.schemas import FOOTNOTE_DEFS, PARAGRAPHS, STYLED
from lexflow.sources import ooxml

PREFIX = "doc_id long, path string, "
#: What a document's parts hold, by the name of the option table.
TABLES = {
    "paragraphs": (ooxml.paragraphs, PARAGRAPHS.removeprefix("doc_id long, ")),
    "lint": (ooxml.lint_paragraphs, ooxml.LINT),
    "styled": (ooxml.styled_paragraphs, STYLED),
    "footnotes": (ooxml.footnote_definitions, FOOTNOTE_DEFS),
}


def doc_id_of(path: str) -> int:
    """The hash that Spark's xxhash64 gives a path."""
    import xxhash

    n = xxhash.xxh64_intdigest(path.encode(), 42)
    return n - (1 << 64) if n >> 63 else n


class Docx(InputPartition):
    def __init__(self, file: str):
        super().__init__(file)
        self.path = f"file:{file}"


class DocxReader(DataSourceReader):
    def __init__(self, schema: StructType, options):
        self.schema, self.table, self.at = schema, options.get("table", "paragraphs").lower(), options["path"]
        self.private = options.get("private", "false").lower() == "true"
        self.paths, self.ids, self.stop = None, None, None
        if self.table not in TABLES:
            raise ValueError(f"table is one of {', '.join(TABLES)}")

    def pushFilters(self, filters):
        for f in filters:
            name = getattr(f, "attribute", (None,))[0]
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if name == "path" and values is not None:
                self.paths = values if self.paths is None else self.paths & values
            elif name == "doc_id" and values is not None:
                self.ids = values if self.ids is None else self.ids & values
            elif name == "seq" and isinstance(f, LessThan | LessThanOrEqual):
                stop = f.value + isinstance(f, LessThanOrEqual)
                self.stop = stop if self.stop is None else min(self.stop, stop)
            else:
                yield f

    def partitions(self):
        at = os.path.abspath(self.at.removeprefix("file://").removeprefix("file:"))
        files = sorted(glob.glob(os.path.join(at, "*.docx") if os.path.isdir(at) else at))
        found = [Docx(f) for f in files]
        if self.paths is not None:
            found = [p for p in found if p.path in self.paths]
        if self.ids is not None:
            found = [p for p in found if doc_id_of(p.path) in self.ids]
        return found or [Docx("")]

    def read(self, partition):
        if not partition.value:
            return
        parse = TABLES[self.table][0]
        schema, doc_id = to_arrow_schema(self.schema), doc_id_of(partition.path)
        with ooxml.archive(partition.value) as z:
            rows = parse(z, self.private) if self.table == "footnotes" else parse(z)
            if self.stop is not None:
                rows = itertools.takewhile(lambda r: r["seq"] < self.stop, rows)
            while batch := list(itertools.islice(rows, ooxml.BATCH)):
                yield pa.RecordBatch.from_pylist([{"doc_id": doc_id, "path": partition.path, **r} for r in batch], schema=schema)


class DocxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        table = self.options.get("table", "paragraphs").lower()
        if table not in TABLES:
            raise ValueError(f"table is one of {', '.join(TABLES)}")
        return PREFIX + TABLES[table][1]

    def reader(self, schema: StructType) -> DocxReader:
        return DocxReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Makes the format docx known to the session, and lets Spark hand conditions to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocxSource)
