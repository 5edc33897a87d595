"""Rows as one file, in order, without passing them through the driver's memory.

    with OneFile(spark, "/mnt/out/index.html") as f:
        f.text("<main>")
        f.rows(cards, "html", ["doc_id", "seq"], between="\\n")
        f.text("</main>")

Rows are dealt to tasks by ranges of their order and sorted there; each task writes a part of its own, and a commit lists the
parts of tasks that succeeded. When the file is closed its parts are copied one after another, block by block, to a new file
that takes the old one's place; a file that isn't closed leaves the old one as it was. Tasks and driver open parts
by path: a mounted folder, or a store that pyarrow knows by its URI.
"""

import json
import shutil
import uuid

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Bytes that are copied at a time.
COPY = 1 << 20
FORMAT = "textparts"


def store(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Part(WriterCommitMessage):
    """A task's part: its partition, its file, and what would stand before it if another part is before it."""

    def __init__(self, partition: int, name: str, between: str, rows: int):
        self.partition, self.name, self.between, self.rows = partition, name, between, rows


class PartsWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, piece: str):
        self.folder, self.piece = folder, piece

    def write(self, batches):
        """Writes value after value, each but the first with what stands between."""
        at = TaskContext.get().partitionId()
        name, first, n = f"part-{at:06d}-{uuid.uuid4().hex}", "", 0
        files, folder = store(self.folder)
        with files.open_output_stream(f"{folder}/{name}") as out:
            for batch in batches:
                for between, value in zip(batch.column("between").to_pylist(), batch.column("value").to_pylist(), strict=True):
                    if n:
                        out.write((between or "").encode())
                    else:
                        first = between or ""
                    out.write((value or "").encode())
                    n += 1
        return Part(at, name, first, n)

    def commit(self, messages):
        parts = [[m.name, m.between] for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition) if m.rows]
        files, folder = store(self.folder)
        with files.open_output_stream(f"{folder}/{self.piece}.json") as out:
            out.write(json.dumps(parts).encode())

    def abort(self, messages):
        files, folder = store(self.folder)
        for m in messages:
            if m is not None:
                files.delete_file(f"{folder}/{m.name}")


class Parts(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> PartsWriter:
        return PartsWriter(self.options["folder"], self.options["piece"])


class OneFile:
    """A file under way; leaving its block without an error puts it in place."""

    def __init__(self, spark: SparkSession, path: str):
        spark.dataSource.register(Parts)
        self.spark, self.path, self.folder, self.pieces = spark, path, f"{path}.parts-{uuid.uuid4().hex}", []
        files, folder = store(self.folder)
        files.create_dir(folder, recursive=True)

    def text(self, text: str) -> None:
        self.pieces.append(text)

    def rows(self, rows: DataFrame, value: str, order: list, between: str | Column = "") -> None:
        """The rows' values, a null one being empty, in the rising order of columns or expressions; between stands before each but the first."""
        piece = f"piece-{len(self.pieces):04d}"
        keys = [F.col(c) if isinstance(c, str) else c for c in order]
        own = rows.select(*[k.alias(f"__k{n}") for n, k in enumerate(keys)], F.lit(between).alias("between") if isinstance(between, str) else between.alias("between"), F.col(value).alias("value"))
        names = [f"__k{n}" for n in range(len(keys))]
        own.repartitionByRange(*names).sortWithinPartitions(*names).select("between", "value").write.format(FORMAT).options(folder=self.folder, piece=piece).mode("append").save()
        self.pieces.append(["", piece])

    def __enter__(self):
        return self

    def __exit__(self, kind, error, trace):
        files, folder = store(self.folder)
        if kind is None:
            to, path = store(self.path)
            new = f"{folder}/whole"
            with to.open_output_stream(new) as out:
                for piece in self.pieces:
                    if isinstance(piece, str):
                        out.write(piece.encode())
                        continue
                    with files.open_input_stream(f"{folder}/{piece[1]}.json") as f:
                        parts = json.loads(f.read())
                    for n, (name, between) in enumerate(parts):
                        out.write(between.encode() if n else b"")
                        with files.open_input_stream(f"{folder}/{name}") as part:
                            shutil.copyfileobj(part, out, COPY)
            to.move(new, path)
        files.delete_dir(folder)
