"""Results as files: pages, Markdown, JSON. Data columns are written by Spark, single files by the driver."""

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexflow.operators import checks


def inline_json(value) -> str:
    """JSON that can stand in a script element."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")).replace("</", "<\\/")


def template_parts(template: str) -> list[tuple[str, str]]:
    """The texts of a template, each with the name in double braces behind it; the last has none."""
    out = []
    while template:
        head, mark, rest = template.partition("{{")
        name, closing, tail = rest.partition("}}")
        if mark and closing:
            out.append((head, name))
            template = tail
        else:
            out.append((head + mark + rest, ""))
            break
    return out


def assemble(template: str, parts: dict[str, str]) -> str:
    """template with each {{name}} replaced by its part; a part isn't searched again."""
    return "".join(text + (parts.get(name, "{{" + name + "}}") if name else "") for text, name in template_parts(template))


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, a template for one, in any store that Spark reads."""
    return spark.read.text(path, wholetext=True).first()[0]


def write_text(path: str, text: str, spark: SparkSession | None = None) -> None:
    """A file that the driver writes: a local one, or with a session one in any store that Spark writes to."""
    if spark is None or "://" not in path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text, encoding="utf-8")
        return
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def write_dumps(folder: str, parts: dict[str, str], spark: SparkSession | None = None) -> None:
    """JSON texts for a look inside, a file a name, indented."""
    for name, text in parts.items():
        write_text(f"{folder}/{name}.json", json.dumps(json.loads(text), ensure_ascii=False, indent=2), spark)


def write_json_lines(df: DataFrame, path: str) -> None:
    """A frame as JSON lines, one folder; null fields are left out."""
    df.write.mode("overwrite").json(path)


def write_pages(df: DataFrame, path: str, column: str) -> None:
    """Rendered documents as text, a folder a document."""
    df.select("doc_id", F.col(column).alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path)


#: Rows of a table that people edit, at most.
EDITED = 100_000


def _beside(spark: SparkSession, path: str):
    """The table's store, and the paths of the table, of one that is about to take its place, and of one that has made room."""
    paths = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + end) for end in ("", ".new", ".old")]
    return paths[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), *paths


def _whole(store, path) -> bool:
    return store.exists(path) and any(x.getPath().getName() == "_SUCCESS" for x in store.listStatus(path))


def _moved(store, old, new) -> None:
    if not store.rename(old, new):
        raise OSError(f"{old} couldn't be renamed to {new}")


def _recovered(spark: SparkSession, path: str) -> None:
    """Ends what a save that was cut short had begun: a table that is missing is the new one if that is whole, else the old one."""
    store, table, new, old = _beside(spark, path)
    if not store.exists(table):
        if _whole(store, new):
            _moved(store, new, table)
        elif store.exists(old):
            _moved(store, old, table)
    if store.exists(table) and store.exists(old):
        store.delete(old, True)


def save_table(df: DataFrame, path: str) -> None:
    """Replaces a small table that one person edits: it is written beside the old one, which makes room when it is whole.

    At every step the old or the new table is there as a whole, and load_table finds it. Tables that several write
    at a time, markers for one, are logs (lexflow.sources.marker_log).
    """
    spark = df.sparkSession
    if df.limit(EDITED + 1).count() > EDITED:
        raise ValueError(f"tables of over {EDITED} rows aren't saved in one piece")
    _recovered(spark, path)
    df.coalesce(1).write.mode("overwrite").parquet(f"{path}.new")
    store, table, new, old = _beside(spark, path)
    if store.exists(table):
        _moved(store, table, old)
    _moved(store, new, table)
    store.delete(old, True)


def load_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that save_table wrote, with this schema; an empty one where there is none yet. One that can't be read is an error."""
    _recovered(spark, path)
    store, table, _, _ = _beside(spark, path)
    return spark.read.schema(schema).parquet(path) if store.exists(table) else spark.createDataFrame([], schema)


#: Titles of issue categories in a report. Fixed values.
CATEGORIES = {"ref_cruzada": "Referências cruzadas", "vide": "Vide", "formato": "Formato da planilha", "docx": "Documento"}


def report_lines(issues: DataFrame) -> DataFrame:
    """A report of all issues as lines (category_no, kind, place, message, line): by category how many of each severity, every issue, and the totals."""
    rows = checks.issue_listing(issues)
    title = F.col("category")
    for category, label in CATEGORIES.items():
        title = F.when(F.col("category") == category, label).otherwise(title)
    none = F.array().cast("array<bigint>")
    mark = F.concat(F.lit("  ["), "severity", F.lit("] "), "message", F.when(F.col("context") != "", F.concat(F.lit(" ("), "context", F.lit(")"))).otherwise(""))
    each = rows.select("category_no", F.lit(1).alias("kind"), "place", "message", mark.alias("line"))
    of = lambda severity: F.count_if(F.col("severity") == severity)
    some = lambda n, name: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {name}")))
    counts = F.concat_ws(", ", some(of("erro"), "erro"), some(of("aviso"), "aviso"))
    heads = rows.groupBy("category_no", "category").agg(counts.alias("counts")).select("category_no", F.lit(0).alias("kind"), none.alias("place"), F.lit("").alias("message"), F.concat(F.lit("== "), title, F.lit(": "), "counts").alias("line"))
    total = rows.agg(F.concat(F.lit("Total: "), counts).alias("line"), F.count("*").alias("n"))
    last = total.select(F.lit(99).alias("category_no"), F.lit(2).alias("kind"), none.alias("place"), F.lit("").alias("message"), F.when(F.col("n") > 0, F.col("line")).otherwise("Nenhum problema.").alias("line"))
    return heads.unionByName(each).unionByName(last)


def issue_report(issues: DataFrame) -> str:
    """The report of report_lines as one text, of a build whose findings the driver can hold."""
    return "".join(r["line"] + "\n" for r in report_lines(issues).orderBy("category_no", "kind", "place", "message").collect())


def lint_lines(lint: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """A report of the document lint as lines (code_no, code, doc_id, seq, k, line): totals, then each code with all that was found."""
    rows = checks.lint_listing(lint)
    place = lambda code_no, code, doc_id, seq, k: [code_no.alias("code_no"), code.alias("code"), doc_id.cast("long").alias("doc_id"), seq.cast("long").alias("seq"), F.lit(k).alias("k")]
    one = lambda x: F.lit(x)
    one_of_each = rows.select(F.lit(1).alias("found"), F.lit(0).alias("n")).unionByName(paragraphs.select(F.lit(0).alias("found"), F.lit(1).alias("n")))
    n = one_of_each.agg(F.coalesce(F.sum("found"), F.lit(0)).alias("found"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    first = n.select(*place(one(-1), one(""), one(-1), one(-1), 0), F.concat(F.lit("Parágrafos lidos: "), "n", F.lit(" | Problemas encontrados: "), "found").alias("line"))
    heads = rows.groupBy("code_no", "code", "label").agg(F.count("*").alias("n"))
    heads = heads.select(*place(F.col("code_no"), F.col("code"), one(-1), one(-1), 0), F.concat(F.lit("["), "code", F.lit("] "), "label", F.lit("  ("), "n", F.lit(" ocorrência"), F.when(F.col("n") == 1, "").otherwise("s"), F.lit(")")).alias("line"))
    parts = [("  Contexto : ", "context"), ("  Problema : ", "description"), ("  Texto    : ", "text")]
    each = None
    for k, (name, column) in enumerate(parts, 1):
        own = rows.select(*place(F.col("code_no"), F.col("code"), F.col("doc_id"), F.col("seq"), k), F.concat(F.lit(name), column).alias("line"))
        each = own if each is None else each.unionByName(own)
    return first.unionByName(heads).unionByName(each)


def lint_text(lint: DataFrame, paragraphs: DataFrame) -> str:
    """The report of lint_lines as one text."""
    return "".join(r["line"] + "\n" for r in lint_lines(lint, paragraphs).orderBy("code_no", "code", "doc_id", "seq", "k").collect())
