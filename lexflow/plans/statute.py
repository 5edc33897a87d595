"""From paragraphs to a resolved statute, as one lazy plan; and the build of all outputs from files."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexflow.operators import checks, classify, export, markdown, outline, render, segments, side_documents, structure, subjects, targets, versions
from lexflow.schemas import FOOTNOTE_DEFS, LAWS, STYLED, SUBJECT_ROWS
from lexflow.sources import ooxml, sinks
from lexflow.sources.config import Config
from lexflow.sources.one_file import OneFile
from lexflow.session import measured, stored


@dataclass
class Statute:
    headings: DataFrame
    articles: DataFrame
    units: DataFrame
    footnotes: DataFrame
    footnote_defs: DataFrame
    provisions: DataFrame
    """units without their notes, for what needs none."""


def build(paragraphs: DataFrame, footnote_defs: DataFrame | None = None, laws: DataFrame | None = None, prefix_uids: bool = True, segment: int | None = None) -> Statute:
    """The statute of a paragraph table: versions resolved, articles stamped with their laws.

    All windows are over (doc_id, seq), or over parts of a document, so the stream is exchanged once. Its rows with their states
    and provisions, and its articles are tables in the shared folder (see lexflow.session), as all else comes from them.
    prefix_uids puts a law's prefix into the uids of its units, as pages do and Markdown doesn't. With segment,
    documents may be longer than a task can hold: they are scanned in segments of so many rows.
    """
    spark = measured(paragraphs.sparkSession)
    defs = footnote_defs if footnote_defs is not None else spark.createDataFrame([], FOOTNOTE_DEFS)
    laws = laws if laws is not None else spark.createDataFrame([], LAWS)
    classified = classify.classify(paragraphs)
    if segment:
        states = segments.states(classified, segment)
        units = stored(versions.resolve(segments.units(states)), "units")
    else:
        rows = versions.resolve(structure.units(structure.states(structure.events(classified)), every=True))
        states = stored(targets.paths(targets.stamp_rows(rows, laws, prefix_uids)), "states")
        units = states.where("kept").drop("event", "is_art", "merges", "kept", "next_type", "next_text")
    articles = targets.stamp_articles(structure.articles(states, structure.article_summaries(states, defs)), laws)
    articles = stored(articles.join(versions.revoked_articles(units), ["doc_id", "block_id"]), "articles")
    if segment:
        units = targets.paths(targets.stamp_units(units, articles) if prefix_uids else units.join(articles.select("doc_id", "block_id", "law_prefix"), ["doc_id", "block_id"]))
    notes = segments.footnotes(states, defs, segment) if segment else structure.footnotes(states, defs)
    return Statute(segments.headings(states) if segment else structure.headings(states), articles, render.with_notes(units, notes, defs), notes, defs, units)


def cards(statute: Statute) -> DataFrame:
    """The table that searches read: doc_id, seq, kind, law_prefix, art_number, text, footnote_text and their keys."""
    from lexflow.functions.text import tagless
    from lexflow.operators.search import with_keys

    heads = statute.headings.select("doc_id", "seq", F.lit("heading").alias("kind"), F.lit("").alias("law_prefix"), F.lit("").alias("art_number"), F.concat_ws(" ", "text", F.nullif("subtitle", F.lit(""))).alias("text"), F.lit("").alias("footnote_text"))
    notes = F.array_join(F.flatten(F.transform("notes", lambda n: F.transform(n["paragraphs"], lambda p: classify.full_text(p["runs"])))), " ")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "own"))), lambda x: x["own"]), " ")
    own = statute.provisions.select("doc_id", "block_id", "seq", classify.full_text(F.col("runs")).alias("own"))
    parts = render.with_notes(own, statute.footnotes, statute.footnote_defs).withColumn("__notes", notes).groupBy("doc_id", "block_id").agg(body.alias("text"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "__notes"))), lambda x: x["__notes"]), " ").alias("footnote_text"))
    arts = statute.articles.join(parts, ["doc_id", "block_id"])
    label = F.concat_ws(" ", F.concat(F.lit("Art. "), F.col("art_number")), F.nullif("summary", F.lit("")), F.nullif("law_prefix", F.lit("")), tagless(F.col("text")))
    return with_keys(heads.unionByName(arts.select("doc_id", "seq", F.lit("article").alias("kind"), "law_prefix", "art_number", label.alias("text"), F.trim("footnote_text").alias("footnote_text"))))


def counts(statute: Statute) -> DataFrame:
    """what, n: how many headings, articles, older versions and articles of each law."""
    one = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    out = one(statute.headings, "headings").unionByName(one(statute.articles, "articles")).unionByName(one(statute.provisions.where("is_old_version"), "old_versions"))
    return out.unionByName(statute.articles.groupBy("law_name").agg(F.count("*").alias("n")).select(F.concat(F.lit("articles of "), "law_name").alias("what"), "n"))


TEMPLATE = """<!DOCTYPE html>
<html lang="pt-BR"><head><meta charset="utf-8"><title>{{title}}</title><style>{{style}}</style></head>
<body><main id="cards">
{{cards}}
</main><script>const SYSTEMATIC = {{systematic}}; const SUBJECTS = {{subjects}}; const REFERENCES = {{references}}; const SUMMARIES = {{summaries}}; const INFORMATION = {{information}};</script></body></html>
"""


def _optional(read, spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or none if the file is absent or can't be read."""
    from pyspark.errors import PySparkException

    try:
        if path:
            return stored(read(spark, path), "source")
    except PySparkException:
        pass
    return spark.createDataFrame([], f"doc_id long, path string, {schema}")


def _script(text):
    """JSON that can stand in a script element."""
    return F.replace(text, F.lit("</"), F.lit("<\\/"))


def json_pieces(data: dict[str, DataFrame]) -> dict:
    """How each part of a page's data is written to an open file: systematic, subjects, references, summaries, information."""

    def rows(f, name, value, order, *, begin="[", end="]", between=","):
        f.text(begin)
        f.rows(data[name].withColumn("__value", _script(value)), "__value", order, between=between)
        f.text(end)

    whole = lambda *columns: F.to_json(F.struct(*columns))
    inner = lambda text: F.expr(f"substring(to_json(array({text})), 3, length(to_json(array({text}))) - 4)")
    nodes = F.expr("substring(json, 2, length(json) - 2)")  # of the list of a document's outline
    subject = [c for c in data["subjects"].columns if c != "first_row"]
    return {
        "systematic": lambda f: rows(f, "systematic", nodes, ["doc_id"]),
        "subjects": lambda f: rows(f, "subjects", whole(*subject), [F.lower("subject"), "first_row"]),
        "references": lambda f: rows(f, "references", whole("category", "groups"), ["doc_id", "category_no"]),
        "summaries": lambda f: rows(f, "summaries", F.concat(F.lit('"'), inner("key"), F.lit('":"'), inner("summary"), F.lit('"')), ["key"], begin="{", end="}"),
        "information": lambda f: rows(f, "information", inner("html"), ["doc_id"], begin='"', end='"', between="\\n"),
    }


def write_page(spark: SparkSession, path: str, template: str, texts: dict[str, str], statute: Statute, pieces: dict) -> None:
    """A page: the template, its names in double braces replaced by texts, the statute's cards and pieces of data; other names stay."""
    cards = render.heading_cards(statute.headings).unionByName(render.article_cards(statute.articles, statute.units))
    with OneFile(spark, path) as f:
        for text, name in sinks.template_parts(template):
            f.text(text)
            if name in texts:
                f.text(texts[name])
            elif name == "cards":
                f.rows(cards, "html", ["doc_id", "seq"], between="\n")
            elif name in pieces:
                pieces[name](f)
            elif name:
                f.text("{{" + name + "}}")


def write_markdown(spark: SparkSession, path: str, statute: Statute) -> None:
    """All documents as Markdown, one after another."""
    lines = markdown.heading_markdown(statute.headings).unionByName(markdown.article_markdown(statute.articles, statute.units))
    first = lines.groupBy("doc_id").agg(F.min("seq").alias("__first"))
    with OneFile(spark, path) as f:
        f.rows(lines.join(first, "doc_id"), "markdown", ["doc_id", "seq"], between=F.when(F.col("seq") == F.col("__first"), "\n").otherwise("\n\n"))
        f.text("\n")


def write_json(spark: SparkSession, path: str, statute: Statute) -> None:
    """All documents as a JSON list of objects with their elements."""
    rows = export.element_json(statute.headings, statute.articles, statute.provisions)
    first = rows.groupBy("doc_id").agg(F.min("seq").alias("__first"))
    some = not rows.isEmpty()
    with OneFile(spark, path) as f:
        f.text('[{"elements":[' if some else "[")
        f.rows(rows.join(first, "doc_id"), "json", ["doc_id", "seq"], between=F.when(F.col("seq") == F.col("__first"), ']},{"elements":[').otherwise(","))
        f.text("]}]" if some else "]")


def run(spark: SparkSession, config: Config, *, strict: bool = False, template: str = TEMPLATE, style: str = "", template_file: str = "", style_file: str = "", script_file: str = "", debug_dir: str = "") -> int:
    """Builds page, Markdown, JSON and report of one statute from its files; 1 if it fails its checks.

    template, style and the script that a template may name come from files where these are given. debug_dir gets
    the statute, the indexes, the references and the findings as JSON. Files are written by tasks, part by part (lexflow.sources.one_file);
    the driver holds settings, templates and counts.

    Optional sources that are missing or broken are empty. The private page has the private notes too, and
    so has the Markdown.
    """
    paragraphs = stored(ooxml.read_docx(spark, config.docx).drop("path"), "paragraphs")
    rows = _optional(ooxml.read_subjects, spark, config.xlsx, SUBJECT_ROWS)
    laws = subjects.laws(_optional(ooxml.read_laws, spark, config.xlsx, ooxml.LAW_ROWS))
    groups = side_documents.reference_groups(_optional(ooxml.read_styled, spark, config.references, STYLED))
    information = side_documents.information_html(_optional(ooxml.read_styled, spark, config.information, STYLED))

    defs = {private: ooxml.read_footnotes(spark, config.docx, private).drop("doc_id", "path") for private in (False, True)}
    public = build(paragraphs, defs[False], laws)
    entries = subjects.entries(rows)
    lettered = public.articles.select("art_number").where("art_number rlike '^[0-9]+-[A-Z]'")
    refs = subjects.transitional_refs(subjects.references(entries, lettered), public.articles)
    index = stored(subjects.nested_index(entries, refs), "subjects")

    read = ooxml.read_lint(spark, config.docx)
    lint = checks.document_lint(read)
    prefixes = [r[0] for r in laws.select("law_prefix").distinct().collect()]  # a sheet's laws: part of the settings
    found = stored(checks.issues(checks.dangling_references(refs, public.articles), checks.dangling_see_also(entries), checks.sheet_faults(rows, prefixes), lint), "issues")
    outlines = outline.outline_json(outline.systematic_index(public.headings, public.articles))
    pieces = json_pieces({"systematic": outlines, "subjects": index, "references": groups, "summaries": subjects.summaries(public.articles), "information": information})
    texts = {"title": "Statute", "style": sinks.read_text(spark, style_file) if style_file else style, "script": sinks.read_text(spark, script_file) if script_file else ""}
    template = sinks.read_text(spark, template_file) if template_file else template
    if config.export_dir:
        write_page(spark, f"{config.export_dir}/index.html", template, texts, public, pieces)
    if config.private_dir:
        write_page(spark, f"{config.private_dir}/index.html", template, texts, build(paragraphs, defs[True], laws), pieces)
    if config.export_dir:
        write_markdown(spark, f"{config.export_dir}/statute.md", build(paragraphs, defs[True], laws, prefix_uids=False))
        if not index.isEmpty():
            with OneFile(spark, f"{config.export_dir}/subjects.md") as f:
                f.text("# Índice Remissivo\n")
                f.rows(markdown.subject_markdown(index), "markdown", [F.lower("subject"), "first_row"], between="\n")
                f.text("\n")
        if not groups.isEmpty():
            with OneFile(spark, f"{config.export_dir}/references.md") as f:
                f.text("# Referências\n")
                f.rows(markdown.category_markdown(groups), "markdown", ["doc_id", "category_no"], between="\n")
                f.text("\n")
        write_json(spark, f"{config.export_dir}/statute.json", public)
        with OneFile(spark, f"{config.export_dir}/report.txt") as f:
            f.rows(sinks.report_lines(found), "line", ["category_no", "kind", "place", "message"], between="\n")
            f.text("\n")
        with OneFile(spark, f"{config.export_dir}/lint.txt") as f:
            f.rows(sinks.lint_lines(lint, read), "line", ["code_no", "code", "doc_id", "seq", "k"], between="\n")
            f.text("\n")
    if debug_dir:
        write_json(spark, f"{debug_dir}/parsed_document.json", public)
        for name, piece in (("systematic_index", "systematic"), ("subject_index", "subjects"), ("references", "references")):
            with OneFile(spark, f"{debug_dir}/{name}.json") as f:
                pieces[piece](f)
        with OneFile(spark, f"{debug_dir}/validation_report.json") as f:
            f.text("[")
            f.rows(checks.issue_listing(found).withColumn("json", checks.issue_json()), "json", ["category_no", "place", "message"], between=",")
            f.text("]")
    return int(checks.failed(found, strict))
