"""Markdown exports of documents, the subject index and reference lists."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexflow.functions.text import html_to_markdown, strip
from lexflow.operators.classify import full_text
from lexflow.operators.render import has, identifier_length, note_id, runs_from, wrap
from lexflow.operators.subjects import vide_display

HARD_SPACE = " "
MARKS = {"TITULO": "#", "CAPITULO": "##", "SECAO": "###", "SUBSECAO": "###"}


def markdown_run(r: Column, text: Column) -> Column:
    out = F.replace(text, F.lit(HARD_SPACE), F.lit(" "))
    out = F.when(has(r["hyperlink_url"]), F.concat(F.lit("["), out, F.lit("]("), r["hyperlink_url"], F.lit(")"))).otherwise(out)
    for flag, mark in (("strike", "~~"), ("italic", "*"), ("bold", "**")):
        out = wrap(out, r[flag], mark, mark)
    return out


def _body() -> Column:
    return runs_from(F.col("runs"), identifier_length(full_text(F.col("runs")), F.col("identifier")), markdown_run)


def footnote_markdown(note: Column) -> Column:
    texts = F.filter(F.transform(note["paragraphs"], lambda p: strip(runs_from(p["runs"], F.lit(0), markdown_run))), lambda t: t != "")
    return F.concat(F.lit("> **Nota "), note_id(note), F.lit(":** "), F.array_join(texts, " "), F.when(note["is_private"], " *(nota privada)*").otherwise(""))


def heading_markdown(headings: DataFrame) -> DataFrame:
    mark = F.lit("###")
    for level, m in MARKS.items():
        mark = F.when(F.col("level") == level, m).otherwise(mark)
    text = F.concat(mark, F.lit(" "), F.col("text"), F.when(has(F.col("subtitle")), F.concat(F.lit(" — "), F.col("subtitle"))).otherwise(""))
    return headings.select("doc_id", "seq", text.alias("markdown"))


def unit_markdown() -> Column:
    """The blocks of a provision: an old one's text and note, a current one's text and its footnotes."""
    kind = F.col("unit_type")
    indent = F.when(kind == "ALINEA", "  ").when(kind.isin("SUB_ALINEA", "ITEM_NUM"), "    ").otherwise("")
    body = _body()
    child = F.concat(indent, F.lit("**"), F.col("identifier"), F.lit("** — "), body)
    old = F.concat(F.lit("*[Versão supersedida]* "), F.replace(full_text(F.col("runs")), F.lit(HARD_SPACE), F.lit(" ")), F.when(has(F.col("amendment_note")), F.concat(F.lit(" *"), F.col("amendment_note"), F.lit("*"))).otherwise(""))
    none = F.array().cast("array<string>")
    notes = F.transform("notes", footnote_markdown)
    return F.when(F.col("old"), F.array(old)).when(F.col("role") == "caput", F.concat(F.when(body.rlike(r"(?U)\S"), F.array(body)).otherwise(none), notes)).otherwise(F.concat(F.array(child), notes))


def article_markdown(articles: DataFrame, units: DataFrame) -> DataFrame:
    """doc_id, seq, markdown of articles: caput and children in force, then all older versions under a rule."""
    rows = units.withColumn("old", (F.col("role") == "version") | ((F.col("role") == "child") & F.col("is_old_version")))
    rank = F.when(F.col("role") == "caput", 0).when(~F.col("old"), 1).when(F.col("role") == "version", 2).otherwise(3)
    parts = rows.groupBy("doc_id", "block_id").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "seq", unit_markdown().alias("blocks")))).alias("parts"))
    of = lambda f: F.flatten(F.transform(F.filter("parts", f), lambda x: x["blocks"]))
    new, old = of(lambda x: x["rank"] < 2), of(lambda x: x["rank"] >= 2)
    head = F.concat(F.lit("#### Art. "), F.when(F.col("law_prefix") != "", F.concat("law_prefix", F.lit(":"))).otherwise(""), F.col("art_number"), F.when(has(F.col("summary")), F.concat(F.lit(" — "), F.col("summary"))).otherwise(""))
    whole = F.concat(F.array(head), new, F.when(F.size(old) > 0, F.concat(F.array(F.lit("---"), F.lit("*Versões anteriores deste artigo:*")), old)).otherwise(F.array().cast("array<string>")))
    return articles.join(parts, ["doc_id", "block_id"]).select("doc_id", "seq", F.array_join(whole, "\n\n").alias("markdown"))


def document_markdown(headings: DataFrame, articles: DataFrame, units: DataFrame) -> DataFrame:
    """doc_id, markdown of whole documents. For export; a document is one row here."""
    rows = heading_markdown(headings).unionByName(article_markdown(articles, units))
    return rows.groupBy("doc_id").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "markdown"))), lambda x: x["markdown"]), "\n\n"), F.lit("\n")).alias("markdown"))


def ref_line(ref: Column) -> Column:
    law, detail, hint = ref["law_prefix"], ref["detail"], ref["hint"]
    return F.concat(F.lit("- Art. "), F.when(has(law), F.concat(law, F.lit(":"))).otherwise(""), ref["art"], F.when(has(detail), F.concat(F.lit(", "), detail)).otherwise(""), F.when(has(hint), F.concat(F.lit(" *("), hint, F.lit(")*"))).otherwise(""))


def _lists(refs: Column, vides: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(F.transform(refs, ref_line), none), F.coalesce(F.transform(vides, lambda v: F.concat(F.lit("\n*Vide: "), vide_display(v), F.lit("*"))), none))


def subject_markdown(index: DataFrame) -> DataFrame:
    """subject, markdown of each subject of a nested index."""
    none = F.array().cast("array<string>")
    below = F.coalesce(F.flatten(F.transform("children", lambda c: F.concat(F.array(F.concat(F.lit("\n### "), c["sub_subject"])), _lists(c["refs"], c["vides"])))), none)
    lines = F.concat(F.array(F.concat(F.lit("\n## "), F.col("subject"))), _lists(F.col("refs"), F.col("vides")), below)
    return index.select("subject", "first_row", F.array_join(lines, "\n").alias("markdown"))


def category_markdown(groups: DataFrame) -> DataFrame:
    """doc_id, category_no, markdown of each category of the reference lists."""
    none = F.array().cast("array<string>")
    entry = lambda e: F.concat(F.lit("- "), html_to_markdown(e["html"]), F.when(has(e["art_ref"]), F.concat(F.lit(" — Art. "), e["art_ref"])).otherwise(""))
    group = lambda g: F.concat(F.when(g["title"] != "", F.array(F.concat(F.lit("\n### "), g["title"]))).otherwise(none), F.transform(g["entries"], entry))
    lines = F.concat(F.array(F.concat(F.lit("\n## "), F.col("category"))), F.flatten(F.transform("groups", group)))
    return groups.select("doc_id", "category_no", F.array_join(lines, "\n").alias("markdown"))
