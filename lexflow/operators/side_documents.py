"""Reference lists and information pages, from styled paragraphs."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexflow.functions.text import escape_html, strip, tagless
from lexflow.operators.search import has_all
from lexflow.operators.targets import base_article

#: An article named at a text's end. Fixed value.
ARTICLE_AT_END = r"(?U)\s*[–—-]\s*Art\.\s*(.+)$"
GENERAL = "Geral"


def article_ref(text: Column) -> Column:
    """The article at the end of a text, without a final stop; null if there is none."""
    return F.when(text.rlike(ARTICLE_AT_END), F.rtrim(strip(F.regexp_extract(text, ARTICLE_AT_END, 1)), F.lit(".")))


def runs_html(runs: Column) -> Column:
    """Runs (text, bold) as HTML up to the article at the end; bold is kept."""
    whole = F.array_join(F.transform(runs, lambda r: r["text"]), "")
    cut = F.when(whole.rlike(ARTICLE_AT_END), F.regexp_instr(whole, F.lit(ARTICLE_AT_END)) - 1).otherwise(F.length(whole))
    piece = lambda t, bold: F.when(bold & (strip(t) != ""), F.concat(F.lit("<b>"), escape_html(t), F.lit("</b>"))).otherwise(escape_html(t))

    def add(a, r):
        keep = F.substring(r["text"], F.lit(1), F.greatest(F.lit(0), F.least(F.length(r["text"]), cut - a["at"])))
        return F.struct((a["at"] + F.length(r["text"])).alias("at"), F.concat(a["html"], piece(keep, r["bold"])).alias("html"))

    return strip(F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.lit("").alias("html")), add, lambda a: a["html"]))


def _placed(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs with text, with their kind and the category and group they stand in."""
    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    text = strip(F.col("text"))
    kind = F.when(F.coalesce("style", F.lit("")).startswith("Heading"), "category").when(F.col("all_bold") & (text == F.upper(text)), "group").otherwise("entry")
    rows = paragraphs.where("not is_empty").withColumns({"kind": kind, "label": text})
    count = lambda k: F.sum((F.col("kind") == k).cast("int")).over(w)
    rows = rows.withColumns({"category_no": count("category"), "group_no": count("group"), "category": F.coalesce(F.last(F.when(F.col("kind") == "category", F.col("label")), ignorenulls=True).over(w), F.lit(GENERAL))})
    mark = F.last(F.when(F.col("kind") != "entry", F.struct("kind", "label")), ignorenulls=True).over(w)
    return rows.withColumn("title", F.when(mark["kind"] == "group", mark["label"]).otherwise(""))


def reference_entries(paragraphs: DataFrame) -> DataFrame:
    """doc_id, seq, category_no, category, group_no, title, html, art_ref of each entry.

    A heading opens a category, a bold line in capitals a group; entries before either go to the general
    category and a group without title.
    """
    return _placed(paragraphs).where("kind = 'entry'").select("doc_id", "seq", "category_no", "category", "group_no", "title", runs_html(F.col("runs")).alias("html"), article_ref(F.col("text")).alias("art_ref"))


def reference_groups(paragraphs: DataFrame) -> DataFrame:
    """doc_id, category_no, category, groups (title, entries): nested, in order, empty ones included."""
    rows = _placed(paragraphs).select("doc_id", "seq", "kind", "category_no", "category", "group_no", "title", runs_html(F.col("runs")).alias("html"), article_ref(F.col("text")).alias("art_ref"))
    entry = F.when(F.col("kind") == "entry", F.struct("seq", "html", "art_ref"))
    groups = rows.groupBy("doc_id", "category_no", "category", F.when(F.col("kind") != "category", F.col("group_no")).alias("group_no"), F.when(F.col("kind") != "category", F.col("title")).alias("title")).agg(
        F.min("seq").alias("at"), F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["html"].alias("html"), e["art_ref"].alias("art_ref"))).alias("entries")
    )
    some = F.when(F.col("title").isNotNull(), F.struct("at", "title", "entries"))
    nested = F.transform(F.array_sort(F.collect_list(some)), lambda g: F.struct(g["title"].alias("title"), g["entries"].alias("entries")))
    return groups.groupBy("doc_id", "category_no", "category").agg(nested.alias("groups")).orderBy("doc_id", "category_no")


def filter_entries(entries: DataFrame, query: str) -> DataFrame:
    """Entries whose text or group title has all of the query's words."""
    return entries.where(has_all(tagless(F.col("html")), query) | has_all(F.col("title"), query))


def category_rows(entries: DataFrame, category_no: int, query: str = "") -> DataFrame:
    """One category's tab, a row a line: doc_id, group_no, seq, kind (title or entry), html, article.

    A group's title (seq of its first entry) comes before its entries; untitled groups have none. With a query, entries
    are those of filter_entries, and a title shows with any of its own. article is where an entry's link leads.
    """
    rows = entries.where(F.col("category_no") == category_no)
    shown = filter_entries(rows, query) if query.strip() else rows
    link = F.when(F.col("art_ref").isNotNull(), F.concat(F.lit(" — Art. "), "art_ref")).otherwise("")
    lines = shown.select("doc_id", "group_no", "seq", F.lit("entry").alias("kind"), F.concat("html", escape_html(link)).alias("html"), base_article(F.coalesce("art_ref", F.lit(""))).alias("article"))
    titles = shown.where("title <> ''").groupBy("doc_id", "group_no", "title").agg(F.min("seq").alias("seq")).select("doc_id", "group_no", "seq", F.lit("title").alias("kind"), escape_html(F.col("title")).alias("html"), F.lit("").alias("article"))
    return lines.unionByName(titles)


def information_html(paragraphs: DataFrame) -> DataFrame:
    """doc_id, html of information pages: headings as h3, other text as p."""
    rows = paragraphs.withColumn("text", strip(F.col("text"))).where("text <> ''")
    tag = F.when(F.coalesce("style", F.lit("")).startswith("Heading"), "h3").otherwise("p")
    line = F.concat(F.lit("<"), tag, F.lit(">"), escape_html(F.col("text")), F.lit("</"), tag, F.lit(">"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]), "\n").alias("html"))
