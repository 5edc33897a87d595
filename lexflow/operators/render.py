"""HTML cards: each provision is a projection, each card an ordered list of its provisions."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexflow.functions.text import escape_html
from lexflow.operators.classify import full_text

NOTES = "array<struct<number:int,is_private:boolean,paragraphs:array<struct<runs:array<struct<text:string,bold:boolean,italic:boolean,strike:boolean,hyperlink_url:string,hyperlink_anchor:string>>,indent:boolean>>>>"


def esc(text: Column) -> Column:
    return escape_html(text, quotes=True)


def has(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def wrap(text: Column, on: Column, before: str, after: str) -> Column:
    return F.when(F.coalesce(on, F.lit(False)), F.concat(F.lit(before), text, F.lit(after))).otherwise(text)


def identifier_length(text: Column, ident: Column) -> Column:
    """How many characters of a text its identifier and the separator after it take."""
    flexible = F.regexp_replace(ident, "([ºª°])", r"\\E\\.?\\Q$1")
    tries = []
    for name in (ident, flexible):
        for tail in (r"\E\s*[-–—.]\s*", r"\E\s+"):
            tries.append(F.regexp_substr(text, F.concat(F.lit(r"(?iuU)^\Q"), name, F.lit(tail))))
    return F.coalesce(F.length(F.coalesce(*tries)), F.length(ident))


def runs_from(runs: Column, skip: Column, piece) -> Column:
    """The runs' text after skip characters, each run as piece(run, text) renders it."""

    def add(a, r):
        size = F.length(r["text"])
        text = F.substr(r["text"], a["skip"] + 1)
        return F.when(a["skip"] >= size, F.struct((a["skip"] - size).alias("skip"), a["out"].alias("out"))).otherwise(F.struct(F.lit(0).alias("skip"), F.concat(a["out"], piece(r, text)).alias("out")))

    return F.aggregate(runs, F.struct(skip.cast("int").alias("skip"), F.lit("").alias("out")), add, lambda a: a["out"])


def html_run(anchors: bool):
    """A run as HTML: link, then strike, bold and italic around it; anchors says whether inner links count."""

    def piece(r, text):
        out = esc(text)
        link = F.when(has(r["hyperlink_url"]), F.concat(F.lit('<a href="'), esc(r["hyperlink_url"]), F.lit('" target="_blank" rel="noopener">'), out, F.lit("</a>")))
        if anchors:
            link = link.when(has(r["hyperlink_anchor"]), F.concat(F.lit('<a href="#'), esc(r["hyperlink_anchor"]), F.lit('" class="internal-ref">'), out, F.lit("</a>")))
        out = link.otherwise(out)
        for flag, tag in (("strike", "s"), ("bold", "strong"), ("italic", "em")):
            out = wrap(out, r[flag], f"<{tag}>", f"</{tag}>")
        return out

    return piece


def all_runs(runs: Column, piece) -> Column:
    return F.array_join(F.transform(runs, lambda r: piece(r, r["text"])), "")


def note_id(note: Column) -> Column:
    return F.concat(F.when(note["is_private"], "b").otherwise(""), note["number"].cast("string"))


def footnote_html(note: Column) -> Column:
    """A footnote's box: indented paragraphs in a block, line breaks between those of one kind."""

    def add(a, p):
        text = F.replace(all_runs(p["runs"], html_run(False)), F.lit("\n"), F.lit("<br>"))
        closes, opens = ~p["indent"] & a["inside"], p["indent"] & ~a["inside"]
        turn = F.when(closes, "</div>").when(opens, '<div class="fn-indent">').otherwise("")
        content = a["content"] & ~closes & ~opens
        blank = ~text.rlike(r"(?U)\S")
        return F.struct(
            F.concat(a["out"], turn, F.when(blank, "<br>").otherwise(F.concat(F.when(content, "<br>").otherwise(""), text))).alias("out"),
            p["indent"].alias("inside"),
            (content | ~blank).alias("content"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("inside"), F.lit(False).alias("content"))
    body = F.aggregate(note["paragraphs"], start, add, lambda a: F.concat(a["out"], F.when(a["inside"], "</div>").otherwise("")))
    return F.concat(
        F.lit('    <div class="footnote-box" data-note="'), note_id(note), F.lit('">\n      <button class="footnote-close">&times;</button>\n      <strong>Nota '), note_id(note), F.lit(":</strong> "), body, F.lit("\n    </div>")
    )


def indent_path(art_number: Column, path: Column) -> Column:
    """Hints of what a deep provision stands under, a column for each level."""
    above = F.slice(F.split(path, ","), F.lit(1), F.size(F.split(path, ",")) - 1)
    labels = F.concat(F.array(F.regexp_replace(art_number, "^ADT", "")), F.transform(above, lambda s: F.regexp_replace(s, r"§\s*(\d+)º", "§$1")))
    span = F.transform(labels, lambda s, k: F.when((k > 0) | (s != ""), F.concat(F.lit('<span class="indent-path" style="--col:'), k.cast("string"), F.lit('">'), esc(s), F.lit("</span>"))).otherwise(""))
    return F.array_join(span, "")


def paragraph_html(with_notes: bool = True) -> Column:
    """A current provision (role, uid, identifier, path, art_number, runs, notes) as a paragraph."""
    caput, path = F.col("role") == "caput", F.col("path")
    depth = F.when(path == "", 1).otherwise(F.size(F.split(path, ",")))
    attrs = F.when(caput, "").otherwise(F.concat(F.lit(' class="art-para"'), F.when(depth > 1, F.concat(F.lit(' style="--depth:'), depth.cast("string"), F.lit('"'))).otherwise("")))
    unit = F.concat(F.lit('<span class="unit-id" data-uid="'), esc(F.col("uid")), F.lit('"'), F.when(path != "", F.concat(F.lit(' data-path="'), esc(path), F.lit('"'))).otherwise(""), F.lit(">"), esc(F.col("identifier")), F.lit("</span>"))
    body = runs_from(F.col("runs"), identifier_length(full_text(F.col("runs")), F.col("identifier")), html_run(True))
    sup = F.array_join(F.transform("notes", lambda n: F.concat(F.lit('<sup class="footnote-ref" data-note="'), note_id(n), F.lit('">['), note_id(n), F.lit("]</sup>"))), "")
    boxes = F.array_join(F.transform("notes", lambda n: F.concat(F.lit("\n"), footnote_html(n))), "") if with_notes else F.lit("")
    hints = F.when(~caput & (depth >= 2) & (path != ""), indent_path(F.col("art_number"), path)).otherwise("")
    return F.concat(F.lit("    <p"), attrs, F.lit(">"), hints, unit, F.lit(" — "), body, sup, F.lit("</p>"), boxes)


def old_version_html() -> Column:
    """An old version: its text, the note on its amendment, and its identifier for pairing."""
    text = full_text(F.col("runs"))
    ident = F.trim(F.regexp_extract(text, r"(?U)^(.+?)\s+[-–—]\s", 1))
    note = F.when(has(F.col("amendment_note")), F.concat(F.lit(' <span class="amendment-note">'), esc(F.col("amendment_note")), F.lit("</span>"))).otherwise("")
    kind = F.when(F.col("role") == "child", "old-version art-para").otherwise("old-version")
    return F.concat(F.lit('    <p class="'), kind, F.lit('"'), F.when(ident != "", F.concat(F.lit(' data-ident="'), esc(ident), F.lit('"'))).otherwise(""), F.lit(">"), esc(text), note, F.lit("</p>"))


#: Classes of heading cards by level. Fixed values.
LEVEL_CLASS = {"TITULO": "nivel-titulo", "CAPITULO": "nivel-capitulo", "SECAO": "nivel-secao"}


def heading_cards(headings: DataFrame) -> DataFrame:
    """doc_id, seq, html of headings."""
    kind = F.when(F.col("data_section").startswith("norma"), "nivel-norma")
    for level, name in LEVEL_CLASS.items():
        kind = kind.when(F.col("level") == level, name)
    sub = F.when(has(F.col("subtitle")), F.concat(F.lit("<br>"), esc(F.col("subtitle")))).otherwise("")
    html = F.concat(F.lit('  <div class="card card-titulo '), kind.otherwise("nivel-subsecao"), F.lit('" data-section="'), esc(F.col("data_section")), F.lit('">'), esc(F.col("text")), sub, F.lit("</div>"))
    return headings.select("doc_id", "seq", html.alias("html"))


def article_cards(articles: DataFrame, units: DataFrame, with_notes: bool = True) -> DataFrame:
    """doc_id, seq, html of articles: versions, caput, then children in order.

    articles have law_prefix, summary and is_revoked; units have path and notes.
    """
    rows = units.join(articles.select("doc_id", "block_id", "art_number"), ["doc_id", "block_id"])
    rank = F.when(F.col("role") == "version", 0).when(F.col("role") == "caput", 1).otherwise(2)
    old = (F.col("role") == "version") | ((F.col("role") == "child") & F.col("is_old_version"))
    line = F.when(old, old_version_html()).otherwise(paragraph_html(with_notes))
    lines = rows.groupBy("doc_id", "block_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "seq", line.alias("html")))), lambda x: x["html"]).alias("lines"))
    number, law, summary = esc(F.col("art_number")), F.col("law_prefix"), F.col("summary")
    top = F.concat(F.lit('  <div class="card card-artigo'), F.when(F.col("is_revoked"), " revoked").otherwise(""), F.lit('" data-art="'), number, F.lit('"'), F.when(law != "", F.concat(F.lit(' data-law="'), esc(law), F.lit('"'))).otherwise(""), F.lit(">"))
    label = F.concat(F.lit('    <span class="art-compact-label">Art. '), number, F.when(law == "ADT", " ADT").otherwise(""), F.lit("</span>"))
    parts = F.concat(
        F.array(top, label),
        F.when(has(summary), F.array(F.concat(F.lit('    <span class="art-summary">'), esc(summary), F.lit("</span>")))).otherwise(F.array().cast("array<string>")),
        F.when(law != "", F.array(F.concat(F.lit('    <span class="law-badge">'), esc(law), F.lit("</span>")))).otherwise(F.array().cast("array<string>")),
        F.col("lines"),
        F.array(F.lit("  </div>")),
    )
    return articles.join(lines, ["doc_id", "block_id"]).select("doc_id", "seq", F.array_join(parts, "\n").alias("html"))


def document_html(headings: DataFrame, articles: DataFrame, units: DataFrame) -> DataFrame:
    """doc_id, html: all cards of a document in order. For export; a document is one row here."""
    cards = heading_cards(headings).unionByName(article_cards(articles, units))
    return cards.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "html"))), lambda x: x["html"]), "\n").alias("html"))


def with_notes(units: DataFrame, footnotes: DataFrame, footnote_defs: DataFrame) -> DataFrame:
    """units with notes: their footnotes' numbers and paragraphs, in order.

    Both are dealt out by article and meet there, so that what joins or groups units by article needs no other exchange of them.
    """
    rows = footnotes.join(footnote_defs.select("fn_id", "paragraphs"), "fn_id")
    notes = rows.groupBy("doc_id", "block_id", "seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "number", "is_private", "paragraphs"))), lambda x: F.struct(x["number"].alias("number"), x["is_private"].alias("is_private"), x["paragraphs"].alias("paragraphs"))).alias("notes"))
    both = units.withColumn("__unit", F.lit(True)).unionByName(notes.withColumn("notes", F.col("notes").cast(NOTES)), allowMissingColumns=True).repartition("doc_id", "block_id")
    same = Window.partitionBy("doc_id", "block_id", "seq")
    return both.withColumn("notes", F.coalesce(F.first("notes", ignorenulls=True).over(same), F.array().cast(NOTES))).where("__unit").drop("__unit")
