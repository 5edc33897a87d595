"""Headings, articles and provisions from a stream of classified paragraphs.

What reads like a state machine over a document is windows over (doc_id, seq): the state that a row sees is
the last event before it. All windows of a document share one exchange and sort.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexflow.functions.text import strip
from lexflow.operators.classify import amendment_note, full_text, is_revoked, uid_suffix
from lexflow.schemas import HEADINGS, SUB_UNITS

#: Marks of laws and of transitional provisions, and the titles of the latter. Fixed values.
LAW = r"(?iuU)^NORMA:\s*(.+)"
TRANSITIONAL = r"(?iuU)ATO\s+D[AO]S?\s+DISPOSI[ÇC][ÕO]ES\s+TRANSIT[ÓO]RIAS"
GENERAL = r"(?iuU)DISPOSI[ÇC][ÕO]ES\s+GERAIS\s+E\s+TRANSIT[ÓO]RIAS"
TRANSITIONAL_TITLE, GENERAL_TITLE = "ATO DAS DISPOSIÇÕES TRANSITÓRIAS", "DISPOSIÇÕES GERAIS E TRANSITÓRIAS"



def _doc():
    return Window.partitionBy("doc_id").orderBy("seq")


def _so_far():
    return _doc().rowsBetween(Window.unboundedPreceding, 0)


def _before():
    return _doc().rowsBetween(Window.unboundedPreceding, -1)


def _last(value: Column, over) -> Column:
    return F.last(value, ignorenulls=True).over(over)


def _count(condition: Column, over) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).over(over)


def marks(classified: DataFrame) -> DataFrame:
    """classified with mark (a law or transitional provisions) and takes (a heading that takes a title line after it), by each row alone."""
    text, kind, centered = F.col("text"), F.col("unit_type"), F.coalesce("is_centered", F.lit(False)) & (F.col("unit_type") != "EMPTY")
    mark = F.when(centered & text.rlike(LAW), "NORMA").when(centered & text.rlike(TRANSITIONAL), "ADT").when(centered & text.rlike(GENERAL), "DGT")
    takes = kind.isin(*HEADINGS) & F.col("mark").isNull() & ~((kind == "CAPITULO") & text.contains("\n"))
    return classified.withColumn("mark", mark).withColumn("takes", takes)


def neighbours(marked: DataFrame) -> DataFrame:
    """marked with taken (the row before takes this line), next_type and next_text."""
    return marked.withColumns({"taken": (F.col("unit_type") == "SUBTITLE") & F.coalesce(F.lag("takes").over(_doc()), F.lit(False)), "next_type": F.lead("unit_type").over(_doc()), "next_text": F.lead("text").over(_doc())})


def events(classified: DataFrame, beside=neighbours) -> DataFrame:
    """Each paragraph's event: a law, a marker, a heading, an article, a sub-unit or nothing.

    A heading takes the title line right after it; only a chapter that has a line break in its own text
    does not. The line taken is no event, whatever it says.
    """
    rows = beside(marks(classified))
    event = F.when((F.col("unit_type") == "EMPTY") | F.col("taken"), None).otherwise(F.coalesce("mark", "unit_type"))
    return rows.withColumn("event", event).drop("mark", "taken")


def states(events: DataFrame) -> DataFrame:
    """Each event with the state before and at it: law, transitional part, open block, context, counters."""
    event = F.col("event")
    flush = event.isin("NORMA", "ADT", "DGT", *HEADINGS, "SUBTITLE")
    art = event == "ARTIGO"
    rows = events.withColumns(
        {
            "law_name": F.coalesce(_last(F.when(event == "NORMA", strip(F.regexp_extract("text", LAW, 1))), _so_far()), F.lit("")),
            "in_adt": F.coalesce(_last(F.when(event == "NORMA", False).when(event.isin("ADT", "DGT"), True), _so_far()), F.lit(False)),
            "is_art": F.coalesce(art, F.lit(False)),
            "is_key": F.coalesce(flush | art, F.lit(False)),
        }
    )
    rows = rows.withColumn("number", F.when(F.col("is_art"), F.concat(F.when(F.col("in_adt"), "ADT").otherwise(""), F.col("art_number"))))
    # before: '' after a heading, the article's number after an article
    rows = rows.withColumn("before", _last(F.when(F.col("is_key"), F.coalesce("number", F.lit(""))), _before()))
    rows = rows.withColumn("merges", F.col("is_art") & F.coalesce(F.col("before") == F.col("number"), F.lit(False)))
    rows = rows.withColumns(
        {
            "block_id": _count(F.col("is_art") & ~F.col("merges"), _so_far()),
            "art_run": _count(F.col("is_art"), _so_far()),
            "open": _last(F.when(F.col("is_key"), F.coalesce("number", F.lit(""))), _so_far()),
        }
    )
    kept = F.col("is_art") | (event.isin(*SUB_UNITS) & (F.coalesce("open", F.lit("")) != ""))
    return rows.withColumn("kept", F.coalesce(kept, F.lit(False)))


def sections() -> dict[str, Column]:
    """The rows that each section counter counts."""
    return {name: F.col("event").isin("SECAO", "SUBTITLE") if k == "SECAO" else F.col("event") == k for k, name in {"TITULO": "tit", "CAPITULO": "cap", "SECAO": "sec", "SUBSECAO": "subsec", "NORMA": "norma"}.items()}


def headings(events: DataFrame, counted: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, seq, level, text, subtitle, data_section of each heading; counted has the section counters where events have them already.

    Only headings count for a section, so no other row is exchanged.
    """
    event, text = F.col("event"), F.col("text")
    events = events.where(event.isin("NORMA", "ADT", "DGT", *HEADINGS, "SUBTITLE"))
    chapter_lines = (event == "CAPITULO") & text.contains("\n")
    lines = F.split(text, "\n")
    subtitle = F.when(chapter_lines, strip(F.array_join(F.slice(lines, 2, 1_000_000), "\n"))).when(event.isin(*HEADINGS) & (F.col("next_type") == "SUBTITLE"), F.col("next_text")).otherwise("")
    section = F.when(event == "ADT", "adt").when(event == "DGT", "dgt")
    for name, of in sections().items():
        n = _count(of, _so_far()) if counted is None else counted[name]
        section = section.when(of, F.concat(F.lit(name), n.cast("string")))
    return events.select(
        "doc_id",
        "seq",
        F.when(event.isin("NORMA", "ADT", "DGT"), "TITULO").when(event == "SUBTITLE", "SECAO").otherwise(event).alias("level"),
        F.when(event == "NORMA", strip(F.regexp_extract(text, LAW, 1))).when(event == "ADT", TRANSITIONAL_TITLE).when(event == "DGT", GENERAL_TITLE).when(chapter_lines, lines[0]).otherwise(text).alias("text"),
        subtitle.alias("subtitle"),
        section.alias("data_section"),
    )


def latest(rows: DataFrame) -> DataFrame:
    """rows with at0 to at3: depth and suffix of the latest row of an article's run at that depth or above it."""
    run = Window.partitionBy("doc_id", "art_run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({f"at{k}": F.last(F.when(F.col("depth") <= k, F.struct("depth", "suffix")), ignorenulls=True).over(run) for k in range(4)})


def base_uids(states: DataFrame, above=latest, every: bool = False) -> DataFrame:
    """Kept rows with base_uid: the article's uid, then the suffixes of what a provision stands under.

    A level's context is the suffix of the latest row at that level or above it, if it is at that level,
    since the last article row. With every, rows that aren't kept stay too: without depth and base_uid, so they count for no other.
    """
    kind = F.col("unit_type")
    level = F.when(kind.isin("PARAGRAFO_UNICO", "PARAGRAFO_NUM"), 0).when(kind == "INCISO", 1).when(kind == "ALINEA", 2).when(kind == "SUB_ALINEA", 3)
    rows = above((states if every else states.where("kept")).withColumns({"prefix": F.concat(F.lit("art"), F.col("open")), "suffix": uid_suffix(kind, F.col("text")), "depth": F.when(F.col("kept"), level)}))
    context = [F.when(F.col(f"at{k}.depth") == k, F.col(f"at{k}.suffix")).otherwise("") for k in range(4)]
    rows = rows.withColumn("context", F.concat(*context)).drop(*[f"at{k}" for k in range(4)])
    base = F.when(F.col("is_art"), F.col("prefix")).when(kind == "ITEM_NUM", F.concat("prefix", "context", "suffix")).when(kind == "OTHER", F.col("prefix")).otherwise(F.concat("prefix", "context"))
    return rows.withColumn("base_uid", F.when(F.col("kept"), base))


def unique_uids(rows: DataFrame) -> DataFrame:
    """uid: base_uid, with _2, _3 and so on for provisions whose base an earlier provision or article has."""
    same = Window.partitionBy("doc_id", "base_uid").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    k = F.coalesce(F.sum(F.when(~F.col("is_art"), 1).otherwise(0)).over(same), F.lit(0)) + F.coalesce(F.max(F.col("is_art").cast("int")).over(same), F.lit(0))
    return rows.withColumn("uid", F.when(F.col("is_art") | (k == 0), F.col("base_uid")).otherwise(F.concat("base_uid", F.lit("_"), (k + 1).cast("string"))))


def caputs(rows: DataFrame, states: DataFrame) -> DataFrame:
    """rows with caput_seq: the last article row of their block. states are what rows were made of."""
    return rows.withColumn("caput_seq", F.max(F.when(F.col("is_art"), F.col("seq"))).over(Window.partitionBy("doc_id", "block_id")))


def units(states: DataFrame, above=latest, unique=unique_uids, last=caputs, every: bool = False) -> DataFrame:
    """doc_id, block_id, seq, role (caput, child, version), type, identifier, uid, text, runs and flags of each provision.

    With every, the other rows are there too, without role and uid, and what headings, articles and footnotes are made of: while states aren't
    stored, they are partitioned by document, so all this is had without another exchange.
    """
    rows = last(unique(base_uids(states, above, every)), states)
    role = F.when(F.col("kept"), F.when(F.col("seq") < F.col("caput_seq"), "version").when(F.col("is_art"), "caput").otherwise("child"))
    whole = full_text(F.col("runs")) if "runs" in states.columns else F.col("text")
    return rows.select(
        "doc_id",
        "block_id",
        "seq",
        role.alias("role"),
        "unit_type",
        "identifier",
        "uid",
        "text",
        *([F.col("runs")] if "runs" in states.columns else []),
        (F.coalesce("has_strike", F.lit(False)) | (role == "version")).alias("is_old_version"),
        is_revoked(F.col("text")).alias("is_revoked"),
        F.when(F.col("kept"), amendment_note(whole)).alias("amendment_note"),
        "number",
        "law_name",
        "in_adt",
        *([F.col("footnote_ids")] if "footnote_ids" in states.columns else []),
        *(["event", "is_art", "merges", "kept", "next_type", "next_text"] if every else []),
    )


def articles(states: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """doc_id, block_id, seq, art_number, is_adt, law_name, summary of each article; rows of the same article are one.

    summaries has doc_id, seq and summary of article rows that have one; a block's is its last.
    """
    rows = states.where("is_art")
    if summaries is not None:
        rows = rows.join(summaries, ["doc_id", "seq"], "left")
    else:
        rows = rows.withColumn("summary", F.lit(None).cast("string"))
    last = F.max(F.when(F.coalesce("summary", F.lit("")) != "", F.struct("seq", "summary")))["summary"]
    first = F.min(F.struct("seq", "number", "in_adt", "law_name"))
    out = rows.groupBy("doc_id", "block_id").agg(first.alias("f"), F.count("*").alias("n_versions"), F.coalesce(last, F.lit("")).alias("summary"))
    return out.select("doc_id", "block_id", F.col("f.seq").alias("seq"), F.col("f.number").alias("art_number"), F.col("f.in_adt").alias("is_adt"), F.col("f.law_name").alias("law_name"), "summary", "n_versions")


def article_summaries(states: DataFrame, footnote_defs: DataFrame) -> DataFrame:
    """For article rows, the summary of the first footnote that is one."""
    notes = states.where("is_art").select("doc_id", "seq", F.posexplode("footnote_ids").alias("pos", "fn_id"))
    found = notes.join(footnote_defs.where("kind = 'summary'").select("fn_id", "summary"), "fn_id")
    return found.groupBy("doc_id", "seq").agg(F.min_by("summary", "pos").alias("summary"))


def numbers(notes: DataFrame) -> DataFrame:
    """notes with number: their place among those of their counter."""
    order = Window.partitionBy("doc_id", "is_private", "counter").orderBy("seq", "pos")
    return notes.withColumn("number", F.row_number().over(order))


def footnotes(states: DataFrame, footnote_defs: DataFrame, numbered=numbers) -> DataFrame:
    """doc_id, seq, pos, fn_id, is_private, number, block_id of the footnotes of kept rows.

    Public notes are numbered through the document. Private ones start anew with each block, but the
    article row that opens a block still counts with the block before.
    """
    kept = states.where("kept").select("doc_id", "seq", "is_art", "merges", "block_id", F.posexplode("footnote_ids").alias("pos", "fn_id"))
    rows = kept.join(footnote_defs.where("kind in ('public', 'private')"), "fn_id").withColumn("is_private", F.col("kind") == "private")
    group = F.when(F.col("is_private"), F.col("block_id") - F.when(F.col("is_art") & ~F.col("merges"), 1).otherwise(0)).otherwise(-1)
    return numbered(rows.withColumn("counter", group)).select("doc_id", "seq", "pos", "fn_id", "is_private", "number", "block_id")


def elements(headings: DataFrame, articles: DataFrame) -> DataFrame:
    """Headings and articles in one order: doc_id, seq, kind, key (section or block)."""
    a = headings.select("doc_id", "seq", F.lit("heading").alias("kind"), F.col("data_section").alias("key"))
    return a.unionByName(articles.select("doc_id", "seq", F.lit("article").alias("kind"), F.col("block_id").cast("string").alias("key")))
