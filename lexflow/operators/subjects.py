"""The subject index: references in short notation, see-also lines, nested subjects, display."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexflow.functions.text import search_key, strip
from lexflow.session import stored

#: Notation of references. Fixed values.
PREFIXED = r"(?U)^([A-Z]{2,})\s*:\s*(.+)$"
HINT = r"(?U)\(([^)]+)\)\s*$"
RANGE = r"(?U)^(\d+)\s*[-–—]\s*(\d+)$"
ARTICLE_REF = r"^(?:ADT)?\d+[-A-Za-z]*$"
HINT_PART = r"(?U)\([^)]+\)\s*$"
NUMBERED, SHORT_NUMBERED = r"(?U)^[§Ss]\s*(\d+)$", r"(?iu)^p(\d+)$"


#: Numbers of a range that are made from one row.
PART = 1_000
#: Tasks that a sheet's rows are dealt out to at most. More would cost more to start than they save.
TASKS = 48


def normal_detail(raw: Column) -> Column:
    """A detail as cards name it: PU as §ú; §1, S1 and p1 as § 1º; the rest as it is."""
    raw = strip(raw)
    number = F.coalesce(F.nullif(F.regexp_extract(raw, NUMBERED, 1), F.lit("")), F.nullif(F.regexp_extract(raw, SHORT_NUMBERED, 1), F.lit("")))
    return F.when((F.upper(raw) == "PU") | (raw == "§ú"), "§ú").when(number.isNotNull(), F.concat(F.lit("§ "), number, F.lit("º"))).otherwise(raw)


def lines_of(text: Column) -> Column:
    """Stripped lines that aren't empty."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip), lambda x: x != "")


def dealt(rows: DataFrame) -> DataFrame:
    """A sheet's rows dealt out by row_no: a file of a few megabytes, which is one task, has a million rows to parse."""
    return rows.repartition(min(TASKS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "row_no")


def entries(rows: DataFrame) -> DataFrame:
    """Index entries of a sheet's rows (row_no, subject, sub_subject, devices, see_also, width): those with three cells and a subject."""
    rows = dealt(rows)
    text = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    kept = rows.where("width >= 3").select("row_no", text("subject").alias("subject"), text("sub_subject").alias("sub_subject"), text("devices").alias("devices"), lines_of(F.col("see_also")).alias("vides"))
    return kept.where("subject <> ''")


def laws(rows: DataFrame) -> DataFrame:
    """law_name, law_prefix of a sheet's rows (row_no, law_prefix, law_name); the last row of a name counts."""
    named = rows.select("row_no", strip(F.coalesce("law_name", F.lit(""))).alias("law_name"), strip(F.coalesce("law_prefix", F.lit(""))).alias("law_prefix")).where("law_name <> '' and law_prefix <> ''")
    return named.groupBy("law_name").agg(F.max_by("law_prefix", "row_no").alias("law_prefix"))


def device_lines(entries: DataFrame) -> DataFrame:
    """Each reference line of each entry, taken apart: line, law_prefix, hint, lo, hi, art, detail.

    Lines that are no range and name no article are dropped.
    """
    rows = entries.select("row_no", "subject", "sub_subject", F.posexplode(F.split("devices", "\n")).alias("line", "raw"))
    rows = rows.withColumn("raw", strip("raw")).where("raw <> ''")
    rows = rows.withColumns({"law_prefix": F.regexp_extract("raw", PREFIXED, 1), "body": F.when(F.col("raw").rlike(PREFIXED), strip(F.regexp_extract("raw", PREFIXED, 2))).otherwise(F.col("raw"))})
    rows = rows.withColumns({"hint": strip(F.regexp_extract("body", HINT, 1)), "body": F.when(F.col("body").rlike(HINT), strip(F.regexp_replace("body", HINT_PART, ""))).otherwise(F.col("body"))})
    parts = F.split("body", ",", 2)
    rows = rows.withColumns({"lo": F.regexp_extract("body", RANGE, 1).try_cast("long"), "hi": F.regexp_extract("body", RANGE, 2).try_cast("long"), "art": strip(parts[0]), "detail": F.when(F.size(parts) == 2, normal_detail(F.get(parts, 1))).otherwise("")})
    return rows.where(F.col("lo").isNotNull() | F.col("art").rlike(ARTICLE_REF)).drop("raw", "body")


def references(entries: DataFrame, lettered: DataFrame | None = None) -> DataFrame:
    """The references of each entry in order: row_no, subject, sub_subject, line, step, art, detail, law_prefix, hint.

    A range gives each of its numbers and, after a number, the lettered articles (art_number) of that number
    in any law, in their order; a range that runs down gives nothing.
    """
    lines = device_lines(entries)
    own = ["row_no", "subject", "sub_subject", "line", "law_prefix", "hint"]
    single = lines.where("lo is null").select(*own, F.lit(0).cast("long").alias("step"), F.lit("").alias("sub"), "art", "detail")
    parts = lines.where("lo <= hi").select(*own, "hi", F.explode(F.sequence("lo", "hi", F.lit(PART))).alias("lo"))  # a wide range is dealt out part by part
    numbers = parts.select(*own, F.explode(F.sequence("lo", F.least("hi", F.col("lo") + PART - 1))).alias("step"))
    plain = numbers.select(*own, "step", F.lit("").alias("sub"), F.col("step").cast("string").alias("art"), F.lit("").alias("detail"))
    out = single.unionByName(plain)
    if lettered is not None:
        known = lettered.select("art_number", F.regexp_extract("art_number", "^([0-9]+)-[A-Za-z]", 1).try_cast("long").alias("step")).where("step is not null").distinct()
        out = out.unionByName(numbers.join(known, "step").select(*own, "step", F.col("art_number").alias("sub"), F.col("art_number").alias("art"), F.lit("").alias("detail")))
    return out


def transitional_refs(refs: DataFrame, transitional: DataFrame) -> DataFrame:
    """refs, where a lettered article without law, known only as a transitional one (art_number ADT…), is that one."""
    known = transitional.select(F.expr("substring(art_number, 4)").alias("art"), F.col("art_number").alias("__adt")).where("__adt like 'ADT%-%'").distinct()
    rows = refs.join(known.withColumn("law_prefix", F.lit("")), ["art", "law_prefix"], "left")
    return rows.withColumn("art", F.coalesce("__adt", "art")).drop("__adt")


def nested_index(entries: DataFrame, refs: DataFrame) -> DataFrame:
    """subject, refs, vides, children (sub_subject, refs, vides): one row a subject, in the order of lower-case subjects.

    Empty lists are null, so JSON leaves them out.
    """
    ref = F.struct("line", "step", "sub", F.struct("art", "detail", F.nullif("law_prefix", F.lit("")).alias("law_prefix"), F.nullif("hint", F.lit("")).alias("hint")).alias("ref"))
    by_row = refs.groupBy("row_no").agg(F.transform(F.array_sort(F.collect_list(ref)), lambda x: x["ref"]).alias("refs"))
    rows = entries.join(by_row, "row_no", "left").withColumn("refs", F.coalesce("refs", F.array().cast(by_row.schema["refs"].dataType)))
    item = F.struct("row_no", "sub_subject", "refs", "vides")
    groups = rows.groupBy("subject").agg(F.array_sort(F.collect_list(item)).alias("items"), F.min("row_no").alias("first_row"))
    some = lambda a: F.when(F.size(a) > 0, a)
    direct, below = F.filter("items", lambda x: x["sub_subject"] == ""), F.filter("items", lambda x: x["sub_subject"] != "")
    child = F.transform(below, lambda x: F.struct(x["sub_subject"].alias("sub_subject"), x["refs"].alias("refs"), some(x["vides"]).alias("vides")))
    out = groups.select("subject", "first_row", some(F.flatten(F.transform(direct, lambda x: x["refs"]))).alias("refs"), some(F.flatten(F.transform(direct, lambda x: x["vides"]))).alias("vides"), some(child).alias("children"))
    return out.orderBy(F.lower("subject"), "first_row")


def all_refs(index: DataFrame) -> DataFrame:
    """subject, refs: a subject's own references, then those of its sub-subjects; repeated ones stay."""
    empty = F.array().cast(index.schema["refs"].dataType)
    below = F.flatten(F.transform(F.coalesce("children", F.array().cast(index.schema["children"].dataType)), lambda c: c["refs"]))
    return index.select("subject", F.concat(F.coalesce("refs", empty), below).alias("refs"))


def display_name(subject: Column, sub_subject: Column) -> Column:
    return F.when(sub_subject == "", subject).otherwise(F.concat(subject, F.lit(" — "), sub_subject))


def ref_label(law_prefix: Column, art: Column, detail: Column) -> Column:
    return F.concat(F.when(law_prefix != "", F.concat(law_prefix, F.lit(" "))).otherwise(""), F.lit("art. "), art, F.when(detail != "", F.concat(F.lit(", "), detail)).otherwise(""))


def summary_key(law_prefix: Column, art: Column) -> Column:
    return F.when(law_prefix != "", F.concat(law_prefix, F.lit(":"), art)).otherwise(art)


def summaries(articles: DataFrame) -> DataFrame:
    """key, summary of the articles that have one; the last of a key counts."""
    rows = articles.where("summary <> ''").select(summary_key(F.col("law_prefix"), F.col("art_number")).alias("key"), "summary", F.struct("doc_id", "seq").alias("at"))
    return rows.groupBy("key").agg(F.max_by("summary", "at").alias("summary"))


def formatted_refs(refs: DataFrame, summaries: DataFrame) -> DataFrame:
    """refs with label, and hint falling back on the article's summary."""
    rows = refs.withColumns({"label": ref_label(F.col("law_prefix"), F.col("art"), F.col("detail")), "key": summary_key(F.col("law_prefix"), F.col("art"))})
    return rows.join(summaries, "key", "left").withColumn("hint", F.coalesce(F.nullif("hint", F.lit("")), "summary", F.lit(""))).drop("key", "summary")


def see_also(entries: DataFrame) -> DataFrame:
    """Each see-also line: row_no, pos, target, label, subject_key; the key has no accents and no case."""
    rows = entries.select("row_no", F.posexplode("vides").alias("pos", "target"))
    cut = F.instr("target", "|") > 0
    left, right = strip(F.substring_index("target", "|", 1)), strip(F.expr("substring(target, instr(target, '|') + 1)"))
    both = cut & (right != "")
    label = F.when(both, F.concat(left, F.lit(" — "), right)).otherwise(F.col("target"))
    whole = F.when(cut, left).otherwise(F.col("target"))
    return rows.select("row_no", "pos", "target", label.alias("label"), F.when(both, F.concat(search_key(left), F.lit("|"), search_key(right))).otherwise(search_key(whole)).alias("subject_key"))


def see_also_targets(entries: DataFrame) -> DataFrame:
    """see_also with found: whether a subject or sub-subject has its key; a miss is a search for the first part."""
    keys = entries.select(search_key("subject").alias("subject_key")).union(entries.where("sub_subject <> ''").select(F.concat(search_key("subject"), F.lit("|"), search_key("sub_subject")))).distinct()
    return see_also(entries).join(keys.withColumn("found", F.lit(True)), "subject_key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def in_display_order(rows: DataFrame, column: str = "subject") -> DataFrame:
    """rows by column as a Portuguese dictionary would have them."""
    return rows.orderBy(F.collate(column, "pt"), column)


def display_places(rows: DataFrame, column: str = "subject") -> DataFrame:
    """rows, whose columns have no other name starting with __, with place: their number, from 1, in display order.

    Spark deals rows out by ranges of that order, as many as the session has shuffle partitions, and they are stored with
    their range's number; rows are numbered within ranges, and the counts of the ranges before are added.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.collate(column, "pt")
    dealt = stored(rows.repartitionByRange(parts, key, F.col(column)).withColumn("__range", F.spark_partition_id()), "places")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    counts = dealt.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(key, column))
    return dealt.withColumn("__own", own).join(F.broadcast(counts), "__range").withColumn("place", F.col("__before") + F.col("__own")).drop("__range", "__own", "__before")


def vide_display(vide: Column) -> Column:
    return F.replace(vide, F.lit("|"), F.lit(" — "))


def filter_index(index: DataFrame, query: str) -> DataFrame:
    """The subjects that have all of the query's words, whole; of others, those sub-subjects that have them.

    A subject without a hit of its own or below is left out.
    """
    from lexflow.operators.search import has_all

    if not query.strip():
        return index
    own = has_all(F.col("subject"), query)
    below = F.filter(F.coalesce("children", F.array().cast(index.schema["children"].dataType)), lambda c: has_all(c["sub_subject"], query))
    rows = index.withColumns({"__own": own, "__below": below})
    rows = rows.where(F.col("__own") | (F.size("__below") > 0))
    return rows.withColumn("children", F.when(F.col("__own"), F.col("children")).otherwise(F.col("__below"))).drop("__own", "__below")


def index_rows(entries: DataFrame, refs: DataFrame, summaries: DataFrame, query: str = "") -> DataFrame:
    """The subject index as a page shows it, a row a line: subject, row_no, at, kind, key, has_refs, html, hint.

    kind is subject, sub, ref or vide. A subject's line (row_no 0) comes first, then its own references and
    see-also lines, then each sub-subject with its own, in the sheet's order; key names (sub-)subjects without
    accents and case; has_refs says whether a click on one finds anything, below it included; hint is a reference's hint or its
    article's summary. With a query, subjects and sub-subjects are those of filter_index, and its words are marked.
    """
    from lexflow.functions.text import highlight, plain
    from lexflow.operators.search import has_all

    show = lambda c: highlight(c, [], plain(query).split())
    own = F.when(F.col("sub_subject") == "", 0).otherwise(F.col("row_no"))
    rows = entries.select("subject", "row_no", "sub_subject", "vides", own.alias("part"))
    if query.strip():
        hit = has_all(F.col("subject"), query)
        rows = rows.where(hit | ((F.col("part") > 0) & has_all(F.col("sub_subject"), query)))
        whole = entries.select("subject", "row_no", "sub_subject", "vides", own.alias("part")).where("part = 0").join(rows.select("subject").distinct(), "subject", "left_semi")
        rows = rows.where("part > 0").unionByName(whole)  # what stands right under a subject shows with any hit
    counts = refs.groupBy("row_no").agg(F.count("*").alias("n"))
    below = entries.select("subject", "row_no").join(counts, "row_no").select("subject").distinct().withColumn("__some", F.lit(True))
    key = search_key("subject")
    subjects = rows.select("subject").distinct().join(below, "subject", "left").select("subject", F.lit(0).alias("row_no"), F.lit(0).cast("long").alias("at"), F.lit("subject").alias("kind"), key.alias("key"), F.coalesce("__some", F.lit(False)).alias("has_refs"), show(F.col("subject")).alias("html"), F.lit("").alias("hint"))
    subs = rows.where("part > 0").join(counts, "row_no", "left").select("subject", "row_no", F.lit(0).cast("long").alias("at"), F.lit("sub").alias("kind"), F.concat(key, F.lit("|"), search_key("sub_subject")).alias("key"), F.col("n").isNotNull().alias("has_refs"), show(F.concat(F.lit("— "), F.col("sub_subject"))).alias("html"), F.lit("").alias("hint"))
    place = F.row_number().over(Window.partitionBy("row_no").orderBy("line", "step", "sub")).cast("long")
    lines = formatted_refs(refs.drop("subject", "sub_subject").withColumn("at", place), summaries).join(rows.select("subject", "row_no"), "row_no")
    lines = lines.select("subject", "row_no", "at", F.lit("ref").alias("kind"), F.lit("").alias("key"), F.lit(True).alias("has_refs"), show(F.col("label")).alias("html"), F.col("hint"))
    vides = see_also(rows).join(rows.select("subject", "row_no"), "row_no")
    vides = vides.select("subject", "row_no", (F.col("pos") + 1_000_000).cast("long").alias("at"), F.lit("vide").alias("kind"), F.col("subject_key").alias("key"), F.lit(False).alias("has_refs"), show(F.col("label")).alias("html"), F.lit("").alias("hint"))
    return subjects.unionByName(subs).unionByName(lines).unionByName(vides).withColumn("row_no", F.col("row_no").cast("long"))
