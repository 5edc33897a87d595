"""From references to what they point at: laws, articles, provisions; and markers on provisions."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexflow.functions.text import compact_label


def stamp_articles(articles: DataFrame, laws: DataFrame) -> DataFrame:
    """articles with law_prefix, '' for laws that have none; laws is a small table and joins as such."""
    return articles.join(laws.select("law_name", "law_prefix"), "law_name", "left").withColumn("law_prefix", F.coalesce("law_prefix", F.lit("")))


def stamp_units(units: DataFrame, articles: DataFrame) -> DataFrame:
    """units with law_prefix, which is also put into their uids."""
    return _stamped(units.join(articles.select("doc_id", "block_id", "law_prefix"), ["doc_id", "block_id"], "left").withColumn("law_prefix", F.coalesce("law_prefix", F.lit(""))))


def stamp_rows(rows: DataFrame, laws: DataFrame, prefix_uids: bool = True) -> DataFrame:
    """What stamp_units does by a join with articles, by a window over each article's rows (is_art, law_name); prefix_uids says whether uids change."""
    law = F.min(F.when(F.col("is_art"), F.struct("seq", "law_name"))).over(Window.partitionBy("doc_id", "block_id"))["law_name"]
    found = F.broadcast(laws.select(F.col("law_name").alias("__law"), "law_prefix"))
    rows = rows.withColumn("__law", law).join(found, "__law", "left").drop("__law").withColumn("law_prefix", F.coalesce("law_prefix", F.lit("")))
    return _stamped(rows) if prefix_uids else rows


def _stamped(rows: DataFrame) -> DataFrame:
    return rows.withColumn("uid", F.when(F.col("law_prefix") != "", F.concat(F.lit("art"), F.col("law_prefix"), F.expr("substring(uid, 4)"))).otherwise(F.col("uid")))


def paths(units: DataFrame) -> DataFrame:
    """units with path, as cards show it: '§ 1º,I,b,2'; '' for other types, and none for old versions and caputs."""
    kind = F.col("unit_type")
    level = F.when(kind.isin("PARAGRAFO_UNICO", "PARAGRAFO_NUM"), 0).when(kind == "INCISO", 1).when(kind == "ALINEA", 2).when(kind.isin("SUB_ALINEA", "ITEM_NUM"), 3)
    label = F.when(kind == "PARAGRAFO_UNICO", "§ú").when(kind == "ALINEA", F.regexp_replace("identifier", r"\)$", "")).when(level == 3, F.regexp_extract("identifier", r"^(\d+)", 1)).otherwise(F.col("identifier"))
    counts = (F.col("role") == "child") & ~F.col("is_old_version")
    rows = units.withColumn("__step", F.when(counts & level.isNotNull(), F.struct(level.alias("depth"), label.alias("label"))))
    so_far = Window.partitionBy("doc_id", "block_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    parts = []
    for k in range(4):
        at = F.last(F.when(F.col("__step.depth") <= k, F.col("__step")), ignorenulls=True).over(so_far)
        parts.append(F.when(at["depth"] == k, at["label"]))
    return rows.withColumn("path", F.when(F.col("__step").isNotNull(), F.concat_ws(",", *parts)).otherwise("")).drop("__step")


def first_articles(articles: DataFrame) -> DataFrame:
    """For each key (law_prefix, art) that a reference may have, the article: of its law; without law the default law's, else any's; the first."""
    rows = articles.select("doc_id", "block_id", "seq", "art_number", "law_prefix")
    exact = rows.where("law_prefix <> ''").select("doc_id", F.col("law_prefix").alias("law"), F.col("art_number").alias("art"), "block_id", "seq", F.lit(0).alias("rank"))
    loose = rows.select("doc_id", F.lit("").alias("law"), F.col("art_number").alias("art"), "block_id", "seq", F.when(F.col("law_prefix") == "", 0).otherwise(1).alias("rank"))
    w = Window.partitionBy("doc_id", "law", "art").orderBy("rank", "seq")
    return exact.unionByName(loose).withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k", "rank")


def resolve_refs(refs: DataFrame, articles: DataFrame, units: DataFrame, fallback: bool = True) -> DataFrame:
    """refs (ref_id, doc_id, law_prefix, art, detail) with block_id, target (card, caput or unit) and target_seq.

    Without detail, or with one that no provision has, the target is the card; without fallback such a failed
    detail has no target. units have path, and their caput is a unit like others.
    """
    found = refs.join(first_articles(articles).withColumnRenamed("law", "law_prefix").withColumnRenamed("seq", "art_seq"), ["doc_id", "law_prefix", "art"])
    detail = F.trim("detail")
    live = units.where("not is_old_version or role = 'caput'").select("doc_id", "block_id", F.col("seq").alias("unit_seq"), "role", "path", "identifier")
    names = F.array("path", "identifier", F.when(F.col("identifier") == "Parágrafo único", "§ú"))
    names = F.filter(names, lambda x: x.isNotNull() & (x != "") & (F.lower(x) != "caput"))
    names = F.array_distinct(F.concat(names, F.when(F.col("role") == "caput", F.array(F.lit("caput"))).otherwise(F.array().cast("array<string>"))))
    named = live.select("doc_id", "block_id", F.explode(names).alias("name"), F.struct(F.when(F.col("role") == "caput", 0).otherwise(1).alias("late"), "unit_seq", "role").alias("hit"))
    hits = named.groupBy("doc_id", "block_id", "name").agg(F.min("hit").alias("hit"))
    out = found.withColumn("name", F.when(F.lower(detail) == "caput", "caput").otherwise(detail)).join(hits, ["doc_id", "block_id", "name"], "left")
    target = F.when(F.col("hit").isNotNull(), F.when(F.lower(detail) == "caput", "caput").otherwise("unit")).when((detail == "") | F.lit(fallback), "card")
    out = out.select("ref_id", "doc_id", "block_id", target.alias("target"), F.when(F.col("hit").isNotNull(), F.col("hit.unit_seq")).otherwise(F.col("art_seq")).alias("target_seq"))
    return out.where("target is not null")


def base_article(art_ref: Column) -> Column:
    """The article number that a reference's text begins with."""
    return F.trim(F.get(F.split(F.translate(art_ref, "º°ª", ""), r"[,\s]"), 0))


def marker_labels(markers: DataFrame, units: DataFrame, articles: DataFrame) -> DataFrame:
    """markers (doc_id, uid, …) with label, short: the article and path of that document's unit, or the uid if there is none.

    Markers without doc_id hold in all documents; their label is that of the first unit with the uid.
    """
    key = [c for c in ("doc_id", "uid") if c in markers.columns]
    art = articles.select("doc_id", "block_id", "art_number", F.col("law_prefix").alias("law"))
    rows = units.select("doc_id", "block_id", "seq", "uid", "identifier", "path").join(art, ["doc_id", "block_id"])
    law = F.when(F.col("law") != "", F.concat("law", F.lit(":"))).otherwise("")
    label = (
        F.when(F.col("path") != "", F.concat(law, F.lit("Art."), F.col("art_number"), F.lit(","), F.col("path")))
        .when(~F.col("identifier").startswith("Art."), F.concat(law, F.lit("Art."), F.col("art_number"), F.lit(","), F.col("identifier")))
        .otherwise(F.concat(law, F.col("identifier")))
    )
    named = rows.groupBy(*key).agg(F.min_by(label, F.struct("doc_id", "seq")).alias("label"))
    return markers.join(named, key, "left").withColumn("label", compact_label(F.coalesce("label", "uid")))


#: Colours that markers take in turn.
PALETTE = 8


def next_colour(markers: DataFrame, colours: int = PALETTE) -> int:
    """The least colour that no marker has, else the number of markers around the palette."""
    spark = markers.sparkSession
    row = spark.range(colours).select(F.col("id").cast("int").alias("colour")).join(markers.select("colour"), "colour", "left_anti").agg(F.min("colour")).first()
    return markers.count() % colours if row[0] is None else row[0]


def toggle_marker(markers: DataFrame, uid: str) -> DataFrame:
    """markers (position, uid, colour) without that of uid, or with a new one at the end."""
    if not markers.where(F.col("uid") == uid).isEmpty():
        return markers.where(F.col("uid") != uid)
    at = (markers.agg(F.max("position")).first()[0] or 0) + 1
    return markers.unionByName(markers.sparkSession.createDataFrame([(at, uid, next_colour(markers))], "position int, uid string, colour int"))


def clear_markers(markers: DataFrame) -> DataFrame:
    return markers.limit(0)


def by_depth(units: DataFrame) -> DataFrame:
    """Matched units in order of their paths' depth, the caput first."""
    depth = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", ",")))
    return units.withColumn("depth", depth).orderBy("depth", "seq")
