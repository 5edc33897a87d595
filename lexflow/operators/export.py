"""Statutes as JSON: sparse objects, an element a row."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexflow.operators.classify import full_text


def _true(flag: Column) -> Column:
    return F.when(flag, F.lit(True))


def run_object(r: Column) -> Column:
    """A run; flags that are false and links that are absent become null, which JSON leaves out."""
    text = lambda n: F.nullif(r[n], F.lit("")).alias(n)
    return F.struct(r["text"].alias("text"), _true(r["bold"]).alias("bold"), _true(r["italic"]).alias("italic"), _true(r["strike"]).alias("strike"), text("hyperlink_url"), text("hyperlink_anchor"))


def unit_object() -> Column:
    return F.struct("unit_type", "identifier", "uid", full_text(F.col("runs")).alias("text"), F.transform("runs", run_object).alias("runs"), "is_revoked", "is_old_version", "amendment_note", F.array().cast("array<string>").alias("children"))


def element_json(headings: DataFrame, articles: DataFrame, units: DataFrame) -> DataFrame:
    """doc_id, seq, json of each heading and article."""
    top = headings.select("doc_id", "seq", F.to_json(F.struct(F.lit("heading").alias("type"), "level", "text", "subtitle", "data_section")).alias("json"))
    of = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("seq", unit_object().alias("unit"))))), lambda x: x["unit"])
    units = units.select("doc_id", "block_id", "seq", "role", "unit_type", "identifier", "uid", "runs", "is_revoked", "is_old_version", "amendment_note").repartition("doc_id", "block_id")  # objects are larger than what they are made of
    parts = units.groupBy("doc_id", "block_id").agg(F.get(of("caput"), 0).alias("caput"), of("child").alias("children"), of("version").alias("all_versions"))
    rows = articles.join(parts, ["doc_id", "block_id"])
    some = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    body = F.to_json(F.struct(F.lit("article").alias("type"), "art_number", "is_adt", "is_revoked", "caput", "children", "all_versions", some("summary"), some("law_name"), some("law_prefix")))
    return top.unionByName(rows.select("doc_id", "seq", body.alias("json")))


def document_json(elements: DataFrame) -> DataFrame:
    """doc_id, json: {"elements": […]} of whole documents, for export."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "json"))), lambda x: x["json"]), ",")
    return elements.groupBy("doc_id").agg(F.concat(F.lit('{"elements":['), ordered, F.lit("]}")).alias("json"))


def structure_snapshot(articles: DataFrame, units: DataFrame) -> DataFrame:
    """What a structural snapshot compares: doc_id, art_number, is_adt, uids, counts and flags of each article."""
    parts = units.groupBy("doc_id", "block_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("role") != "version", F.struct("seq", "uid")))), lambda x: x["uid"]).alias("uids"), F.count_if(F.col("role") == "child").alias("children_count"), F.count_if(F.col("role") == "version").alias("versions_count")
    )
    return articles.join(parts, ["doc_id", "block_id"]).select("doc_id", "seq", "art_number", "is_adt", F.array_join("uids", " ").alias("uids"), "children_count", "versions_count", "is_revoked", (F.col("summary") != "").alias("has_summary"))


def snapshot_changes(old: DataFrame, new: DataFrame, key: str = "art_number") -> DataFrame:
    """key, change (added, removed) between two sets of articles."""
    gone = old.select(key).distinct().join(new.select(key), key, "left_anti").withColumn("change", F.lit("removed"))
    return gone.unionByName(new.select(key).distinct().join(old.select(key), key, "left_anti").withColumn("change", F.lit("added")))
