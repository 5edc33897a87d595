"""A statute, its footnotes, its laws and a subject sheet, derived from the order tables by plain SQL.

The driver's tables hold no statute text, so queries run on these views. The SQL is the same for Spark and for
the SQL that queries are checked with; {orders}, {lineitem} and {part} stand for the tables.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexflow.schemas import RUNS
from lexflow.session import measured

#: Orders that make a document: documents keep their size as tables grow, and there are more of them.
SIZE = 256

STATUTE_SQL = """
WITH o AS (
  SELECT CAST(floor(o_orderkey / 256) AS BIGINT) AS doc_id, o_orderkey % 256 AS k, o_orderkey, o_orderstatus, o_orderpriority, o_custkey
  FROM {orders}),
l AS (
  SELECT o.doc_id, o.k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS rn,
         l_linenumber AS n, CAST(l_quantity AS BIGINT) AS q, l_returnflag AS f, l_linestatus AS s, l_partkey AS p
  FROM {lineitem} JOIN o ON l_orderkey = o.o_orderkey),
r AS (
  SELECT doc_id, k, 0 AS kind, 0 AS rn, 'NORMA: Lei ' || CAST(CAST(floor(k / 40) AS BIGINT) % 3 AS STRING) AS text,
         true AS is_centered, false AS has_strike, 0 AS indent_left, CAST(NULL AS BIGINT) AS fn_id
  FROM o WHERE k % 40 = 5
  UNION ALL SELECT doc_id, k, 1, 0, 'ATO DAS DISPOSIÇÕES TRANSITÓRIAS', true, false, 0, NULL FROM o WHERE k % 40 = 30
  UNION ALL SELECT doc_id, k, 2, 0, CASE CAST(floor(k / 5) AS BIGINT) % 4 WHEN 0 THEN 'TÍTULO ' WHEN 1 THEN 'CAPÍTULO ' WHEN 2 THEN 'SEÇÃO ' ELSE 'SUBSEÇÃO ' END || CAST(k AS STRING), true, false, 0, NULL FROM o WHERE k % 5 = 0
  UNION ALL SELECT doc_id, k, 3, 0, 'DA ' || o_orderpriority, true, false, 0, NULL FROM o WHERE k % 10 = 0 OR k % 35 = 7
  UNION ALL SELECT doc_id, k, kind, 0,
         'Art. ' || CAST(k % 50 + 1 AS STRING) || CASE WHEN k % 50 < 9 AND k % 11 <> 4 THEN 'º' ELSE '' END || CASE WHEN k % 7 = 3 THEN '-A' ELSE '' END || ' - ' ||
         CASE WHEN kind = 4 THEN 'old ' ELSE '' END || o_orderpriority || CASE WHEN o_orderstatus = 'P' THEN ' (Revogado pela Res. 1)' ELSE '' END,
         false, kind = 4, 0, CASE WHEN k % 4 = 1 THEN o_custkey % 97 END
  FROM o, (SELECT 4 AS kind UNION ALL SELECT 5) t WHERE kind = 5 OR (o_orderstatus = 'F' AND k % 3 = 0)
  UNION ALL SELECT doc_id, k, 6, rn,
         CASE WHEN q = 50 THEN ' ' WHEN q = 49 THEN 'Texto ' || f WHEN n = 1 AND f = 'N' AND q % 2 = 0 THEN 'Parágrafo único - ' || f
              ELSE CASE n WHEN 1 THEN '§ 1º - ' WHEN 2 THEN 'I - ' WHEN 3 THEN 'a) ' WHEN 4 THEN 'II - ' WHEN 5 THEN 'b) ' WHEN 6 THEN '1) ' ELSE '2 - ' END || f END ||
         CASE WHEN s = 'F' AND q < 49 THEN ' (Redação dada pela Res. 2)' ELSE '' END,
         false, f = 'R', CASE WHEN n = 6 THEN 700 ELSE 0 END, CASE WHEN q % 6 = 0 THEN p % 97 END
  FROM l)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, kind, rn) AS BIGINT) AS seq, text, is_centered, has_strike, indent_left, fn_id FROM r
"""

SUBJECT_SQL = """
SELECT p_partkey AS row_no, p_brand AS subject, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS sub_subject,
       CASE p_partkey % 8
         WHEN 0 THEN CAST(p_size AS STRING) || '-' || CAST(p_size + 3 AS STRING)
         WHEN 1 THEN CAST(p_size AS STRING) || ',II' || chr(10) || 'LO:' || CAST(p_size AS STRING)
         WHEN 2 THEN CAST(p_size AS STRING) || ',§1(' || p_name || ')'
         WHEN 3 THEN 'LO:' || CAST(p_size AS STRING) || ',PU'
         WHEN 4 THEN CAST(p_size + 5 AS STRING) || '-' || CAST(p_size AS STRING)
         WHEN 5 THEN CAST(p_size + 30 AS STRING) || '-A' || chr(10) || 'CF: ' || CAST(p_size AS STRING) || ', I,a'
         WHEN 6 THEN 'art ' || CAST(p_size AS STRING) || chr(10) || CAST(p_size AS STRING) || ',I,II'
         ELSE CAST(p_size AS STRING) || ',caput' END AS devices,
       CASE p_partkey % 5 WHEN 0 THEN p_brand || '|' || p_type WHEN 1 THEN 'Brand#' || CAST(p_size AS STRING) WHEN 2 THEN p_brand || '|' || chr(10) || lower(p_brand) WHEN 3 THEN p_brand || '|a|b' ELSE '' END AS see_also
FROM {part}
"""

#: The sheet with some wide ranges more.
WIDE_SQL = """
SELECT * FROM ({sheet})
UNION ALL SELECT 10000000 + p_partkey, p_brand, '', CASE p_partkey % 4 WHEN 0 THEN '1-3000000000' WHEN 1 THEN 'LO:' || CAST(p_size AS STRING) || '-4000000000' WHEN 2 THEN 'XX:7-3000000000' ELSE '45-' || CAST(45 + p_size AS STRING) END, ''
FROM {part} WHERE p_partkey % 5 = 1
"""

#: What kind a footnote is; those without are of no kind and no definition.
FOOTNOTE_KIND = "CASE WHEN fn_id % 5 = 0 THEN 'summary' WHEN fn_id % 5 = 1 THEN 'private' WHEN fn_id % 7 <> 0 THEN 'public' END"

LAWS_SQL = "SELECT * FROM (VALUES ('Lei 1', 'LO'), ('Lei 2', 'CF')) t(law_name, law_prefix)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return measured(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: All documents as one: a document of the view has less than 4,096 paragraphs.
WHOLE_SQL = "SELECT CAST(0 AS BIGINT) AS doc_id, doc_id * 4096 + seq AS seq, text, is_centered, has_strike, indent_left, fn_id FROM ({statute})"


#: The statute with lines that a lint finds fault with, and romans written with a small l.
ODD_SQL = """
SELECT doc_id, seq * 4 AS seq, text, is_centered, has_strike, indent_left, fn_id FROM ({statute})
UNION ALL SELECT doc_id, seq * 4 + 1, CASE seq % 7 WHEN 0 THEN 'Art. sem número ' || CAST(seq AS STRING) WHEN 1 THEN '§ sem número' WHEN 2 THEN 'l - minúsculo' WHEN 3 THEN 'lV – romano'
  WHEN 4 THEN 's 12 solto' WHEN 5 THEN 'lI— junto' ELSE 'Art. 3 - ' || repeat('sem marca ', 15) || '.' END, false, false, 0, CAST(NULL AS BIGINT)
FROM ({statute}) WHERE seq % 11 = 0
"""

#: A later edition: of every third document some lines are gone and some have a word more.
EDITION_SQL = """
SELECT doc_id, seq, CASE WHEN doc_id % 3 = 0 AND seq % 97 = 5 AND NOT is_centered THEN text || ' emenda' ELSE text END AS text, is_centered, has_strike, indent_left, fn_id
FROM ({statute}) WHERE NOT (doc_id % 3 = 0 AND seq % 211 = 7)
"""

#: Events of a marker log: what clients click on.
MARKERS_SQL = """
SELECT CAST(click_id AS BIGINT) AS at, coalesce(kind, '') AS writer, CAST(click_id % 1000 AS BIGINT) AS n,
       CASE WHEN click_id % 97 = 0 THEN 'clear' WHEN click_id % 3 = 0 THEN 'unmark' ELSE 'mark' END AS op,
       CASE WHEN click_id % 9700 = 0 THEN NULL ELSE coalesce(client_id, -1) END AS doc_id,
       CASE WHEN click_id % 97 <> 0 THEN 'art' || CAST(click_id % 12 + 1 AS STRING) END AS uid, CAST(click_id % 5 AS INT) AS colour
FROM {clicks}
"""


def marker_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MARKERS_SQL, clicks=table(spark, sf_dir, "clicks"))


def paragraphs(spark: SparkSession, sf_dir: str, whole: bool = False, odd: bool = False, later: bool = False) -> DataFrame:
    """The statute as paragraphs; a paragraph is one run, or two where it has a separator. whole: all documents as one; odd: with odd lines; later: in a later edition."""
    sql = (WHOLE_SQL if whole else ODD_SQL if odd else EDITION_SQL if later else "{statute}").format(statute=STATUTE_SQL)
    rows = spark.sql(sql, orders=table(spark, sf_dir, "orders"), lineitem=table(spark, sf_dir, "lineitem"))
    cut = F.instr("text", " - ")
    run = lambda text, bold: F.struct(text.alias("text"), bold.alias("bold"), F.lit(False).alias("italic"), F.col("has_strike").alias("strike"), F.lit(None).cast("string").alias("hyperlink_url"), F.lit(None).cast("string").alias("hyperlink_anchor"))
    runs = F.when(cut > 0, F.array(run(F.substr(F.col("text"), F.lit(1), cut), F.lit(True)), run(F.substr(F.col("text"), cut + 1), F.lit(False)))).otherwise(F.array(run(F.col("text"), F.lit(False))))
    notes = F.when(F.col("fn_id").isNotNull(), F.array(F.col("fn_id").cast("int"))).otherwise(F.array().cast("array<int>"))
    return rows.select("doc_id", "seq", "text", runs.cast(RUNS).alias("runs"), "is_centered", "has_strike", "indent_left", F.lit("").alias("bookmark_name"), notes.alias("footnote_ids"))


def footnote_defs(spark: SparkSession) -> DataFrame:
    run = F.struct(F.concat(F.lit("note "), F.col("fn_id").cast("string")).alias("text"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.lit(False).alias("strike"), F.lit(None).cast("string").alias("hyperlink_url"), F.lit(None).cast("string").alias("hyperlink_anchor"))
    rows = spark.range(97).select(F.col("id").cast("int").alias("fn_id")).withColumn("kind", F.expr(FOOTNOTE_KIND)).where("kind is not null")
    return rows.withColumns({"summary": F.concat(F.lit("s"), F.col("fn_id").cast("string")), "paragraphs": F.array(F.struct(F.array(run).alias("runs"), F.lit(False).alias("indent")))})


def laws(spark: SparkSession) -> DataFrame:
    return spark.sql(LAWS_SQL)


def subject_sheet(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    sql = WIDE_SQL.format(sheet=SUBJECT_SQL, part="{part}") if wide else SUBJECT_SQL
    return spark.sql(sql, part=table(spark, sf_dir, "part")).withColumn("width", F.lit(4))
