"""The queries of this subpackage: each applies its operator to its whole table with production parameters."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexflow.llm.best_fit import best_fitted
from lexflow.llm.chat import formatted_chats
from lexflow.llm.common import table
from lexflow.llm.exact_dedup import exact_groups
from lexflow.llm.fill_middle import fill_middle, restored
from lexflow.llm.minhash import near_duplicates
from lexflow.llm.packing import packed
from lexflow.llm.pii import key_of, pii_report
from lexflow.llm.piece_lattice import encoded
from lexflow.llm.quality_model import quality_scores
from lexflow.llm.quality_rules import quality_rules
from lexflow.llm.ranking import ranked_lines
from lexflow.llm.substrings import without_repeats
from lexflow.llm.token_store import token_store


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("n_links")


def op2_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


#: Stands for the secret where queries and the pipeline run on test tables in a session that sets none.
TEST_KEY = b"a key for test tables"


def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"), key=key_of(spark, TEST_KEY))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, '{hard}' AS text UNION ALL SELECT -7L, 1L, 'assistant', '{hard}'")
    return formatted_chats(rows.union(more))


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))


def op11_grouped_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_lines(table(spark, sf_dir, "sale_lines"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    fim = fill_middle(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fim.*")
    return fim.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fitted(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_piece_lattice, op3_token_store, op4_packing, op5_substring_dedup, op6_pii_pseudonyms, op7_exact_dedup, op8_chat_format, op9_quality_model, op10_quality_rules, op11_grouped_ranks, op12_fill_middle, op13_best_fit_packing)}

ORACLE_SQL = {
    "op1_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) >= 5 THEN array_to_string(ws[i:i + 4], ' ') ELSE array_to_string(ws, ' ') END AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM common JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 75 * (a.n + b.n - k)),
e AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
r AS (SELECT doc_id AS u, doc_id AS v FROM n UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(c.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT u, min(v) AS c FROM r GROUP BY u) c ON c.u = d.doc_id
""",
    "op5_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 19], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM m, range(0, 20) t(j)),
p AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
k AS (SELECT p.doc_id, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY p.p) FILTER (gone.p IS NULL) AS kept
  FROM p LEFT JOIN gone ON gone.doc_id = p.doc_id AND gone.p = p.p GROUP BY p.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
""",
    "op7_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
""",
    "op8_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(8 + length(role) + length(regexp_replace(role, '[^\\<\[\n]', '', 'g'))
             + length(text) + length(regexp_replace(text, '[^\\<\[]', '', 'g')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
""",
    "op11_grouped_ranks": r"""
WITH steps AS (
  SELECT sale_id, flatten(list_transform(range(1, length(sale_id::VARCHAR) + 1), lambda i: [ascii(substr(sale_id::VARCHAR, i, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0])) AS s
  FROM (SELECT DISTINCT sale_id FROM sale_lines WHERE sale_id IS NOT NULL)),
pooled AS (
  SELECT sale_id, xor(list_reduce(list_prepend(4294967295::BIGINT, s), lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295) % 5 = 0 AS pooled
  FROM steps),
k AS (
  SELECT CASE WHEN pooled THEN -1 ELSE vendor_id END::BIGINT AS vendor_id,
         CASE WHEN pooled THEN -1 ELSE coalesce((item_id % 5 + 5) % 5, -1) END::BIGINT AS part,
         CASE WHEN pooled THEN -1 ELSE coalesce(100 * year(shipped_at) + month(shipped_at), -1) END::BIGINT AS month,
         floor(quantity / 10.0)::BIGINT AS bucket, floor(100 * discount + 0.5)::BIGINT AS percent,
         sale_id, line_no::BIGINT AS line_no, quantity::BIGINT AS quantity, floor(100 * amount + 0.5)::BIGINT AS amount_cents
  FROM sale_lines LEFT JOIN pooled USING (sale_id)),
r AS (
  SELECT *, row_number() OVER (g ORDER BY bucket DESC NULLS FIRST, percent NULLS FIRST, sale_id NULLS LAST, line_no NULLS LAST, quantity NULLS LAST, amount_cents NULLS LAST) AS pos,
         count(*) OVER (PARTITION BY vendor_id, part, month, bucket, percent) AS tied
  FROM k WINDOW g AS (PARTITION BY vendor_id, part, month))
SELECT vendor_id, part, month, pos, pos AS place, sale_id, line_no, quantity, percent, amount_cents, tied FROM r WHERE pos <= 2
""",
    "op12_fill_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b, ('0x' || substr(h, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4 FROM d),
f AS (SELECT *, least(a, b) AS p, greatest(a, b) AS q,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, p) || '<S>' || substr(t, q + 1) || '<M>' || substr(t, p + 1, q - p)
              ELSE '<S>' || substr(t, q + 1) || '<P>' || substr(t, 1, p) || '<M>' || substr(t, p + 1, q - p) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM f
""",
}
