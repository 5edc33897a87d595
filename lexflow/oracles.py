"""The queries again, as SQL that another engine runs over the same tables.

The SQL goes its own way where it can: plain windows and CASE over the shared views, no look-around in
patterns. Queries without SQL here are checked by tests.
"""

from lexflow.functions.text import ACCENTED, PLAIN
from lexflow.operators.checks import CATEGORIES, CODE_LABELS, CODES, FAULTS
from lexflow.plans.views import EDITION_SQL, FOOTNOTE_KIND, LAWS_SQL, MARKERS_SQL, ODD_SQL, STATUTE_SQL, SUBJECT_SQL, WHOLE_SQL, WIDE_SQL

_NAMES = {"orders": "orders", "lineitem": "lineitem", "part": "part"}



def _fault(name: str, *values: str) -> str:
    """A fault's text with the values of SQL expressions."""
    first, *rest = (t.replace("'", "''") for t in FAULTS[name].split("{}"))
    return f"'{first}'" + "".join(f" || {v} || '{t}'" for v, t in zip(values, rest, strict=True))


#: Named parts that a query's SQL is put together from, each with those it needs.
_PARTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "p": (STATUTE_SQL.format(**_NAMES), ()),
    "sheet": (SUBJECT_SQL.format(**_NAMES), ()),
    "laws": (LAWS_SQL, ()),
    "c": (
        r"""
SELECT doc_id, seq, txt AS text, is_centered, has_strike, indent_left, fn_id, t AS unit_type,
  CASE WHEN t IN ('TITULO','CAPITULO','SECAO','SUBSECAO','SUBTITLE') THEN txt
       WHEN t = 'ARTIGO' THEN 'Art. ' || regexp_extract(txt, '^Art\.\s*(\d+)', 1) || regexp_extract(txt, '^Art\.\s*\d+([ºª°])', 1) || CASE WHEN l1 <> '' THEN '-' || l1 ELSE l2 END
       WHEN t = 'PARAGRAFO_UNICO' THEN 'Parágrafo único'
       WHEN t = 'PARAGRAFO_NUM' THEN '§ ' || regexp_extract(txt, '^[§Ss]\s*(\d+)', 1) || 'º'
       WHEN t = 'INCISO' THEN regexp_extract(txt, '^[IVXLC]+')
       WHEN t = 'ALINEA' THEN substr(txt, 1, 2)
       WHEN t = 'SUB_ALINEA' THEN regexp_extract(txt, '^\d+\)')
       WHEN t = 'ITEM_NUM' THEN CASE WHEN regexp_matches(txt, '^\d+\)') THEN regexp_extract(txt, '^\d+\)') ELSE regexp_extract(txt, '^\d+') END
       ELSE '' END AS identifier,
  CASE WHEN t = 'ARTIGO' THEN regexp_extract(txt, '^Art\.\s*(\d+)', 1) || CASE WHEN l1 || l2 <> '' THEN '-' || l1 || l2 ELSE '' END ELSE '' END AS art_number
FROM (SELECT *, trim(text) AS txt, regexp_extract(trim(text), '^Art\.\s*\d+[ºª°]?\s*[-–]([A-H])[.\s]', 1) AS l1, regexp_extract(trim(text), '^Art\.\s*\d+[ºª°]?\s*([A-H])\s*[-–—.]', 1) AS l2,
  CASE WHEN trim(text) = '' THEN 'EMPTY'
       WHEN is_centered THEN CASE WHEN regexp_matches(trim(text), '(?i)^T[ÍI]TULO\s+') THEN 'TITULO' WHEN regexp_matches(trim(text), '(?i)^CAP[ÍI]TULO\s+') THEN 'CAPITULO'
            WHEN regexp_matches(trim(text), '(?i)^SE[ÇC][ÃA]O\s+') THEN 'SECAO' WHEN regexp_matches(trim(text), '(?i)^SUBSE[ÇC][ÃA]O\s+') THEN 'SUBSECAO' ELSE 'SUBTITLE' END
       WHEN regexp_matches(text, '^Art\.\s*\d+') THEN 'ARTIGO' WHEN regexp_matches(text, '(?i)^Par[aá]grafo\s+[uú]nico') THEN 'PARAGRAFO_UNICO'
       WHEN regexp_matches(text, '^[§Ss]\s*\d+') THEN 'PARAGRAFO_NUM' WHEN regexp_matches(text, '^l?[IVXLC]+\s*[-–—]') THEN 'INCISO'
       WHEN regexp_matches(text, '^[a-z]\)') THEN 'ALINEA' WHEN regexp_matches(text, '^\d+\)') AND indent_left >= 600 THEN 'SUB_ALINEA'
       WHEN regexp_matches(text, '^\d+\s*[-–—]') OR regexp_matches(text, '^\d+\)') THEN 'ITEM_NUM' ELSE 'OTHER' END AS t
  FROM p)""",
        ("p",),
    ),
    "e": (
        r"""
SELECT *, CASE WHEN unit_type = 'EMPTY' OR taken THEN NULL ELSE coalesce(mark, unit_type) END AS event
FROM (SELECT *, unit_type = 'SUBTITLE' AND coalesce(lag(takes) OVER (PARTITION BY doc_id ORDER BY seq), false) AS taken,
        lead(unit_type) OVER (PARTITION BY doc_id ORDER BY seq) AS next_type, lead(text) OVER (PARTITION BY doc_id ORDER BY seq) AS next_text
  FROM (SELECT *, mark IS NULL AND unit_type IN ('TITULO','CAPITULO','SECAO','SUBSECAO') AS takes
    FROM (SELECT *, CASE WHEN is_centered AND text LIKE 'NORMA:%' THEN 'NORMA' WHEN is_centered AND text LIKE '%ATO DAS DISPOSIÇÕES TRANSITÓRIAS%' THEN 'ADT' END AS mark FROM c)))""",
        ("c",),
    ),
    "s": (
        r"""
SELECT *, CAST(sum(CASE WHEN is_art AND coalesce(prev, '') <> number THEN 1 ELSE 0 END) OVER w AS BIGINT) AS block_id, CAST(sum(CASE WHEN is_art THEN 1 ELSE 0 END) OVER w AS BIGINT) AS art_run,
  coalesce(last_value(CASE WHEN is_key THEN coalesce(number, '') END IGNORE NULLS) OVER w, '') AS open
FROM (SELECT *, last_value(CASE WHEN is_key THEN coalesce(number, '') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
  FROM (SELECT *, CASE WHEN is_art THEN CASE WHEN in_adt THEN 'ADT' ELSE '' END || art_number END AS number
    FROM (SELECT *, coalesce(event = 'ARTIGO', false) AS is_art, coalesce(event IN ('NORMA','ADT','TITULO','CAPITULO','SECAO','SUBSECAO','SUBTITLE','ARTIGO'), false) AS is_key,
        coalesce(last_value(CASE WHEN event = 'NORMA' THEN trim(substr(text, 7)) END IGNORE NULLS) OVER w0, '') AS law_name,
        coalesce(last_value(CASE WHEN event = 'NORMA' THEN false WHEN event = 'ADT' THEN true END IGNORE NULLS) OVER w0, false) AS in_adt
      FROM e WINDOW w0 AS (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING))))
WINDOW w AS (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING)""",
        ("e",),
    ),
    "k": (
        """
SELECT *, max(CASE WHEN is_art THEN seq END) OVER (PARTITION BY doc_id, block_id) AS caput_seq FROM s
WHERE is_art OR (event IN ('PARAGRAFO_UNICO','PARAGRAFO_NUM','INCISO','ALINEA','SUB_ALINEA','ITEM_NUM','OTHER') AND open <> '')""",
        ("s",),
    ),
    "b": (
        r"""
SELECT *, 'art' || open || CASE WHEN is_art OR unit_type = 'OTHER' THEN '' ELSE c0 || c1 || c2 || c3 || CASE WHEN unit_type = 'ITEM_NUM' THEN suffix ELSE '' END END AS base_uid
FROM (SELECT *,
   CASE WHEN m0.d = 0 THEN m0.s ELSE '' END AS c0, CASE WHEN m1.d = 1 THEN m1.s ELSE '' END AS c1, CASE WHEN m2.d = 2 THEN m2.s ELSE '' END AS c2, CASE WHEN m3.d = 3 THEN m3.s ELSE '' END AS c3
  FROM (SELECT *,
     last_value(CASE WHEN depth <= 0 THEN {'d': depth, 's': suffix} END IGNORE NULLS) OVER w AS m0, last_value(CASE WHEN depth <= 1 THEN {'d': depth, 's': suffix} END IGNORE NULLS) OVER w AS m1,
     last_value(CASE WHEN depth <= 2 THEN {'d': depth, 's': suffix} END IGNORE NULLS) OVER w AS m2, last_value(CASE WHEN depth <= 3 THEN {'d': depth, 's': suffix} END IGNORE NULLS) OVER w AS m3
    FROM (SELECT *, CASE WHEN unit_type LIKE 'PARAGRAFO%' THEN 0 WHEN unit_type = 'INCISO' THEN 1 WHEN unit_type = 'ALINEA' THEN 2 WHEN unit_type = 'SUB_ALINEA' THEN 3 END AS depth,
        CASE unit_type WHEN 'PARAGRAFO_UNICO' THEN 'pu' WHEN 'PARAGRAFO_NUM' THEN 'p' || regexp_extract(text, '(\d+)', 1) WHEN 'INCISO' THEN identifier WHEN 'ALINEA' THEN substr(text, 1, 1)
          WHEN 'SUB_ALINEA' THEN 'sub' || regexp_extract(text, '^\d+') WHEN 'ITEM_NUM' THEN 'item' || regexp_extract(text, '^\d+') ELSE '' END AS suffix FROM k)
    WINDOW w AS (PARTITION BY doc_id, art_run ORDER BY seq ROWS UNBOUNDED PRECEDING)))""",
        ("k",),
    ),
    "u": (
        """
SELECT *, CASE WHEN is_art OR n = 0 THEN base_uid ELSE base_uid || '_' || CAST(n + 1 AS VARCHAR) END AS uid,
  CASE WHEN seq < caput_seq THEN 'version' WHEN is_art THEN 'caput' ELSE 'child' END AS role
FROM (SELECT *, coalesce(sum(CASE WHEN is_art THEN 0 ELSE 1 END) OVER w, 0) + coalesce(max(CASE WHEN is_art THEN 1 ELSE 0 END) OVER w, 0) AS n FROM b
  WINDOW w AS (PARTITION BY doc_id, base_uid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
        ("b",),
    ),
    "v": (
        """
SELECT *, has_strike OR role = 'version' OR coalesce(role = 'child' AND lead(identifier) OVER (PARTITION BY doc_id, block_id, role ORDER BY seq) = identifier, false) AS is_old_version,
  text LIKE '%(Revogado%' AS is_revoked FROM u""",
        ("u",),
    ),
    "h": (
        """
SELECT doc_id, seq, CASE WHEN event IN ('NORMA','ADT') THEN 'TITULO' WHEN event = 'SUBTITLE' THEN 'SECAO' ELSE event END AS level,
  CASE WHEN event = 'NORMA' THEN trim(substr(text, 7)) ELSE text END AS text,
  CASE WHEN event IN ('TITULO','CAPITULO','SECAO','SUBSECAO') AND next_type = 'SUBTITLE' THEN next_text ELSE '' END AS subtitle,
  CASE event WHEN 'ADT' THEN 'adt' WHEN 'NORMA' THEN 'norma' || count(*) FILTER (event = 'NORMA') OVER w WHEN 'TITULO' THEN 'tit' || count(*) FILTER (event = 'TITULO') OVER w
    WHEN 'CAPITULO' THEN 'cap' || count(*) FILTER (event = 'CAPITULO') OVER w WHEN 'SUBSECAO' THEN 'subsec' || count(*) FILTER (event = 'SUBSECAO') OVER w
    ELSE 'sec' || count(*) FILTER (event IN ('SECAO','SUBTITLE')) OVER w END AS data_section
FROM e WHERE event IN ('NORMA','ADT','TITULO','CAPITULO','SECAO','SUBSECAO','SUBTITLE')
WINDOW w AS (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING)""",
        ("e",),
    ),
    "a": (
        f"""
SELECT s.doc_id, s.block_id, min(s.seq) AS seq, arg_min(number, s.seq) AS art_number, arg_min(in_adt, s.seq) AS is_adt, arg_min(s.law_name, s.seq) AS law_name, count(*) AS n_versions,
  coalesce(any_value(law_prefix), '') AS law_prefix, coalesce('s' || arg_max(fn_id, s.seq) FILTER ({FOOTNOTE_KIND} = 'summary'), '') AS summary
FROM s LEFT JOIN laws ON laws.law_name = s.law_name WHERE is_art GROUP BY s.doc_id, s.block_id""",
        ("s", "laws"),
    ),
    "n": ("SELECT row_no, subject, sub_subject, CAST(unnest(range(0, len(ls))) AS INTEGER) AS line, unnest(ls) AS raw FROM (SELECT *, str_split(devices, chr(10)) AS ls FROM sheet)", ("sheet",)),
    "d": (
        r"""
SELECT row_no, subject, sub_subject, line, law_prefix, hint, lo, hi, trim(str_split(body, ',')[1]) AS art,
  CASE WHEN dt = 'PU' THEN '§ú' WHEN regexp_matches(dt, '^[§Ss]\s*\d+$') THEN '§ ' || regexp_extract(dt, '(\d+)', 1) || 'º' ELSE dt END AS detail
FROM (SELECT *, try_cast(regexp_extract(body, '^(\d+)\s*[-–—]\s*\d+$', 1) AS BIGINT) AS lo, try_cast(regexp_extract(body, '^\d+\s*[-–—]\s*(\d+)$', 1) AS BIGINT) AS hi,
    CASE WHEN contains(body, ',') THEN trim(substr(body, instr(body, ',') + 1)) ELSE '' END AS dt
  FROM (SELECT *, trim(regexp_replace(rest, '\([^)]+\)\s*$', '')) AS body, trim(regexp_extract(rest, '\(([^)]+)\)\s*$', 1)) AS hint
    FROM (SELECT *, regexp_extract(raw, '^([A-Z]{2,})\s*:', 1) AS law_prefix, trim(regexp_replace(raw, '^[A-Z]{2,}\s*:\s*', '')) AS rest FROM n)))
WHERE lo IS NOT NULL OR regexp_matches(trim(str_split(body, ',')[1]), '^(ADT)?\d+[-A-Za-z]*$')""",
        ("n",),
    ),
    "refs": (
        r"""
SELECT row_no, subject, sub_subject, line, law_prefix, hint, 0 AS step, '' AS sub, art, detail FROM d WHERE lo IS NULL
UNION ALL SELECT row_no, subject, sub_subject, line, law_prefix, hint, step, sub, art, '' FROM (
  SELECT g.*, '' AS sub, CAST(step AS VARCHAR) AS art FROM (SELECT *, unnest(range(lo, hi + 1)) AS step FROM d WHERE lo <= hi) g(row_no, subject, sub_subject, line, law_prefix, hint, lo, hi, art0, detail, step)
  UNION ALL SELECT g.*, art_number, art_number FROM (SELECT *, unnest(range(lo, hi + 1)) AS step FROM d WHERE lo <= hi) g(row_no, subject, sub_subject, line, law_prefix, hint, lo, hi, art0, detail, step)
    JOIN (SELECT DISTINCT art_number FROM a WHERE regexp_matches(art_number, '^\d+-[A-Z]$')) x ON CAST(regexp_extract(art_number, '^\d+') AS BIGINT) = step)""",
        ("d", "a"),
    ),
    "hr": (
        """
SELECT *, starts_with(data_section, 'norma') AS is_norma, CASE WHEN starts_with(data_section, 'norma') THEN 0 WHEN level = 'TITULO' THEN 1 WHEN level = 'CAPITULO' THEN 2 ELSE 3 END AS rank,
  count(*) FILTER (starts_with(data_section, 'norma')) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS norma_no,
  CASE WHEN starts_with(data_section, 'norma') THEN 0 WHEN starts_with(data_section, 'tit') OR data_section = 'adt' THEN 1 WHEN starts_with(data_section, 'cap') THEN 2 WHEN starts_with(data_section, 'sec') THEN 3 ELSE 4 END AS lv
FROM h""",
        ("h",),
    ),
    "fn": (f"SELECT doc_id, seq, fn_id, {FOOTNOTE_KIND} AS kind, block_id - CASE WHEN is_art AND coalesce(prev, '') <> number THEN 1 ELSE 0 END AS blk FROM k WHERE {FOOTNOTE_KIND} IN ('public', 'private')", ("k",)),
    "entries": ("SELECT row_no, trim(subject) AS subject, trim(sub_subject) AS sub_subject, list_filter(list_transform(str_split(see_also, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS vides FROM sheet", ("sheet",)),
    "p0": (
        r"""
SELECT doc_id, seq, CASE WHEN lv IS NULL THEN '' ELSE concat_ws(',', CASE WHEN r0.d = 0 THEN r0.s END, CASE WHEN r1.d = 1 THEN r1.s END, CASE WHEN r2.d = 2 THEN r2.s END, CASE WHEN r3.d = 3 THEN r3.s END) END AS path
FROM (SELECT *, last_value(CASE WHEN lv <= 0 THEN st END IGNORE NULLS) OVER w AS r0, last_value(CASE WHEN lv <= 1 THEN st END IGNORE NULLS) OVER w AS r1,
    last_value(CASE WHEN lv <= 2 THEN st END IGNORE NULLS) OVER w AS r2, last_value(CASE WHEN lv <= 3 THEN st END IGNORE NULLS) OVER w AS r3
  FROM (SELECT *, {'d': lv, 's': CASE lv WHEN 0 THEN CASE WHEN unit_type = 'PARAGRAFO_UNICO' THEN '§ú' ELSE identifier END WHEN 2 THEN substr(identifier, 1, 1) WHEN 3 THEN regexp_extract(identifier, '^\d+') ELSE identifier END} AS st
    FROM (SELECT *, CASE WHEN unit_type LIKE 'PARAGRAFO%' THEN 0 WHEN unit_type = 'INCISO' THEN 1 WHEN unit_type = 'ALINEA' THEN 2 WHEN unit_type IN ('SUB_ALINEA','ITEM_NUM') THEN 3 END AS lv
      FROM v WHERE role = 'child' AND NOT is_old_version))
  WINDOW w AS (PARTITION BY doc_id, block_id ORDER BY seq ROWS UNBOUNDED PRECEDING))""",
        ("v",),
    ),
    "fnn": ("SELECT doc_id, seq, fn_id, kind = 'private' AS is_private, row_number() OVER (PARTITION BY doc_id, kind, CASE WHEN kind = 'private' THEN blk END ORDER BY seq) AS number FROM fn", ("fn",)),
    # provisions with all that pages show of them: law, path, footnote, and the text behind the identifier
    "m": (
        r"""
SELECT v.doc_id, v.block_id, v.seq, v.role, v.unit_type, v.identifier, v.text, v.is_old_version, v.is_revoked, v.has_strike, a.law_prefix, a.art_number, a.seq AS art_seq, coalesce(p0.path, '') AS path,
  CASE WHEN a.law_prefix <> '' THEN 'art' || a.law_prefix || substr(v.uid, 4) ELSE v.uid END AS uid, regexp_extract(v.text, '\((Redação dada|Revogado)[^)]*\)') AS note, v.role = 'version' OR (v.role = 'child' AND v.is_old_version) AS old,
  CASE WHEN v.identifier = '' THEN v.text ELSE regexp_replace(substr(v.text, length(v.identifier) + 1), '^(\s*[-–—.]\s*|\s+)', '') END AS body,
  CASE WHEN is_private THEN 'b' ELSE '' END || fnn.number AS fn_no, is_private, fnn.fn_id
FROM v JOIN a USING (doc_id, block_id) LEFT JOIN p0 ON p0.doc_id = v.doc_id AND p0.seq = v.seq LEFT JOIN fnn ON fnn.doc_id = v.doc_id AND fnn.seq = v.seq""",
        ("v", "a", "p0", "fnn"),
    ),
    "nv": (
        r"""
SELECT doc_id, seq, text, CASE WHEN by_old THEN old.seq ELSE live.seq END AS next_seq, CASE WHEN by_old THEN old.text ELSE live.text END AS next_text
FROM (SELECT *, old IS NOT NULL AND (live IS NULL OR (old.rk, old.seq) < (live.rk, live.seq)) AS by_old,
    live IS NOT NULL AND (ident = '' OR ident = regexp_replace(live.identifier, '\s+', '', 'g') OR live.role = 'caput') AS fits
  FROM (SELECT *, lead({'seq': seq, 'text': text, 'rk': rk}) OVER (PARTITION BY doc_id, block_id, is_old, ident ORDER BY rk, seq) AS old,
      first_value(CASE WHEN NOT is_old THEN {'seq': seq, 'text': text, 'identifier': identifier, 'role': role, 'rk': rk} END IGNORE NULLS) OVER (PARTITION BY doc_id, block_id ORDER BY rk, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS live
    FROM (SELECT *, is_old_version AND role <> 'caput' AS is_old, CASE role WHEN 'version' THEN 0 WHEN 'caput' THEN 1 ELSE 2 END AS rk, regexp_replace(regexp_extract(text, '^(.+?)\s+[-–—]\s', 1), '\s+', '', 'g') AS ident FROM v))
  WHERE is_old) WHERE by_old OR fits""",
        ("v",),
    ),
    "ft": (
        """
SELECT row_no, field, context, k AS line_no, line, fixed, upper(regexp_extract(fixed, '^([A-Za-z]{2,})\\s*:\\s*.+$', 1)) AS prefix,
  trim(regexp_replace(trim(regexp_replace(fixed, '^[A-Za-z]{2,}\\s*:\\s*', '')), '\\([^)]+\\)\\s*$', '')) AS body
FROM (SELECT *, replace(line, ', ', ',') AS fixed FROM (
  SELECT row_no, field, context, CAST(unnest(range(1, len(ls) + 1)) AS INTEGER) AS k, trim(unnest(ls)) AS line FROM (
    SELECT row_no, 'Dispositivos' AS field, subject || CASE WHEN sub_subject <> '' THEN ' > ' || sub_subject ELSE '' END AS context, str_split(trim(devices), chr(10)) AS ls FROM sheet
    UNION ALL SELECT row_no, 'Vide', subject || CASE WHEN sub_subject <> '' THEN ' > ' || sub_subject ELSE '' END, str_split(trim(see_also), chr(10)) FROM sheet))
  WHERE line <> '')""",
        ("sheet",),
    ),
    "sf": (
        f"""
SELECT row_no, field, line_no, CAST(row_number() OVER (PARTITION BY row_no, field, line_no ORDER BY k) - 1 AS INTEGER) AS fault_no, fault FROM (
  SELECT row_no, field, line_no, unnest(range(1, 8)) AS k, unnest(faults) AS fault FROM (
    SELECT row_no, field, line_no, [
      CASE WHEN contains(line, ', ') THEN {_fault("comma_space", "fixed", "line")} END,
      CASE WHEN regexp_matches(fixed, '^[A-Za-z]{{2,}}(\\s+:|:\\s+)') THEN {_fault("colon_space", "line")} END,
      CASE WHEN prefix NOT IN ('', 'CF', 'LO') THEN {_fault("prefix_unknown", "prefix", "'CF, LO'")} END,
      CASE WHEN lo >= hi THEN {_fault("range_down", "lo", "hi")} END,
      CASE WHEN body = '' THEN {_fault("reference_empty")} END,
      CASE WHEN lo IS NULL AND body <> '' AND NOT fits THEN {_fault("article_invalid", "art")} END,
      CASE WHEN lo IS NULL AND fits AND d <> '' AND NOT (lower(d) = 'caput' OR upper(d) = 'PU' OR d IN ('§ú', '§u') OR regexp_matches(d, '^(§\\d+|[IVXLC]+|[a-z]|\\d+|[IVXLC]+\\s*,\\s*[a-z](\\s*,\\s*\\d+)?|[a-z]\\s*,\\s*\\d+|§(\\d+|ú|u)\\s*,\\s*[IVXLC]+)$')) THEN
        CASE WHEN n = 1 THEN {_fault("detail_unknown", "d")} WHEN n = 2 AND regexp_matches(d, '^[IVXLC]+\\s*,\\s*[IVXLC]+$') THEN {_fault("detail_romans", "trim(str_split(d, ',')[1])", "trim(str_split(d, ',')[2])")}
          WHEN n = 2 AND regexp_matches(d, '^[a-z]\\s*,\\s*[a-z]$') THEN {_fault("detail_letters")} WHEN n = 2 THEN {_fault("detail_pair", "d")} WHEN n = 3 THEN {_fault("detail_triple", "d")} ELSE {_fault("detail_long", "d")} END END] AS faults
    FROM (SELECT *, try_cast(regexp_extract(body, '^(\\d+)\\s*[-–—]\\s*\\d+$', 1) AS BIGINT) AS lo, try_cast(regexp_extract(body, '^\\d+\\s*[-–—]\\s*(\\d+)$', 1) AS BIGINT) AS hi, trim(str_split(body, ',')[1]) AS art,
        regexp_matches(trim(str_split(body, ',')[1]), '^(ADT)?\\d+[-A-Za-z]*$') AS fits, CASE WHEN contains(body, ',') THEN trim(substr(body, instr(body, ',') + 1)) ELSE '' END AS d, len(str_split(body, ',')) - 1 AS n FROM ft WHERE field = 'Dispositivos')
    UNION ALL SELECT row_no, field, line_no, [CASE WHEN n > 2 THEN {_fault("bars")} END, CASE WHEN n = 2 AND trim(ps[1]) = '' THEN {_fault("left_empty")} END, CASE WHEN n = 2 AND trim(ps[2]) = '' THEN {_fault("right_empty")} END, NULL, NULL, NULL, NULL]
    FROM (SELECT *, str_split(line, '|') AS ps, len(str_split(line, '|')) AS n FROM ft WHERE field = 'Vide')))
WHERE fault IS NOT NULL""",
        ("ft",),
    ),
    "ol": (
        """
SELECT doc_id, seq, section_id, parent_seq, title FROM (
  SELECT n.doc_id, n.seq, data_section AS section_id, text || CASE WHEN subtitle <> '' THEN ' — ' || subtitle ELSE '' END AS title,
    CASE WHEN is_norma THEN NULL ELSE coalesce((SELECT max(x.seq) FROM hr x WHERE x.doc_id = n.doc_id AND x.seq < n.seq AND x.rank < n.rank AND x.rank <> 0
        AND NOT EXISTS (SELECT 1 FROM hr y WHERE y.doc_id = n.doc_id AND y.seq > x.seq AND y.seq < n.seq AND y.rank < x.rank)
        AND NOT EXISTS (SELECT 1 FROM hr z WHERE z.doc_id = n.doc_id AND z.seq < n.seq AND z.seq > x.seq AND z.rank > x.rank AND z.rank < n.rank)),
      CASE WHEN norma_no > 1 THEN (SELECT max(x.seq) FROM hr x WHERE x.doc_id = n.doc_id AND x.seq < n.seq AND x.is_norma) END) END AS parent_seq
  FROM hr n WHERE NOT is_norma OR norma_no > 1)""",
        ("hr",),
    ),
    "ln": (
        r"""
SELECT doc_id, seq, heading, bold, text, trim(text, _ws()) AS label, CASE WHEN heading THEN 'category' WHEN bold AND trim(text, _ws()) = upper(trim(text, _ws())) THEN 'group' ELSE 'entry' END AS kind
FROM (SELECT CAST(floor(of / 64) AS BIGINT) AS doc_id, of * 1000000 + pos AS seq, of % 10 = 0 AND pos = 0 AS heading, line = upper(line) AS bold, CASE WHEN pos % 7 = 3 THEN line || ' – Art. 10, II.' ELSE line END AS text
  FROM (SELECT doc_id AS of, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, str_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)))
WHERE trim(text, _ws()) <> ''""".replace("_ws()", "chr(9) || chr(11) || chr(12) || chr(13) || ' ' || chr(133) || chr(160) || chr(8232) || chr(8233) || chr(12288)"),
        (),
    ),
    "en": (
        r"""
SELECT doc_id, seq, kind, category_no, group_no, CASE WHEN mk.kind = 'group' THEN mk.label ELSE '' END AS title,
  CASE WHEN cut > 0 THEN rtrim(trim(regexp_extract(text, '[–—-]\s*Art\.\s*(.+)$', 1)), '.') END AS art_ref,
  trim(CASE WHEN bold AND trim(shown) <> '' THEN '<b>' || esc || '</b>' ELSE esc END) AS html
FROM (SELECT *, replace(replace(replace(shown, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS esc FROM (
  SELECT *, CASE WHEN cut > 0 THEN regexp_replace(text, '\s*[–—-]\s*Art\.\s*.+$', '') ELSE text END AS shown FROM (
    SELECT *, CASE WHEN regexp_matches(text, '[–—-]\s*Art\.\s*.+$') THEN 1 ELSE 0 END AS cut, CAST(count(*) FILTER (kind = 'category') OVER w AS BIGINT) AS category_no, CAST(count(*) FILTER (kind = 'group') OVER w AS BIGINT) AS group_no,
      last_value(CASE WHEN kind <> 'entry' THEN {'kind': kind, 'label': label} END IGNORE NULLS) OVER w AS mk
    FROM ln WINDOW w AS (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING)))) WHERE kind = 'entry'""",
        ("ln",),
    ),
    "vd": ("SELECT row_no, subject, sub_subject, CAST(unnest(range(0, len(vides))) AS INTEGER) AS pos, unnest(vides) AS target FROM entries", ("entries",)),
}


def _order(names: tuple[str, ...], seen: list[str]) -> list[str]:
    for n in names:
        _order(_PARTS[n][1], seen)
        if n not in seen:
            seen.append(n)
    return seen


def _sql(needs: str, body: str, recursive: bool = False, **other: str) -> str:
    """A query over named parts and those that they need; other has parts that stand in for those of that name."""
    parts = ",\n".join(f"{n} AS ({other.get(n, _PARTS[n][0])})" for n in _order(tuple(needs.split()), []))
    return f"WITH {'RECURSIVE ' * recursive}{parts}\n{body}" if parts else body


#: Differences of pairs (x, y) of word lists: a table of common lengths by rows, then the way back through it.
_DIFF = """
base AS (SELECT row_number() OVER () AS id, x, y FROM (SELECT DISTINCT x, y FROM pairs)),
dp AS (SELECT id, 0 AS i, list_transform(range(0, len(y) + 1), lambda z: CAST(0 AS BIGINT)) AS r FROM base
  UNION ALL SELECT dp.id, i + 1, list_prepend(CAST(0 AS BIGINT), list_transform(range(1, len(y) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN y[k] = x[i + 1] THEN r[k] + 1 ELSE r[k + 1] END))))
  FROM dp JOIN base USING (id) WHERE i < len(x)),
back AS (SELECT id, len(x) AS i, len(y) AS j, CAST([] AS STRUCT(op VARCHAR, word VARCHAR)[]) AS parts FROM base
  UNION ALL SELECT id, i - CAST(op <> 'ins' AS INTEGER), j - CAST(op <> 'del' AS INTEGER), list_prepend({'op': op, 'word': CASE WHEN op = 'ins' THEN y[j] ELSE x[i] END}, parts) FROM (
    SELECT b.id, b.i, b.j, b.parts, x, y, CASE WHEN b.i > 0 AND b.j > 0 AND x[b.i] = y[b.j] THEN 'eq' WHEN b.j > 0 AND (b.i = 0 OR p.r[b.j] >= q.r[b.j + 1]) THEN 'ins' ELSE 'del' END AS op
    FROM back b JOIN base USING (id) JOIN dp p ON p.id = b.id AND p.i = b.i LEFT JOIN dp q ON q.id = b.id AND q.i = b.i - 1 WHERE b.i > 0 OR b.j > 0)),
parts AS (SELECT x, y, parts FROM back JOIN base USING (id) WHERE i = 0 AND j = 0)"""
_WORDS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')"




def _escaped(column: str) -> str:
    return f"replace(replace(replace(replace(replace({column}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;')"


_WIDE = WIDE_SQL.format(sheet=SUBJECT_SQL, part="{part}").format(**_NAMES)
#: Numbers of articles that ranges reach, by law prefix.
_REACHED = r"""
, kn AS (SELECT DISTINCT unnest(CASE WHEN law_prefix = '' THEN [''] ELSE [law_prefix, ''] END) AS law_prefix, CAST(regexp_extract(art_number, '^\d+') AS BIGINT) AS step, art_number AS art FROM a WHERE regexp_matches(art_number, '^\d+(-[A-Z])?$'))
"""
_WHOLE = WHOLE_SQL.format(statute=STATUTE_SQL).format(**_NAMES)
_KEY = f"replace(translate(lower(text), '{ACCENTED}', '{PLAIN}'), chr(160), ' ')"
_SHOWN = "concat(subject, CASE WHEN sub_subject <> '' THEN ' — ' || sub_subject ELSE '' END)"
_CLOSED = """
SELECT a.doc_id, a.seq, ['norma','tit','cap','sec','subsec'][lv + 1] AS level, max(hr.seq) AS heading_seq
FROM a JOIN hr ON hr.doc_id = a.doc_id AND hr.seq < a.seq
WHERE NOT EXISTS (SELECT 1 FROM hr x WHERE x.doc_id = a.doc_id AND x.seq > hr.seq AND x.seq < a.seq AND {closes}) GROUP BY ALL"""

#: For each article, the titles of the headings over it and its own label.
_CRUMBS = """
, oh AS ("""+_CLOSED.format(closes="(x.lv = hr.lv OR x.lv = 0)")+"""),
tt AS (SELECT doc_id, seq, CASE WHEN subtitle <> '' THEN CASE WHEN num <> '' THEN num || '-' ELSE '' END || subtitle WHEN num <> '' THEN num ELSE text END AS short
  FROM (SELECT *, trim(regexp_replace(text, '(?i)^(T[IÍ]TULO|CAP[IÍ]TULO|SE[CÇ][AÃ]O|SUBSE[CÇ][AÃ]O)\\s*', '')) AS num FROM hr)),
cr AS (SELECT a.doc_id, a.seq, CASE WHEN any_value(law_prefix) <> '' THEN any_value(law_prefix) || chr(160) ELSE '' END || any_value(art_number) AS label, string_agg(short, ' › ' ORDER BY heading_seq) AS crumbs
  FROM a JOIN oh ON oh.doc_id = a.doc_id AND oh.seq = a.seq JOIN tt ON tt.doc_id = oh.doc_id AND tt.seq = oh.heading_seq GROUP BY a.doc_id, a.seq)"""

ORACLE_SQL: dict[str, str] = {
    "search_all_terms": f"SELECT doc_id, lang, source, CAST(length(text) AS INTEGER) AS n FROM documents WHERE contains({_KEY}, 'eaux') AND contains({_KEY}, 'tion')",
    "search_phrase": f"SELECT doc_id, lang FROM documents WHERE contains({_KEY}, 'de la') AND contains({_KEY}, 'element')",
    "indexed_search": " UNION ALL ".join(f"SELECT {k} AS query, doc_id FROM documents WHERE {' AND '.join(f'contains({_KEY}, {t!r})' for t in terms)}" for k, terms in enumerate([["e"], ["qu"], ["eau"], ["eaux", "tion"], ["de la", "element"], ["dans"], ["zq"], ["internationalisations"], ["constantly", "forgotten"]])),
    "search_keys": f"SELECT doc_id, md5({_KEY}) AS key_md5, md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS html_md5 FROM documents",
    "highlight_hits": f"SELECT doc_id, len(regexp_extract_all(text, '(?i)[eéèêë]l[eéèêë]m[eéèêë][nñ]t'))::INTEGER AS hits FROM documents WHERE contains({_KEY}, 'element')",
    "highlight_html": "SELECT doc_id, md5(replace(replace(replace(replace(replace(regexp_replace(text, '(?i)([aáàâãä]mp[\\s\u00a0]+[eéèêë]t|[aáàâãä]mp|lt|q[uúùûü][eéèêë])', chr(64976) || '\\1' || chr(64977), 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(64976), '<mark>'), chr(64977), '</mark>')) AS html_md5 FROM documents",
    "page_text": "SELECT page_id, md5(regexp_replace(html, '<[^>]*>', '', 'g')) AS text_md5 FROM pages",
    "filter_pages": f"SELECT page_id FROM (SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS text FROM pages) WHERE contains({_KEY}, 'reau') AND contains({_KEY}, 'elle')",
    "classify_units": _sql("c", "SELECT doc_id, seq, unit_type, identifier, art_number FROM c"),
    "unit_type_counts": _sql("c", "SELECT unit_type, count(*) AS n, count(DISTINCT doc_id) AS docs FROM c GROUP BY unit_type"),
    "amendment_notes": _sql("c", r"SELECT doc_id, seq, regexp_extract(text, '\((Redação dada|Revogado)[^)]*\)') AS note, text LIKE '%(Revogado%' AS is_revoked FROM c"),
    "section_headings": _sql("h", "SELECT * FROM h"),
    "law_ffill": _sql("s", "SELECT doc_id, seq, law_name, in_adt, open AS open_article, is_art OR coalesce(event IN ('PARAGRAFO_UNICO','PARAGRAFO_NUM','INCISO','ALINEA','SUB_ALINEA','ITEM_NUM','OTHER') AND open <> '', false) AS kept FROM s"),
    "version_islands": _sql("a", "SELECT doc_id, block_id, seq, art_number, is_adt, law_name, n_versions FROM a"),
    "hier_uid": _sql("b", "SELECT doc_id, seq, base_uid FROM b"),
    "uid_dedup": _sql("u", "SELECT doc_id, seq, role, uid FROM u"),
    "segmented_states": _sql("s", "SELECT seq, law_name, in_adt, open AS open_article, is_art OR coalesce(event IN ('PARAGRAFO_UNICO','PARAGRAFO_NUM','INCISO','ALINEA','SUB_ALINEA','ITEM_NUM','OTHER') AND open <> '', false) AS kept, block_id, art_run FROM s", p=_WHOLE),
    "segmented_headings": _sql("h", "SELECT seq, level, text, subtitle, data_section FROM h", p=_WHOLE),
    "segmented_uids": _sql("u", "SELECT block_id, seq, role, uid FROM u", p=_WHOLE),
    "segmented_footnotes": _sql("fnn", "SELECT seq, CAST(fn_id AS INTEGER) AS fn_id, is_private, CAST(number AS INTEGER) AS number FROM fnn", p=_WHOLE),
    "old_versions": _sql("v", "SELECT doc_id, block_id, seq, role, identifier, is_old_version FROM v"),
    "article_revoked": _sql("v", "SELECT doc_id, block_id, bool_or(role = 'caput' AND is_revoked) AND NOT bool_or(role = 'child' AND NOT is_old_version AND NOT is_revoked) AS is_revoked FROM v GROUP BY doc_id, block_id"),
    "footnote_numbers": _sql("fn", "SELECT doc_id, seq, CAST(fn_id AS INTEGER) AS fn_id, kind = 'private' AS is_private, CAST(row_number() OVER (PARTITION BY doc_id, kind, CASE WHEN kind = 'private' THEN blk END ORDER BY seq) AS INTEGER) AS number FROM fn"),
    "article_summaries": _sql("a", "SELECT doc_id, block_id, art_number, law_prefix, summary FROM a"),
    "unit_paths": _sql("p0", "SELECT doc_id, seq, path FROM p0"),
    "element_counts": _sql("h a v", "SELECT 'headings' AS what, (SELECT count(*) FROM h) AS n UNION ALL SELECT 'articles', (SELECT count(*) FROM a) UNION ALL SELECT 'old_versions', (SELECT count(*) FROM v WHERE is_old_version) UNION ALL SELECT 'articles of ' || law_name, count(*) FROM a GROUP BY law_name"),
    "document_elements": _sql("h a", "SELECT doc_id, seq, 'heading' AS kind, data_section AS key FROM h UNION ALL SELECT doc_id, seq, 'article', CAST(block_id AS VARCHAR) FROM a"),
    "structure_snapshot": _sql(
        "v a",
        """
SELECT a.doc_id, a.seq, a.art_number, a.is_adt, g.uids, g.children_count, g.versions_count, g.is_revoked, a.summary <> '' AS has_summary
FROM a JOIN (SELECT doc_id, block_id, string_agg(CASE WHEN p <> '' THEN 'art' || p || substr(uid, 4) ELSE uid END, ' ' ORDER BY seq) FILTER (role <> 'version') AS uids, count(*) FILTER (role = 'child') AS children_count,
    count(*) FILTER (role = 'version') AS versions_count, bool_or(role = 'caput' AND is_revoked) AND NOT bool_or(role = 'child' AND NOT is_old_version AND NOT is_revoked) AS is_revoked
  FROM (SELECT v.*, a.law_prefix AS p FROM v JOIN a USING (doc_id, block_id)) GROUP BY doc_id, block_id) g USING (doc_id, block_id)""",
    ),
    "device_lines": _sql("d", "SELECT row_no, line, law_prefix, hint, lo, hi, art, detail FROM d"),
    "range_expand": _sql("refs", "SELECT row_no, line, step, art FROM refs WHERE step > 0"),
    "subject_index_flat": _sql("refs", "SELECT subject, sub_subject, count(*) AS n_refs, count(DISTINCT law_prefix || ':' || coalesce(y.adt, art)) AS n_articles FROM refs LEFT JOIN (SELECT DISTINCT art_number AS adt, substr(art_number, 4) AS plain FROM a WHERE art_number LIKE 'ADT%-%') y ON y.plain = art AND law_prefix = '' GROUP BY ALL"),
    "subject_index_nested": _sql(
        "refs entries",
        """
SELECT subject, coalesce(nr, 0)::INTEGER AS n_own, ch::INTEGER AS n_children, vs::INTEGER AS n_vides, coalesce(na, 0)::INTEGER AS n_all
FROM (SELECT subject, count(*) FILTER (sub_subject <> '') AS ch, coalesce(sum(len(vides)) FILTER (sub_subject = ''), 0) AS vs FROM entries GROUP BY subject)
LEFT JOIN (SELECT subject, count(*) FILTER (sub_subject = '') AS nr, count(*) AS na FROM refs GROUP BY subject) USING (subject)""",
    ),
    "subject_filter": _sql(
        "entries",
        """
SELECT 'subject' AS query, subject, CAST(count(*) FILTER (sub_subject <> '') AS INTEGER) AS n_children FROM entries WHERE contains(lower(subject), 'brand#1') AND contains(subject, '4') GROUP BY subject
UNION ALL SELECT 'below', subject, CAST(count(*) AS INTEGER) FROM entries WHERE contains(lower(sub_subject), 'small') GROUP BY subject""",
    ),
    "formatted_refs": _sql(
        "refs",
        """
SELECT row_no, line, step, sub, CASE WHEN law_prefix <> '' THEN law_prefix || ' ' ELSE '' END || 'art. ' || art || CASE WHEN detail <> '' THEN ', ' || detail ELSE '' END AS label,
  CASE WHEN hint <> '' THEN hint ELSE coalesce(m.summary, '') END AS hint
FROM refs LEFT JOIN (SELECT CASE WHEN law_prefix <> '' THEN law_prefix || ':' ELSE '' END || art_number AS key, arg_max(summary, (doc_id, seq)) AS summary FROM a WHERE summary <> '' GROUP BY 1) m
  ON m.key = CASE WHEN law_prefix <> '' THEN law_prefix || ':' ELSE '' END || art""",
    ),
    "dangling_refs": _sql(
        "refs",
        f"""
SELECT key, {_SHOWN} AS context, row_no FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY row_no, line, step, sub) AS rn FROM (
  SELECT *, CASE WHEN law_prefix <> '' THEN law_prefix || ':' ELSE '' END || art AS key FROM refs)
  WHERE key NOT IN (SELECT art_number FROM a UNION SELECT law_prefix || ':' || art_number FROM a WHERE law_prefix <> '')) WHERE rn = 1""",
    ),
    "dangling_see_also": _sql(
        "vd",
        f"""
SELECT target, {_SHOWN} AS context, row_no FROM (SELECT *, row_number() OVER (PARTITION BY lower(replace(target, '|', ' — ')) ORDER BY row_no, pos) AS rn FROM vd
  WHERE lower(replace(target, '|', ' — ')) NOT IN (SELECT lower(subject) FROM entries UNION SELECT lower(subject || ' — ' || sub_subject) FROM entries WHERE sub_subject <> '')) WHERE rn = 1""",
    ),
    "range_targets": _sql("d a", _REACHED + "SELECT row_no, line, d.law_prefix, step, kn.art FROM d JOIN kn ON kn.law_prefix = d.law_prefix AND step BETWEEN lo AND hi", sheet=_WIDE),
    "dangling_ranges": _sql(
        "d a",
        _REACHED
        + """
, own AS (SELECT law_prefix, step FROM kn WHERE regexp_matches(art, '^[0-9]+$')),
pts AS (SELECT row_no, line, d.law_prefix, lo, hi, step FROM d JOIN own ON own.law_prefix = d.law_prefix AND step BETWEEN lo AND hi UNION ALL SELECT row_no, line, law_prefix, lo, hi, hi + 1 FROM d WHERE lo <= hi),
g AS (SELECT row_no, line, law_prefix, coalesce(lag(step) OVER (PARTITION BY row_no, line ORDER BY step) + 1, lo) AS f, step - 1 AS t FROM pts)
SELECT row_no, line, law_prefix, f AS lo, t AS hi FROM g WHERE f <= t""",
        sheet=_WIDE,
    ),
    "see_also_links": _sql(
        "vd",
        """
SELECT row_no, pos, label, k AS subject_key, k IN (SELECT lower(subject) FROM entries UNION SELECT lower(subject) || '|' || lower(sub_subject) FROM entries WHERE sub_subject <> '') AS found
FROM (SELECT *, CASE WHEN r <> '' THEN l || ' — ' || r ELSE target END AS label, lower(CASE WHEN r <> '' THEN l || '|' || r ELSE l END) AS k
  FROM (SELECT *, trim(str_split(target, '|')[1]) AS l, CASE WHEN contains(target, '|') THEN trim(substr(target, instr(target, '|') + 1)) ELSE '' END AS r FROM vd))""",
    ),
    "lint_codes": _sql(
        "c",
        """
SELECT doc_id, seq, 'ART_NO_ORDINAL' AS code, 'Art. ' || art_number AS context FROM c WHERE unit_type = 'ARTIGO' AND CAST(regexp_extract(text, '(\\d+)', 1) AS BIGINT) <= 9 AND NOT regexp_matches(text, '^Art\\.\\s*\\d+[ºª°]')""",
    ),
    "systematic_outline": _sql(
        "hr",
        """
, n AS (SELECT * FROM hr WHERE NOT is_norma OR norma_no > 1),
par AS (SELECT n.*, CASE WHEN is_norma THEN NULL ELSE (SELECT max(x.seq) FROM hr x WHERE x.doc_id = n.doc_id AND x.seq < n.seq AND x.rank < n.rank AND x.rank <> 0
      AND NOT EXISTS (SELECT 1 FROM hr y WHERE y.doc_id = n.doc_id AND y.seq > x.seq AND y.seq < n.seq AND y.rank < x.rank)
      AND NOT EXISTS (SELECT 1 FROM hr z WHERE z.doc_id = n.doc_id AND z.seq < n.seq AND z.seq > x.seq AND z.rank > x.rank AND z.rank < n.rank)) END AS in_tree,
    CASE WHEN NOT is_norma AND norma_no > 1 THEN (SELECT max(x.seq) FROM hr x WHERE x.doc_id = n.doc_id AND x.seq < n.seq AND x.is_norma) END AS law FROM n),
t AS (SELECT *, coalesce(in_tree, law) AS parent_seq FROM par)
SELECT doc_id, seq, data_section AS section_id, parent_seq,
  CAST((law IS NOT NULL) AS INTEGER) + CASE WHEN in_tree IS NULL THEN 0 ELSE 1 + CAST((SELECT in_tree IS NOT NULL FROM t q WHERE q.doc_id = t.doc_id AND q.seq = t.in_tree) AS INTEGER) END AS depth,
  text || CASE WHEN subtitle <> '' THEN ' — ' || subtitle ELSE '' END AS title, NOT EXISTS (SELECT 1 FROM t q WHERE q.doc_id = t.doc_id AND q.parent_seq = t.seq) AS is_leaf FROM t""",
    ),
    "section_ranges": _sql(
        "hr a",
        r"""
, x AS (SELECT a.doc_id, a.seq, a.art_number, (SELECT arg_max(data_section, (h2.rank, h2.seq)) FROM hr h2 WHERE h2.doc_id = a.doc_id AND h2.seq < a.seq AND (NOT is_norma OR norma_no > 1)
     AND NOT EXISTS (SELECT 1 FROM hr y WHERE y.doc_id = a.doc_id AND y.seq > h2.seq AND y.seq < a.seq AND (CASE WHEN h2.is_norma THEN y.is_norma AND y.norma_no > 1 ELSE (y.rank <= h2.rank AND (NOT y.is_norma OR y.norma_no > 1)) END))) AS section_id FROM a),
y AS (SELECT *, (CAST(art_number LIKE 'ADT%' AS INTEGER), CAST(regexp_extract(art_number, '(\d+)', 1) AS BIGINT), regexp_extract(art_number, '-([A-Z])$', 1)) AS key,
    CASE WHEN CAST(regexp_extract(art_number, '(\d+)', 1) AS BIGINT) <= 9 THEN regexp_extract(art_number, '(\d+)', 1) || 'º' ELSE regexp_extract(art_number, '(\d+)', 1) END || regexp_extract(art_number, '-[A-Z]$') AS shown FROM x WHERE section_id IS NOT NULL)
SELECT doc_id, section_id, count(*) AS n_articles, '(art. ' || arg_min(shown, key) || CASE WHEN arg_min(shown, key) <> arg_max(shown, key) THEN '–' || arg_max(shown, key) ELSE '' END || ')' AS art_range FROM y GROUP BY ALL""",
    ),
    "context_headings": _sql("hr a", _CLOSED.format(closes="x.lv <= hr.lv")),
    "ancestor_headings": _sql("hr a", _CLOSED.format(closes="(x.lv = hr.lv OR x.lv = 0)")),
    "current_section": _sql("h a", "SELECT a.doc_id, a.seq, coalesce(arg_max(h.data_section, h.seq), '') AS section_id FROM a LEFT JOIN h ON h.doc_id = a.doc_id AND h.seq < a.seq GROUP BY ALL"),
    "heading_titles": _sql(
        "hr",
        """
SELECT doc_id, seq, CASE WHEN subtitle <> '' THEN CASE WHEN num <> '' THEN num || '-' ELSE '' END || subtitle WHEN num <> '' THEN num ELSE text END AS short,
  ['norma','tit','cap','sec','subsec'][lv + 1] AS level, ['#222','#b71c1c','#f57c00','#fdd835','#2e7d32'][lv + 1] AS colour
FROM (SELECT *, trim(regexp_replace(text, '(?i)^(T[IÍ]TULO|CAP[IÍ]TULO|SE[CÇ][AÃ]O|SUBSE[CÇ][AÃ]O)\\s*', '')) AS num FROM hr)""",
    ),
    "subject_semi_filter": _sql("refs a", "SELECT doc_id, seq, law_prefix, art_number FROM a WHERE (law_prefix, art_number) IN (SELECT (law_prefix, art) FROM refs WHERE subject = 'Brand#11')"),
    "marker_filter": _sql(
        "v a",
        """
, m AS (SELECT v.doc_id, block_id, seq, CASE WHEN law_prefix <> '' THEN 'art' || law_prefix || substr(uid, 4) ELSE uid END AS uid FROM v JOIN (SELECT doc_id, block_id, law_prefix FROM a) USING (doc_id, block_id))
SELECT doc_id, block_id, art_number FROM a WHERE (doc_id, block_id) IN (SELECT (doc_id, block_id) FROM m WHERE uid IN (SELECT uid FROM m WHERE seq % 101 = 0))""",
    ),
    "article_jump": _sql("a", "SELECT doc_id, arg_min(seq, (law_prefix <> '', seq)) AS seq, arg_min(law_prefix, (law_prefix <> '', seq)) AS law_prefix FROM a WHERE art_number = '3' GROUP BY doc_id"),
    "search_view": _sql(
        "v a hr",
        f"""
, t AS (SELECT a.doc_id, a.seq, string_agg(v.text, ' ' ORDER BY v.seq) AS text FROM a JOIN v USING (doc_id, block_id) GROUP BY ALL),
x AS (SELECT doc_id, seq FROM t WHERE contains({_KEY}, 'urgent') AND contains({_KEY}, 'redacao'))
SELECT doc_id, seq, 'article' AS kind FROM x UNION ALL SELECT DISTINCT doc_id, heading_seq, 'heading' FROM (
  SELECT x.doc_id, x.seq, hr.lv, max(hr.seq) AS heading_seq FROM x JOIN hr ON hr.doc_id = x.doc_id AND hr.seq < x.seq
  WHERE NOT EXISTS (SELECT 1 FROM hr y WHERE y.doc_id = x.doc_id AND y.seq > hr.seq AND y.seq < x.seq AND y.lv <= hr.lv) GROUP BY ALL)""",
    ),
    "search_paging": _sql(
        "v a",
        f"""
, t AS (SELECT a.doc_id, a.seq, string_agg(v.text, ' ' ORDER BY v.seq) AS text FROM a JOIN v USING (doc_id, block_id) GROUP BY ALL),
x AS (SELECT doc_id, seq FROM t WHERE contains({_KEY}, 'urgent'))
SELECT doc_id, seq, CAST(row_number() OVER w - 1 AS INTEGER) AS idx, count(*) OVER (PARTITION BY doc_id) AS n,
  coalesce(lag(seq) OVER w, max(seq) OVER (PARTITION BY doc_id)) AS prev_seq, coalesce(lead(seq) OVER w, min(seq) OVER (PARTITION BY doc_id)) AS next_seq
FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY seq)""",
    ),
    "heading_cards": _sql(
        "h",
        """
SELECT doc_id, seq, '  <div class="card card-titulo ' || CASE WHEN starts_with(data_section, 'norma') THEN 'nivel-norma' WHEN level = 'TITULO' THEN 'nivel-titulo' WHEN level = 'CAPITULO' THEN 'nivel-capitulo' WHEN level = 'SECAO' THEN 'nivel-secao' ELSE 'nivel-subsecao' END
  || '" data-section="' || data_section || '">' || text || CASE WHEN subtitle <> '' THEN '<br>' || subtitle ELSE '' END || '</div>' AS html FROM h""",
    ),
    "old_version_lines": _sql(
        "v",
        r"""
SELECT doc_id, seq, '    <p class="old-version"' || CASE WHEN ii <> '' THEN ' data-ident="' || ii || '"' ELSE '' END || '>' || ww || CASE WHEN nn <> '' THEN ' <span class="amendment-note">' || nn || '</span>' ELSE '' END || '</p>' AS html
FROM (SELECT *, text AS ww, trim(regexp_extract(text, '^(.+?)\s+[-–—]\s', 1)) AS ii, regexp_extract(text, '\((Redação dada|Revogado)[^)]*\)') AS nn FROM v WHERE role = 'version')""",
    ),
    "heading_markdown": _sql("h", "SELECT doc_id, seq, CASE level WHEN 'TITULO' THEN '#' WHEN 'CAPITULO' THEN '##' ELSE '###' END || ' ' || text || CASE WHEN subtitle <> '' THEN ' — ' || subtitle ELSE '' END AS markdown FROM h"),
    "next_versions": _sql("nv", "SELECT doc_id, seq, next_seq FROM nv"),
    "word_diff": _sql(
        "nv",
        f"""
, pairs AS (SELECT doc_id, seq, next_seq, {_WORDS.format("text")} AS x, {_WORDS.format("next_text")} AS y FROM nv),{_DIFF}
SELECT doc_id, seq, next_seq, CAST(len(list_filter(parts, lambda p: p.op = 'eq')) AS INTEGER) AS kept, array_to_string(list_transform(list_filter(parts, lambda p: p.op = 'del'), lambda p: p.word), ' ') AS removed,
  array_to_string(list_transform(list_filter(parts, lambda p: p.op = 'ins'), lambda p: p.word), ' ') AS added FROM pairs JOIN parts USING (x, y)""",
        recursive=True,
    ),
    "turn_diff": f"""
WITH RECURSIVE pairs AS (SELECT conv_id, turn, {_WORDS.format("coalesce(text, '')")} AS x, {_WORDS.format("next")} AS y
  FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations WHERE role = 'assistant') WHERE next IS NOT NULL),{_DIFF}
SELECT conv_id, turn, CAST(len(list_filter(parts, lambda p: p.op = 'eq')) AS INTEGER) AS kept, CAST(len(list_filter(parts, lambda p: p.op = 'del')) AS INTEGER) AS removed, CAST(len(list_filter(parts, lambda p: p.op = 'ins')) AS INTEGER) AS added
FROM pairs JOIN parts USING (x, y)""",
    "sheet_lint": _sql("sf", "SELECT * FROM sf"),
    "locale_sort": r"""
SELECT subject, CAST(row_number() OVER (ORDER BY subject COLLATE pt, subject) AS BIGINT) AS place
FROM (SELECT DISTINCT unnest(regexp_split_to_array(text, '[^\p{L}]+')) AS subject FROM documents) WHERE subject <> ''""",
    "outline_search": _sql(
        "ol",
        f"""
, h0 AS (SELECT doc_id, seq, parent_seq FROM ol WHERE contains({_KEY.replace("text", "title")}, 'capitulo')),
h1 AS (SELECT DISTINCT o.doc_id, o.seq, o.parent_seq FROM ol o JOIN h0 ON h0.doc_id = o.doc_id AND h0.parent_seq = o.seq), h2 AS (SELECT DISTINCT o.doc_id, o.seq, o.parent_seq FROM ol o JOIN h1 ON h1.doc_id = o.doc_id AND h1.parent_seq = o.seq),
h3 AS (SELECT DISTINCT o.doc_id, o.seq, o.parent_seq FROM ol o JOIN h2 ON h2.doc_id = o.doc_id AND h2.parent_seq = o.seq)
SELECT doc_id, seq, section_id FROM ol WHERE (doc_id, seq) IN (SELECT (doc_id, seq) FROM h0 UNION SELECT (doc_id, seq) FROM h1 UNION SELECT (doc_id, seq) FROM h2 UNION SELECT (doc_id, seq) FROM h3)""",
    ),
    "ref_resolve": _sql(
        "refs m",
        """
, r AS (SELECT row_no || '/' || line || '/' || step || '/' || sub AS ref_id, CAST(floor(row_no * 15 / 512) AS BIGINT) AS doc_id, law_prefix AS law, art, trim(detail) AS d FROM refs),
t AS (SELECT r.ref_id, r.doc_id, r.d, arg_min({'block_id': a.block_id, 'seq': a.seq}, (CASE WHEN law = '' THEN CAST(a.law_prefix <> '' AS INTEGER) ELSE 0 END, a.seq)) AS a
  FROM r JOIN a ON a.doc_id = r.doc_id AND a.art_number = r.art AND (law = '' OR a.law_prefix = law) GROUP BY ALL),
live AS (SELECT *, CASE WHEN role = 'caput' THEN 'caput' END AS c FROM m WHERE NOT is_old_version OR role = 'caput')
SELECT t.ref_id, t.doc_id, t.a.block_id AS block_id, CASE WHEN max(u.seq) IS NULL THEN 'card' WHEN lower(t.d) = 'caput' THEN 'caput' ELSE 'unit' END AS target, coalesce(arg_min(u.seq, (CAST(u.role <> 'caput' AS INTEGER), u.seq)), t.a.seq) AS target_seq
FROM t LEFT JOIN live u ON u.doc_id = t.doc_id AND u.block_id = t.a.block_id AND t.d <> '' AND (CASE WHEN lower(t.d) = 'caput' THEN u.c = 'caput' ELSE u.path = t.d OR u.identifier = t.d OR (u.identifier = 'Parágrafo único' AND t.d = '§ú') END)
GROUP BY t.ref_id, t.doc_id, t.d, t.a""",
    ),
    "marker_labels": _sql(
        "m",
        r"""
SELECT uid, replace(regexp_replace(regexp_replace(replace(label, 'Parágrafo único', '§ú'), 'Art\.\s*', '', 'g'), '\s+', '', 'g'), 'º', '') AS label FROM (
  SELECT uid, arg_min(CASE WHEN law_prefix <> '' THEN law_prefix || ':' ELSE '' END || CASE WHEN path <> '' THEN 'Art.' || art_number || ',' || path WHEN NOT starts_with(identifier, 'Art.') THEN 'Art.' || art_number || ',' || identifier ELSE identifier END, (doc_id, seq)) AS label
  FROM m GROUP BY uid)""",
    ),
    "article_cards": _sql(
        "m",
        f"""
, g AS (SELECT *, {_escaped("body")} AS b, {_escaped("text")} AS t, CASE WHEN path = '' THEN 1 ELSE len(str_split(path, ',')) END AS depth,
    list_prepend(regexp_replace(art_number, '^ADT', ''), list_transform(list_slice(str_split(path, ','), 1, len(str_split(path, ',')) - 1), lambda s: regexp_replace(s, '§\\s*(\\d+)º', '§\\1'))) AS above,
    trim(regexp_extract(text, '^(.+?)\\s+[-–—]\\s', 1)) AS ident FROM m),
l AS (SELECT *, CASE WHEN old THEN '    <p class="old-version' || CASE WHEN role = 'child' THEN ' art-para' ELSE '' END || '"' || CASE WHEN ident <> '' THEN ' data-ident="' || ident || '"' ELSE '' END || '>' || t || CASE WHEN note <> '' THEN ' <span class="amendment-note">' || note || '</span>' ELSE '' END || '</p>'
  ELSE '    <p' || CASE WHEN role = 'caput' THEN '' ELSE ' class="art-para"' || CASE WHEN depth > 1 THEN ' style="--depth:' || depth || '"' ELSE '' END END || '>'
    || CASE WHEN role <> 'caput' AND depth >= 2 THEN array_to_string(list_transform(range(1, len(above) + 1), lambda k: '<span class="indent-path" style="--col:' || (k - 1) || '">' || above[k] || '</span>'), '') ELSE '' END
    || '<span class="unit-id" data-uid="' || uid || '"' || CASE WHEN path <> '' THEN ' data-path="' || path || '"' ELSE '' END || '>' || identifier || '</span> — ' || CASE WHEN b <> '' AND has_strike THEN '<s>' || b || '</s>' ELSE b END
    || CASE WHEN fn_no IS NOT NULL THEN '<sup class="footnote-ref" data-note="' || fn_no || '">[' || fn_no || ']</sup>' ELSE '' END || '</p>'
    || CASE WHEN fn_no IS NOT NULL THEN chr(10) || '    <div class="footnote-box" data-note="' || fn_no || '">' || chr(10) || '      <button class="footnote-close">&times;</button>' || chr(10) || '      <strong>Nota ' || fn_no || ':</strong> note ' || fn_id || chr(10) || '    </div>' ELSE '' END END AS line FROM g),
q AS (SELECT doc_id, block_id, string_agg(line, chr(10) ORDER BY CASE role WHEN 'version' THEN 0 WHEN 'caput' THEN 1 ELSE 2 END, seq) AS lines, bool_or(role = 'caput' AND is_revoked) AND NOT bool_or(role = 'child' AND NOT is_old_version AND NOT is_revoked) AS revoked FROM l GROUP BY ALL)
SELECT a.doc_id, a.seq, '  <div class="card card-artigo' || CASE WHEN revoked THEN ' revoked' ELSE '' END || '" data-art="' || art_number || '"' || CASE WHEN law_prefix <> '' THEN ' data-law="' || law_prefix || '"' ELSE '' END || '>' || chr(10)
  || '    <span class="art-compact-label">Art. ' || art_number || '</span>' || chr(10) || CASE WHEN summary <> '' THEN '    <span class="art-summary">' || summary || '</span>' || chr(10) ELSE '' END
  || CASE WHEN law_prefix <> '' THEN '    <span class="law-badge">' || law_prefix || '</span>' || chr(10) ELSE '' END || lines || chr(10) || '  </div>' AS html FROM a JOIN q USING (doc_id, block_id)""",
    ),
    "article_markdown": _sql(
        "m",
        """
, l AS (SELECT *, CASE WHEN old THEN '*[Versão supersedida]* ' || text || CASE WHEN note <> '' THEN ' *' || note || '*' ELSE '' END
    ELSE concat_ws(chr(10) || chr(10), CASE WHEN role = 'caput' THEN nullif(trim(shown), '') ELSE CASE WHEN unit_type = 'ALINEA' THEN '  ' WHEN unit_type IN ('SUB_ALINEA', 'ITEM_NUM') THEN '    ' ELSE '' END || '**' || identifier || '** — ' || shown END,
      CASE WHEN fn_no IS NOT NULL THEN '> **Nota ' || fn_no || ':** note ' || fn_id || CASE WHEN is_private THEN ' *(nota privada)*' ELSE '' END END) END AS block,
    CASE WHEN role = 'caput' THEN 0 WHEN NOT old THEN 1 WHEN role = 'version' THEN 2 ELSE 3 END AS rk FROM (SELECT *, CASE WHEN has_strike AND body <> '' THEN '~~' || body || '~~' ELSE body END AS shown FROM m)),
q AS (SELECT doc_id, block_id, string_agg(block, chr(10) || chr(10) ORDER BY rk, seq) FILTER (rk < 2 AND block <> '') AS now, string_agg(block, chr(10) || chr(10) ORDER BY rk, seq) FILTER (rk > 1) AS older FROM l GROUP BY ALL)
SELECT a.doc_id, a.seq, concat_ws(chr(10) || chr(10), '#### Art. ' || CASE WHEN law_prefix <> '' THEN law_prefix || ':' ELSE '' END || art_number || CASE WHEN summary <> '' THEN ' — ' || summary ELSE '' END, now,
  '---' || chr(10) || chr(10) || '*Versões anteriores deste artigo:*' || chr(10) || chr(10) || older) AS markdown FROM a JOIN q USING (doc_id, block_id)""",
    ),
    "subject_markdown": _sql(
        "refs entries",
        """
, rl AS (SELECT row_no, string_agg(chr(10) || '- Art. ' || CASE WHEN law_prefix <> '' THEN law_prefix || ':' ELSE '' END || art || CASE WHEN detail <> '' THEN ', ' || detail ELSE '' END || CASE WHEN hint <> '' THEN ' *(' || hint || ')*' ELSE '' END, '' ORDER BY line, step, sub) AS rs FROM refs GROUP BY row_no),
x AS (SELECT e.*, coalesce(rs, '') AS rs, array_to_string(list_transform(vides, lambda z: chr(10) || chr(10) || '*Vide: ' || replace(z, '|', ' — ') || '*'), '') AS vs FROM entries e LEFT JOIN rl USING (row_no))
SELECT subject, chr(10) || '## ' || subject || coalesce(string_agg(rs, '' ORDER BY row_no) FILTER (sub_subject = ''), '') || coalesce(string_agg(vs, '' ORDER BY row_no) FILTER (sub_subject = ''), '')
  || coalesce(string_agg(chr(10) || chr(10) || '### ' || sub_subject || rs || vs, '' ORDER BY row_no, sub_subject) FILTER (sub_subject <> ''), '') AS markdown FROM x GROUP BY subject""",
    ),
    "element_json": _sql(
        "m h",
        """
, o AS (SELECT *, '{"unit_type":"' || unit_type || '","identifier":' || to_json(identifier) || ',"uid":' || to_json(uid) || ',"text":' || to_json(text) || ',"runs":[' || CASE WHEN instr(text, ' - ') > 0 THEN
      '{"text":' || to_json(substr(text, 1, instr(text, ' - '))) || ',"bold":true' || st || '},{"text":' || to_json(substr(text, instr(text, ' - ') + 1)) || st || '}' ELSE '{"text":' || to_json(text) || st || '}' END
    || '],"is_revoked":' || is_revoked || ',"is_old_version":' || is_old_version || ',"amendment_note":' || to_json(note) || ',"children":[]}' AS j FROM (SELECT *, CASE WHEN has_strike THEN ',"strike":true' ELSE '' END AS st FROM m)),
q AS (SELECT doc_id, block_id, any_value(j) FILTER (role = 'caput') AS caput, coalesce(string_agg(j, ',' ORDER BY seq) FILTER (role = 'child'), '') AS children, coalesce(string_agg(j, ',' ORDER BY seq) FILTER (role = 'version'), '') AS versions,
  bool_or(role = 'caput' AND is_revoked) AND NOT bool_or(role = 'child' AND NOT is_old_version AND NOT is_revoked) AS revoked FROM o GROUP BY ALL)
SELECT doc_id, seq, '{"type":"heading","level":"' || level || '","text":' || to_json(text) || ',"subtitle":' || to_json(subtitle) || ',"data_section":"' || data_section || '"}' AS json FROM h
UNION ALL SELECT a.doc_id, a.seq, '{"type":"article","art_number":"' || art_number || '","is_adt":' || is_adt || ',"is_revoked":' || revoked || ',"caput":' || caput || ',"children":[' || children || '],"all_versions":[' || versions || ']'
  || CASE WHEN summary <> '' THEN ',"summary":"' || summary || '"' ELSE '' END || CASE WHEN law_name <> '' THEN ',"law_name":' || to_json(law_name) ELSE '' END || CASE WHEN law_prefix <> '' THEN ',"law_prefix":"' || law_prefix || '"' ELSE '' END || '}' FROM a JOIN q USING (doc_id, block_id)""",
    ),
    "reference_entries": _sql("en", "SELECT doc_id, seq, category_no, group_no, title, md5(html) AS html_md5, art_ref FROM en"),
    "reference_filter": _sql(
        "en",
        f"""
SELECT doc_id, seq, trim(regexp_split_to_array(replace(replace(replace(coalesce(art_ref, ''), 'º', ''), '°', ''), 'ª', ''), '[,\\s]')[1]) AS article
FROM (SELECT *, regexp_replace(html, '<[^>]*>', '', 'g') AS text FROM en) WHERE (contains({_KEY}, 'the') AND contains({_KEY}, 'tion')) OR (contains({_KEY.replace("text", "title")}, 'the') AND contains({_KEY.replace("text", "title")}, 'tion'))""",
    ),
    "information_pages": _sql(
        "ln",
        """
SELECT doc_id, CAST(length(html) AS INTEGER) AS chars, md5(html) AS html_md5 FROM (SELECT doc_id, string_agg(CASE WHEN heading THEN '<h3>' ELSE '<p>' END || replace(replace(replace(label, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || CASE WHEN heading THEN '</h3>' ELSE '</p>' END, chr(10) ORDER BY seq) AS html FROM ln GROUP BY doc_id)""",
    ),
    "breadcrumbs": _sql(
        "hr a",
        f"""
{_CRUMBS}
SELECT doc_id, seq, crumbs || ' › ' || label AS text FROM cr""",
    ),
    "unit_breadcrumbs": _sql(
        "hr a m",
        f"""
{_CRUMBS}
SELECT m.doc_id, m.seq, crumbs || ' › ' || label || ' › ' || replace(path, ',', ' › ') AS text FROM m JOIN cr ON cr.doc_id = m.doc_id AND cr.seq = m.art_seq WHERE path <> ''""",
    ),
    "index_rows": _sql(
        "refs entries",
        f"""
, su AS (SELECT CASE WHEN law_prefix <> '' THEN law_prefix || ':' ELSE '' END || art_number AS key, arg_max(summary, (doc_id, seq)) AS summary FROM a WHERE summary <> '' GROUP BY 1),
sel AS (SELECT *, '' AS query FROM entries UNION ALL SELECT *, 'small brass' FROM entries WHERE (contains(lower(subject), 'small') AND contains(lower(subject), 'brass')) OR (contains(lower(sub_subject), 'small') AND contains(lower(sub_subject), 'brass'))
  OR (sub_subject = '' AND subject IN (SELECT subject FROM entries WHERE contains(lower(sub_subject), 'small') AND contains(lower(sub_subject), 'brass')))),
x AS (
  SELECT DISTINCT query, subject, 0 AS row_no, 0 AS "at", 'subject' AS kind, lower(subject) AS key, subject IN (SELECT subject FROM refs) AS has_refs, subject AS t, '' AS hint FROM sel
  UNION ALL SELECT query, subject, row_no, 0, 'sub', lower(subject) || '|' || lower(sub_subject), row_no IN (SELECT row_no FROM refs), '— ' || sub_subject, '' FROM sel WHERE sub_subject <> ''
  UNION ALL SELECT query, sel.subject, row_no, r."at", 'ref', '', true, r.label, r.hint FROM sel JOIN (SELECT row_no, row_number() OVER (PARTITION BY row_no ORDER BY line, step, sub) AS "at",
      CASE WHEN law_prefix <> '' THEN law_prefix || ' ' ELSE '' END || 'art. ' || art || CASE WHEN detail <> '' THEN ', ' || detail ELSE '' END AS label, CASE WHEN hint <> '' THEN hint ELSE coalesce(su.summary, '') END AS hint
    FROM refs LEFT JOIN su ON su.key = CASE WHEN law_prefix <> '' THEN law_prefix || ':' ELSE '' END || art) r USING (row_no)
  UNION ALL SELECT query, subject, row_no, 1000000 + pos, 'vide', lower(CASE WHEN r <> '' THEN l || '|' || r ELSE l END), false, CASE WHEN r <> '' THEN l || ' — ' || r ELSE target END, '' FROM (
    SELECT *, trim(str_split(target, '|')[1]) AS l, CASE WHEN contains(target, '|') THEN trim(substr(target, instr(target, '|') + 1)) ELSE '' END AS r
    FROM (SELECT query, subject, row_no, unnest(range(0, len(vides))) AS pos, unnest(vides) AS target FROM sel)))
SELECT query, subject, CAST(row_no AS BIGINT) AS row_no, CAST("at" AS BIGINT) AS "at", kind, key, has_refs, hint, CASE WHEN query = '' THEN e ELSE regexp_replace(e, '(?i)(sm[aáàâãä]ll|br[aáàâãä]ss)', '<mark>\\1</mark>', 'g') END AS html
FROM (SELECT *, replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS e FROM x)""",
    ),
    "reference_tab": _sql(
        "en",
        f"""
, hit AS (SELECT * FROM (SELECT *, regexp_replace(html, '<[^>]*>', '', 'g') AS text FROM en WHERE category_no = 1) WHERE contains({_KEY}, 'tion') OR contains({_KEY.replace("text", "title")}, 'tion'))
SELECT doc_id, group_no, seq, 'entry' AS kind, md5(html || CASE WHEN art_ref IS NOT NULL THEN ' — Art. ' || replace(replace(replace(art_ref, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') ELSE '' END) AS html,
  trim(regexp_split_to_array(replace(replace(replace(coalesce(art_ref, ''), 'º', ''), '°', ''), 'ª', ''), '[,\\s]')[1]) AS article FROM hit
UNION ALL SELECT doc_id, group_no, min(seq), 'title', md5(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')), '' FROM hit WHERE title <> '' GROUP BY doc_id, group_no, title""",
    ),
    "marker_paths": _sql(
        "v p0",
        """
SELECT v.doc_id, v.seq, CASE WHEN coalesce(path, '') = '' THEN '' ELSE '/' || array_to_string(list_transform(range(1, len(str_split(path, ',')) + 1), lambda k: array_to_string(list_slice(str_split(path, ','), 1, k), ',')), '/') END AS paths
FROM v LEFT JOIN p0 ON p0.doc_id = v.doc_id AND p0.seq = v.seq""",
    ),
    "snapshot_changes": _sql("a", "SELECT art_number, 'removed' AS change FROM (SELECT art_number FROM a WHERE n_versions > 1 EXCEPT SELECT art_number FROM a WHERE summary <> '') UNION ALL SELECT art_number, 'added' FROM (SELECT art_number FROM a WHERE summary <> '' EXCEPT SELECT art_number FROM a WHERE n_versions > 1)"),
}
ORACLE_SQL["lint_report"] = f"SELECT code, '{CODE_LABELS['ART_NO_ORDINAL']}' AS label, count(*) AS n FROM ({ORACLE_SQL['lint_codes']}) GROUP BY code"
_ODD = ODD_SQL.format(statute=STATUTE_SQL).format(**_NAMES)
_quoted = lambda text: "'" + text.replace("'", "''") + "'"
_LINT = f"""
, ctx AS (SELECT *, last_value(CASE WHEN unit_type = 'ARTIGO' THEN art_number END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS article FROM c),
lint AS (SELECT doc_id, seq, code, CASE WHEN article IS NULL THEN '(antes do 1º artigo)' ELSE 'Art. ' || article END AS context,
    CASE code WHEN 'ART_NO_ORDINAL' THEN {_fault("ART_NO_ORDINAL", "article")} WHEN 'ART_UNMATCHED' THEN {_fault("ART_UNMATCHED")} WHEN 'PARA_UNMATCHED' THEN {_fault("PARA_UNMATCHED")} ELSE {_fault("INCISO_L", "regexp_extract(text, '^[^ ]+')")} END AS description, substr(text, 1, 100) AS text
  FROM (SELECT *, CASE WHEN is_centered OR text = '' THEN NULL WHEN starts_with(text, 'Art.') AND unit_type <> 'ARTIGO' THEN 'ART_UNMATCHED'
      WHEN unit_type = 'ARTIGO' THEN CASE WHEN CAST(regexp_extract(text, '([0-9]+)', 1) AS BIGINT) <= 9 AND NOT regexp_matches(text, '^Art\\.\\s*[0-9]+[ºª°]') THEN 'ART_NO_ORDINAL' END
      WHEN starts_with(text, '§') AND NOT regexp_matches(text, '^§\\s*[0-9]') THEN 'PARA_UNMATCHED' WHEN regexp_matches(text, '^l[IVXLC]*\\s*[-–—]') THEN 'INCISO_L' END AS code FROM ctx) WHERE code IS NOT NULL)"""
_LABEL = "CASE code " + " ".join(f"WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in CODE_LABELS.items()) + " END"
ORACLE_SQL["lint_listing"] = _sql("c", _LINT + f" SELECT CAST(list_position([{', '.join(map(_quoted, CODES))}], code) - 1 AS INTEGER) AS code_no, code, {_LABEL} AS label, doc_id, seq, context, description, text FROM lint", p=_ODD)
ORACLE_SQL["odd_units"] = _sql(
    "c",
    r"""
SELECT doc_id, seq, unit_type, CASE WHEN unit_type = 'INCISO' THEN replace(regexp_extract(text, '^l?[IVXLC]+'), 'l', 'I') ELSE identifier END AS identifier,
  CASE unit_type WHEN 'PARAGRAFO_NUM' THEN 'p12' WHEN 'INCISO' THEN replace(regexp_extract(text, '^l?[IVXLC]+'), 'l', 'I') ELSE '' END AS suffix FROM c WHERE seq % 4 = 1""",
    p=_ODD,
)
_SHEET_ISSUES = """
SELECT '  Linha ' || row_no || ' (' || context || ') · ' || field || '[' || line_no || '] ''' || line || ''': ' || fault AS message,
  row_no || '/' || CASE WHEN field = 'Dispositivos' THEN 0 ELSE 1 END || '/' || line_no || '/' || fault_no AS place FROM sf JOIN ft USING (row_no, field, line_no)"""
_ISSUES = f"""
SELECT 'ref_cruzada' AS category, 'erro' AS severity, 'Art. ' || key || ' não encontrado' AS message, context, CAST(row_no AS VARCHAR) AS place FROM ({ORACLE_SQL["dangling_refs"]})
UNION ALL SELECT 'vide', 'aviso', '''' || replace(target, '|', ' — ') || ''' não encontrado', context, CAST(row_no AS VARCHAR) FROM ({ORACLE_SQL["dangling_see_also"]})
UNION ALL SELECT 'formato', 'aviso', message, '', place FROM ({_sql("sf", _SHEET_ISSUES)})
UNION ALL SELECT 'docx', 'aviso', '[' || code || '] ' || description, context, doc_id || '/' || seq FROM ({_sql("c", _LINT + " SELECT * FROM lint", p=_ODD)})"""
ORACLE_SQL["issue_listing"] = f"SELECT CAST(list_position([{', '.join(map(_quoted, CATEGORIES))}], category) - 1 AS INTEGER) AS category_no, * FROM ({_ISSUES})"
ORACLE_SQL["issues_json"] = f"""SELECT '{{"category":' || to_json(category) || ',"severity":' || to_json(severity) || ',"message":' || to_json(message) || CASE WHEN context <> '' THEN ',"context":' || to_json(context) ELSE '' END || '}}' AS value FROM ({_ISSUES})"""
ORACLE_SQL["issue_totals"] = f"SELECT count(*) FILTER (severity = 'erro') AS errors, count(*) FILTER (severity = 'aviso') AS warnings, count(*) FILTER (severity = 'erro') > 0 AS fails, count(*) > 0 AS fails_strict FROM ({_ISSUES})"
_EVENTS = MARKERS_SQL.format(clicks="clicks")
_STATE = f"""
SELECT doc_id, uid, colour, "at", CAST(row_number() OVER (PARTITION BY doc_id ORDER BY "at", writer, n) AS INTEGER) AS position FROM (
  SELECT * FROM (SELECT DISTINCT * FROM ({_EVENTS})) e WHERE op <> 'clear'
  QUALIFY row_number() OVER (PARTITION BY doc_id, uid ORDER BY "at" DESC, writer DESC, n DESC) = 1) m
WHERE op = 'mark' AND NOT EXISTS (SELECT 1 FROM ({_EVENTS}) c WHERE c.op = 'clear' AND (c.doc_id = m.doc_id OR c.doc_id IS NULL) AND (c."at" > m."at" OR (c."at" = m."at" AND (c.writer > m.writer OR (c.writer = m.writer AND c.n >= m.n)))))"""
ORACLE_SQL["marker_state"] = _STATE
ORACLE_SQL["marker_colours"] = f"""
SELECT doc_id, n, CAST(coalesce(list_min(list_filter(range(0, 8), lambda x: NOT list_contains(used, x))), n % 8) AS INTEGER) AS colour
FROM (SELECT doc_id, count(*) AS n, list(DISTINCT colour) AS used FROM ({_STATE}) GROUP BY doc_id)"""
_FILES = "SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS BIGINT) AS place, trim(text) AS shown, CASE WHEN contains(text, ' - ') THEN 2 ELSE 1 END AS n_runs FROM p WHERE seq % 7 <> 3"
ORACLE_SQL["docx_paragraphs"] = _sql("p", f"SELECT doc_id, place AS seq, shown AS text, is_centered, has_strike AND shown <> '' AS has_strike, indent_left, n_runs, true AS bold, CASE WHEN seq % 5 = 1 AND seq % 3 < 2 THEN 'http://x.org/' || seq % 3 END AS url, CAST(fn_id AS INTEGER) AS fn_id FROM ({_FILES})")
ORACLE_SQL["docx_lint"] = _sql("c", _LINT + " SELECT doc_id, seq, code, context FROM lint", p=f"SELECT doc_id, place AS seq, shown AS text, is_centered, has_strike, indent_left, fn_id FROM ({_FILES.replace('FROM p', f'FROM ({STATUTE_SQL.format(**_NAMES)})')})")
ORACLE_SQL["docx_styled"] = _sql("p", f"""
SELECT doc_id, place AS seq, CASE WHEN is_centered THEN 'Heading1' END AS style, CASE WHEN seq % 5 = 1 THEN '' ELSE text END AS text, CASE WHEN seq % 5 = 1 THEN 0 ELSE n_runs END + CAST(fn_id IS NOT NULL AS INTEGER) AS n_runs,
  seq % 5 = 1 OR NOT (contains(text, ' - ') AND trim(substr(text, instr(text, ' - ') + 3)) <> '') AS all_bold, seq % 5 = 1 OR shown = '' AS is_empty FROM ({_FILES})""")
ORACLE_SQL["docx_footnotes"] = _sql("p", f"""
SELECT with_private, doc_id, CAST(fn_id AS INTEGER) AS fn_id, kind, CASE WHEN kind = 'summary' THEN 'sum ' || fn_id ELSE '' END AS summary, CASE WHEN kind = 'summary' THEN 's sum ' ELSE 'note ' END || fn_id AS text
FROM (SELECT DISTINCT doc_id, fn_id, {FOOTNOTE_KIND} AS kind FROM p WHERE fn_id IS NOT NULL), (VALUES (false), (true)) w(with_private) WHERE kind IS NOT NULL AND (with_private OR kind <> 'private')""")
ORACLE_SQL["xlsx_entries"] = _sql("sheet", """
SELECT CAST(floor(row_no / 1000) * 1000000 + row_no % 1000 + 2 AS BIGINT) AS row_no, subject, sub_subject, devices, array_to_string(list_filter(list_transform(str_split(see_also, chr(10)), lambda x: trim(x)), lambda x: x <> ''), '/') AS vides
FROM sheet WHERE row_no % 17 <> 5 AND row_no % 13 <> 4""")
ORACLE_SQL["xlsx_laws"] = "SELECT * FROM (VALUES ('Lei 1', 'LO'), ('Lei 2', 'CF')) t(law_name, law_prefix)"
ORACLE_SQL["ref_highlights"] = ORACLE_SQL["ref_resolve"] + "\nHAVING max(u.seq) IS NOT NULL OR t.d = ''"
ORACLE_SQL["unit_depths"] = _sql("v p0", """
SELECT doc_id, seq, depth, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY depth, seq) AS INTEGER) AS place FROM (
  SELECT v.doc_id, v.seq, CAST(CASE WHEN coalesce(path, '') = '' THEN 0 ELSE len(str_split(path, ',')) END AS INTEGER) AS depth FROM v LEFT JOIN p0 ON p0.doc_id = v.doc_id AND p0.seq = v.seq)""")
ORACLE_SQL["markdown_lines"] = _sql("en", "SELECT doc_id, seq, md5(replace(replace(replace(regexp_replace(html, '<b>(.*?)</b>', '**\\1**', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')) AS markdown_md5 FROM en")
ORACLE_SQL["outline_pages"] = f"""
WITH o AS (SELECT x.*, coalesce(r.art_range, '') AS rg FROM ({ORACLE_SQL["systematic_outline"]}) x LEFT JOIN ({ORACLE_SQL["section_ranges"]}) r ON r.doc_id = x.doc_id AND r.section_id = x.section_id),
j AS (SELECT *, '","section_id":"' || section_id || '"' || CASE WHEN is_leaf AND rg <> '' THEN ',"art_range":"' || rg || '"' ELSE '' END || '}}' AS rest FROM o),
l3 AS (SELECT doc_id, seq, parent_seq, '{{"title":"' || title || '","children":[]' || substr(rest, 2) AS js FROM j WHERE depth = 3),
""" + ",\n".join(f"""l{k} AS (SELECT j.doc_id, j.seq, j.parent_seq, '{{"title":"' || title || '","children":[' || coalesce(kids, '') || ']' || substr(rest, 2) AS js
  FROM j LEFT JOIN (SELECT doc_id, parent_seq, string_agg(js, ',' ORDER BY seq) AS kids FROM l{k + 1} GROUP BY doc_id, parent_seq) c ON c.doc_id = j.doc_id AND c.parent_seq = j.seq WHERE depth = {k})""" for k in (2, 1, 0)).replace("{{", "{") + """
SELECT doc_id, '[' || string_agg(js, ',' ORDER BY seq) || ']' AS json FROM l0 GROUP BY doc_id"""
ORACLE_SQL["outline_pages"] = ORACLE_SQL["outline_pages"].replace("'{{", "'{").replace("'}}'", "'}'")
ORACLE_SQL["index_tabs"] = f"""
SELECT 'systematic' AS tab, doc_id || '/' || seq AS key FROM ({ORACLE_SQL["outline_search"]})
UNION ALL SELECT 'subjects', subject FROM ({ORACLE_SQL["subject_filter"]}) WHERE query = 'below'
UNION ALL SELECT 'references', doc_id || '/' || seq FROM ({ORACLE_SQL["reference_tab"]}) WHERE kind = 'entry'
UNION ALL SELECT 'info', CAST(doc_id AS VARCHAR) FROM ({ORACLE_SQL["information_pages"]})"""
ORACLE_SQL["category_markdown"] = _sql(
    "ln en",
    r"""
, t AS (SELECT ln.doc_id, ln.seq, ln.kind, ln.label, CAST(count(*) FILTER (ln.kind = 'category') OVER w AS BIGINT) AS category_no, last_value(CASE WHEN ln.kind = 'category' THEN ln.label END IGNORE NULLS) OVER w AS category,
    '- ' || replace(replace(replace(regexp_replace(html, '<b>(.*?)</b>', '**\1**', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') || CASE WHEN coalesce(art_ref, '') <> '' THEN ' — Art. ' || art_ref ELSE '' END AS entry
  FROM ln LEFT JOIN en ON en.doc_id = ln.doc_id AND en.seq = ln.seq WINDOW w AS (PARTITION BY ln.doc_id ORDER BY ln.seq ROWS UNBOUNDED PRECEDING))
SELECT doc_id, category_no, md5(chr(10) || '## ' || coalesce(any_value(category), 'Geral') || coalesce(chr(10) || string_agg(CASE kind WHEN 'group' THEN chr(10) || '### ' || label ELSE entry END, chr(10) ORDER BY seq) FILTER (kind <> 'category'), '')) AS markdown
FROM t GROUP BY doc_id, category_no""",
)
ORACLE_SQL["combined_view"] = _sql(
    "refs v a hr",
    f"""
, t AS (SELECT a.doc_id, a.seq, string_agg(v.text, ' ' ORDER BY v.seq) AS text FROM a JOIN v USING (doc_id, block_id) GROUP BY ALL),
mk AS (SELECT v.doc_id, v.block_id, v.seq, law_prefix || '/' || uid AS uid FROM v JOIN (SELECT doc_id, block_id, law_prefix FROM a) USING (doc_id, block_id)),
x AS (SELECT a.doc_id, a.seq FROM a JOIN t ON t.doc_id = a.doc_id AND t.seq = a.seq WHERE contains({_KEY}, 'dada') AND (law_prefix, art_number) IN (SELECT (law_prefix, art) FROM refs WHERE subject IN ('Brand#11', 'Brand#23'))
  AND (a.doc_id, a.block_id) IN (SELECT (doc_id, block_id) FROM mk WHERE (doc_id, uid) IN (SELECT (doc_id, uid) FROM mk WHERE seq % 3 = 0 AND doc_id % 2 = 0)))
SELECT doc_id, seq, 'article' AS kind FROM x UNION ALL SELECT DISTINCT doc_id, heading_seq, 'heading' FROM (
  SELECT x.doc_id, x.seq, hr.lv, max(hr.seq) AS heading_seq FROM x JOIN hr ON hr.doc_id = x.doc_id AND hr.seq < x.seq
  WHERE NOT EXISTS (SELECT 1 FROM hr y WHERE y.doc_id = x.doc_id AND y.seq > hr.seq AND y.seq < x.seq AND y.lv <= hr.lv) GROUP BY ALL)""",
)
_EDITION = EDITION_SQL.format(statute=STATUTE_SQL).format(**_NAMES)
_TREE = """
, g AS (SELECT doc_id, block_id, string_agg(role || '|' || uid || '|' || unit_type || '|' || identifier || '|' || text || '|' || is_old_version || '|' || is_revoked, chr(10) ORDER BY seq) AS body
  FROM (SELECT v.*, v.uid FROM v) GROUP BY doc_id, block_id),
cs AS (SELECT a.doc_id, a.seq, coalesce(arg_max(h.data_section, h.seq), '') AS section_id FROM a LEFT JOIN h ON h.doc_id = a.doc_id AND h.seq < a.seq GROUP BY ALL)
SELECT a.doc_id, law_prefix, art_number, CAST(row_number() OVER (PARTITION BY a.doc_id, law_prefix, art_number ORDER BY a.seq) AS INTEGER) AS nth, section_id, law_prefix || body AS body
FROM a JOIN g USING (doc_id, block_id) JOIN cs ON cs.doc_id = a.doc_id AND cs.seq = a.seq"""
ORACLE_SQL["edition_changes"] = f"""
SELECT doc_id, law_prefix, art_number, nth, CASE WHEN x.body IS NULL THEN 'added' WHEN y.body IS NULL THEN 'removed' WHEN x.body <> y.body THEN 'changed' ELSE 'moved' END AS change
FROM ({_sql("v a h", _TREE)}) x FULL JOIN ({_sql("v a h", _TREE, p=_EDITION)}) y USING (doc_id, law_prefix, art_number, nth)
WHERE x.body IS DISTINCT FROM y.body OR x.section_id IS DISTINCT FROM y.section_id"""
_of = lambda name: f"SELECT count(*) FROM ({ORACLE_SQL[name]})"
ORACLE_SQL["issue_counts"] = f"""
SELECT * FROM (SELECT 'ref_cruzada' AS category, 'erro' AS severity, ({_of("dangling_refs")}) AS n UNION ALL SELECT 'vide', 'aviso', ({_of("dangling_see_also")})
  UNION ALL SELECT 'formato', 'aviso', ({_of("sheet_lint")}) UNION ALL SELECT 'docx', 'aviso', ({_of("lint_codes")})) WHERE n > 0"""
