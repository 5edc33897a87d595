"""Tables of the statute model. Absent text is '', order is always a column."""

RUN = "struct<text:string,bold:boolean,italic:boolean,strike:boolean,hyperlink_url:string,hyperlink_anchor:string>"
RUNS = f"array<{RUN}>"

PARAGRAPHS = f"doc_id long, seq long, text string, runs {RUNS}, is_centered boolean, has_strike boolean, indent_left int, bookmark_name string, footnote_ids array<int>"
FOOTNOTE_DEFS = f"fn_id int, kind string, summary string, paragraphs array<struct<runs:{RUNS},indent:boolean>>"
STYLED = "seq long, style string, runs array<struct<text:string,bold:boolean>>, text string, all_bold boolean, is_empty boolean"
SUBJECT_ROWS = "row_no int, subject string, sub_subject string, devices string, see_also string, width int"
LAWS = "law_name string, law_prefix string"

UNIT_TYPES = ("TITULO", "CAPITULO", "SECAO", "SUBSECAO", "SUBTITLE", "ARTIGO", "PARAGRAFO_UNICO", "PARAGRAFO_NUM", "INCISO", "ALINEA", "SUB_ALINEA", "ITEM_NUM", "EMPTY", "OTHER")
HEADINGS = ("TITULO", "CAPITULO", "SECAO", "SUBSECAO")
SUB_UNITS = ("PARAGRAFO_UNICO", "PARAGRAFO_NUM", "INCISO", "ALINEA", "SUB_ALINEA", "ITEM_NUM", "OTHER")
