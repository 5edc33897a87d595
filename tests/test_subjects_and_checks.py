from pyspark.sql import functions as F

from lexflow.functions import text as T
from lexflow.operators import checks, markdown, search, subjects
from lexflow.schemas import SUBJECT_ROWS

ROWS = [
    (2, "Mesa", "", "211-213\n175,II\n176,§10(dica)\n9-5\nxx", "Câmara|Eleição\nMesa", 4),
    (3, "Câmara", "Eleição", "LO:23,pu\nlo:3", "", 4),
    (4, "câmara", "", "4-C", "NADA", 4),
    (5, "", "x", "1", "", 4),
]


def entries(spark):
    return subjects.entries(spark.createDataFrame(ROWS, SUBJECT_ROWS))


def test_references(spark):
    lettered = spark.createDataFrame([("212-A",), ("212-B",), ("9-A",)], "art_number string")
    refs = subjects.references(entries(spark), lettered).orderBy("row_no", "line", "step", "sub").collect()
    assert [(r.row_no, r.law_prefix, r.art, r.detail, r.hint) for r in refs] == [
        (2, "", "211", "", ""), (2, "", "212", "", ""), (2, "", "212-A", "", ""), (2, "", "212-B", "", ""), (2, "", "213", "", ""),
        (2, "", "175", "II", ""), (2, "", "176", "§ 10º", "dica"), (3, "LO", "23", "§ú", ""), (4, "", "4-C", "", ""),
    ]
    known = subjects.transitional_refs(subjects.references(entries(spark)), spark.createDataFrame([("ADT4-C",)], "art_number string"))
    assert [r.art for r in known.where("row_no = 4").collect()] == ["ADT4-C"]


def test_nested_index_and_markdown(spark):
    index = subjects.nested_index(entries(spark), subjects.references(entries(spark)))
    assert [r.subject for r in index.collect()] == ["Câmara", "câmara", "Mesa"]
    assert {r.subject: len(r.refs) for r in subjects.all_refs(index).collect()} == {"Câmara": 1, "câmara": 1, "Mesa": 5}
    text = markdown.subject_index_markdown(index)
    assert text.startswith("# Índice Remissivo\n\n## Câmara\n\n### Eleição\n- Art. LO:23, § ú".replace("§ ú", "§ú"))
    assert "- Art. 176, § 10º *(dica)*" in text and "\n*Vide: Câmara — Eleição*" in text


def test_see_also(spark):
    got = {(r.row_no, r.pos): (r.label, r.subject_key, r.found) for r in subjects.see_also_targets(entries(spark)).collect()}
    assert got == {(2, 0): ("Câmara — Eleição", "camara|eleicao", True), (2, 1): ("Mesa", "mesa", True), (4, 0): ("NADA", "nada", False)}
    assert [r.target for r in checks.dangling_see_also(entries(spark)).collect()] == ["NADA"]


def test_dangling_references(spark):
    arts = spark.createDataFrame([("175", ""), ("23", "LO"), ("211", "XX")], "art_number string, law_prefix string")
    got = {r.key: r.context for r in checks.dangling_references(subjects.references(entries(spark)), arts).collect()}
    assert got == {"212": "Mesa", "213": "Mesa", "176": "Mesa", "4-C": "câmara"}


FAULTS = {
    "1, II": ["espaço após vírgula — use '1,II' em vez de '1, II'"],
    "LO: 3": ["espaço ao redor do ':' no prefixo — use 'SIGLA:artigo' sem espaços: 'LO: 3'"],
    "ZZ:3": ["prefixo 'ZZ' não cadastrado na aba Normas (prefixos conhecidos: CF, LO)"],
    "9-5": ["range inválido: início (9) deve ser menor que fim (5)"],
    "(x)": ["referência vazia após extração de prefixo/dica"],
    "abc": ["número de artigo inválido: 'abc'"],
    "1,II,I": ["estrutura de detalhe inválida (esperado: inciso,alínea,item): 'II,I'"] and ["múltiplos incisos na mesma linha — use linhas separadas: 'II' e 'I'"],
    "1,a,b": ["múltiplas alíneas na mesma linha — use linhas separadas"],
    "1,I,1": ["estrutura de detalhe inválida: 'I,1'"],
    "1,I,a,b": ["estrutura de detalhe inválida (esperado: inciso,alínea,item): 'I,a,b'"],
    "1,I,a,1,2": ["detalhe com muitas partes: 'I,a,1,2'"],
    "1,Zz": ["detalhe desconhecido: 'Zz'"],
    **{s: [] for s in ("1", "1-2", "LO:1,caput", "1,PU", "1,§ú", "1,§3", "1,I,a", "1,a,2", "1,§1,I", "1,I,a,3", "lo:4-C(dica)", "ADT3")},
}


def test_line_faults(spark):
    lines = spark.createDataFrame([(k,) for k in FAULTS], "line string")
    assert {r.line: r.faults for r in checks.device_faults(lines, ["LO", "CF"]).collect()} == FAULTS


def test_sheet_faults_and_report(spark):
    rows = spark.createDataFrame([(2, "A", "b", "9-5", "x|y|z\n|q\nr|", 4), (3, " ", "", "zzz", "", 4)], SUBJECT_ROWS)
    got = checks.sheet_faults(rows, []).orderBy("field", "line_no", "fault_no").collect()
    assert [(r.field, r.line_no) for r in got] == [("Dispositivos", 1), ("Vide", 1), ("Vide", 2), ("Vide", 3)]
    assert got[0].message == "  Linha 2 (A > b) · Dispositivos[1] '9-5': range inválido: início (9) deve ser menor que fim (5)"


def test_document_lint(spark):
    texts = ["§ x", "Art. x", "Art. 5 - y", "l - z", "Art. 10 - ok", "§ 1º - ok", "lI - w"]
    rows = spark.createDataFrame([(1, k, t, False) for k, t in enumerate(texts)], "doc_id long, seq long, text string, is_centered boolean")
    lint = checks.document_lint(rows)
    assert [(r.seq, r.code, r.context) for r in lint.orderBy("seq").collect()] == [(0, "PARA_UNMATCHED", "(antes do 1º artigo)"), (1, "ART_UNMATCHED", "(antes do 1º artigo)"), (2, "ART_NO_ORDINAL", "Art. 5"), (3, "INCISO_L", "Art. 5"), (6, "INCISO_L", "Art. 10")]
    assert [(r.code, r.n) for r in checks.lint_report(lint).collect()] == [("PARA_UNMATCHED", 1), ("ART_UNMATCHED", 1), ("ART_NO_ORDINAL", 1), ("INCISO_L", 2)]


def test_failure(spark):
    warn = spark.createDataFrame([("vide", "aviso", "m", "")], checks.ISSUES)
    assert not checks.failed(warn) and checks.failed(warn, strict=True)
    assert checks.failed(spark.createDataFrame([("ref_cruzada", "erro", "m", "c")], checks.ISSUES))
    assert checks.issues_json(warn).first().value == '{"category":"vide","severity":"aviso","message":"m"}'
    assert [tuple(r) for r in checks.issue_counts(warn).collect()] == [("vide", "aviso", 1)]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.search_key(F.lit("AÇÃO\xa0é"))) == "acao e"
    assert one(T.highlight(F.lit("Ação <b> de ação"), ["de acao"], ["acao"])) == "<mark>Ação</mark> &lt;b&gt; <mark>de ação</mark>"
    assert one(T.heading_short_title(F.lit("TÍTULO II"), F.lit("DA MESA"))) == "II-DA MESA"
    assert one(T.compact_label(F.lit("LO:Art. 1º, Parágrafo único"))) == "LO:1,§ú"
    assert one(T.ancestor_paths(F.lit("I,a"))) == ["", "I", "I,a"] and one(T.ancestor_paths(F.lit(""))) == [""]
    assert [one(T.section_level(F.lit(s))) for s in ("norma1", "adt", "cap2", "subsec1", "sec1", "x")] == ["norma", "tit", "cap", "subsec", "sec", ""]
    assert search.parse('R "Da Câmara" Lei') == search.Query(("da camara",), ("lei",), True)
    assert search.parse("aLO23-A").article == "23-A"


def test_tabs(spark):
    from lexflow.plans import tabs

    index = subjects.nested_index(entries(spark), subjects.references(entries(spark)))
    assert [r.subject for r in tabs.tab("subjects", index=index).collect()][-1] == "Mesa"
    assert [(r.subject, len(r.children)) for r in tabs.tab("subjects", "eleicao", index=index).collect()] == [("Câmara", 1)]
    assert {r.subject for r in tabs.tab("subjects", "CAMARA", index=index).collect()} == {"Câmara", "câmara"}
    assert tabs.tab("info", information=index) is index
