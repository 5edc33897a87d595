"""What each paragraph of a statute is: type, identifier and article number, by one ordered CASE.

Patterns are Python's or Java's alike; (?U) makes white space Unicode's, as documents hold hard spaces.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexflow.functions.text import strip

#: How provisions begin. Fixed values.
ARTICLE = r"(?U)^Art\.\s*(\d+)([ºª°])?\s*(?:[-–]([A-H])(?=[.\s ])|([A-H])(?=\s*[-–—.]))?"
PARAGRAPH = r"(?U)^[§Ss]\s*(\d+)(\.?[ºª°]?)"
SINGLE_PARAGRAPH = r"(?iuU)^Par[aá]grafo\s+[uú]nico"
ROMAN, ROMAN_ITEM = r"^(l?[IVXLC]+)", r"(?U)^l?[IVXLC]+\s*[-–—]"
LETTER, NUMBERED, LISTED = r"^[a-z]\)", r"^\d+\)", r"(?U)^\d+\s*[-–—]"
TITLE, CHAPTER = r"(?iuU)^T[ÍI]TULO\s+", r"(?iuU)^CAP[ÍI]TULO\s+"
SECTION, SUBSECTION = r"(?iuU)^SE[ÇC][ÃA]O\s+", r"(?iuU)^SUBSE[ÇC][ÃA]O\s+"
REVOKED = r"(?iu)\(Revogad[oa]"
AMENDED = r"(?iuU)\((Reda[çc][ãa]o\s+dada|Revogad[oa]|Reda[çc][ãa]o\s+reestabelecida|Acrescentad[oa]|Renumerad[oa]|Inclu[ií]d[oa])"

#: Left indent, in twentieths of a point, from which "1)" belongs to a letter.
DEEP = 600


def unit_type(text: Column, centered: Column, indent: Column) -> Column:
    """The type of a stripped text."""
    return (
        F.when((text == "") | (text == " "), "EMPTY")
        .when(centered, F.when(text.rlike(TITLE), "TITULO").when(text.rlike(CHAPTER), "CAPITULO").when(text.rlike(SECTION), "SECAO").when(text.rlike(SUBSECTION), "SUBSECAO").otherwise("SUBTITLE"))
        .when(text.rlike(ARTICLE), "ARTIGO")
        .when(text.rlike(SINGLE_PARAGRAPH), "PARAGRAFO_UNICO")
        .when(text.rlike(PARAGRAPH), "PARAGRAFO_NUM")
        .when(text.rlike(ROMAN_ITEM), "INCISO")
        .when(text.rlike(LETTER), "ALINEA")
        .when(text.rlike(NUMBERED) & (indent >= DEEP), "SUB_ALINEA")
        .when(text.rlike(LISTED) | text.rlike(NUMBERED), "ITEM_NUM")
        .otherwise("OTHER")
    )


def _roman(text: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(text, ROMAN, 1), "^l", "I")


def _article(text: Column, k: int) -> Column:
    return F.regexp_extract(text, ARTICLE, k)


def identifier(kind: Column, text: Column) -> Column:
    """How a provision is named at its start, normalised."""
    article = F.concat(F.lit("Art. "), _article(text, 1), _article(text, 2), F.when(_article(text, 3) != "", F.concat(F.lit("-"), _article(text, 3))).otherwise(_article(text, 4)))
    mark = F.translate(F.regexp_replace(F.regexp_extract(text, PARAGRAPH, 2), r"^\.+", ""), "°", "º")
    number = F.regexp_extract(text, r"^(\d+)", 1)
    return (
        F.when(kind.isin("TITULO", "CAPITULO", "SECAO", "SUBSECAO", "SUBTITLE"), text)
        .when(kind == "ARTIGO", article)
        .when(kind == "PARAGRAFO_UNICO", "Parágrafo único")
        .when(kind == "PARAGRAFO_NUM", F.concat(F.lit("§ "), F.regexp_extract(text, PARAGRAPH, 1), F.when(mark == "", "º").otherwise(mark)))
        .when(kind == "INCISO", _roman(text))
        .when(kind == "ALINEA", F.substring(text, 1, 2))
        .when((kind == "SUB_ALINEA") | ((kind == "ITEM_NUM") & ~text.rlike(LISTED)), F.concat(number, F.lit(")")))
        .when(kind == "ITEM_NUM", number)
        .otherwise("")
    )


def article_number(kind: Column, text: Column) -> Column:
    """'43' or '183-A' for an article, '' for the rest."""
    letter = F.concat(_article(text, 3), _article(text, 4))
    return F.when(kind == "ARTIGO", F.concat(_article(text, 1), F.when(letter != "", F.concat(F.lit("-"), letter)).otherwise(""))).otherwise("")


def uid_suffix(kind: Column, text: Column) -> Column:
    """What a provision adds to the uid of what it belongs to."""
    number = F.regexp_extract(text, r"^(\d+)", 1)
    return (
        F.when(kind == "PARAGRAFO_UNICO", "pu")
        .when(kind == "PARAGRAFO_NUM", F.concat(F.lit("p"), F.regexp_extract(text, PARAGRAPH, 1)))
        .when(kind == "INCISO", _roman(text))
        .when(kind == "ALINEA", F.substring(text, 1, 1))
        .when(kind == "SUB_ALINEA", F.concat(F.lit("sub"), number))
        .when(kind == "ITEM_NUM", F.concat(F.lit("item"), number))
        .otherwise("")
    )


def classify(paragraphs: DataFrame) -> DataFrame:
    """paragraphs with text stripped, and unit_type, identifier and art_number."""
    text = F.col("text")
    rows = paragraphs.withColumn("text", strip(F.coalesce(text, F.lit(""))))
    rows = rows.withColumn("unit_type", unit_type(text, F.coalesce("is_centered", F.lit(False)), F.coalesce("indent_left", F.lit(0))))
    return rows.withColumns({"identifier": identifier(F.col("unit_type"), text), "art_number": article_number(F.col("unit_type"), text)})


def is_revoked(text: Column) -> Column:
    return text.rlike(REVOKED)


def full_text(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: r["text"]), "")


def amendment_note(text: Column) -> Column:
    """The first note on an amendment, from its parenthesis to the one that closes it, or to the end."""
    at = F.regexp_instr(text, F.lit(AMENDED))
    rest = F.substr(text, at)
    depth = F.aggregate(
        F.split(rest, ""),
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("closed")),
        lambda a, c: F.when(a["closed"], a).otherwise(
            F.struct(
                (a["depth"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).alias("depth"),
                (a["n"] + 1).alias("n"),
                ((c == ")") & (a["depth"] == 1)).alias("closed"),
            )
        ),
        lambda a: a["n"],
    )
    plain = F.nullif(F.regexp_extract(rest, r"^\([^()]*\)", 0), F.lit(""))  # no parenthesis within: nearly all
    return F.when(at > 0, F.coalesce(plain, F.substring(rest, F.lit(1), depth))).otherwise("")


def struck(runs: Column) -> Column:
    """Whether more than half of the characters, without the runs' outer white space, are struck."""
    size = lambda rs: F.aggregate(rs, F.lit(0), lambda a, r: a + F.length(strip(r["text"])))
    return size(F.filter(runs, lambda r: r["strike"])) > size(runs) * 0.5
