"""Text functions as Spark expressions: white space, accents, escaping, highlighting, compact labels."""

import re
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Combining marks that count as accents.
MARKS = "".join(map(chr, range(0x300, 0x370)))


def _folds() -> dict[str, str]:
    """Every letter that is one other character with accents, by Unicode's canonical decomposition."""
    out = {}
    for c in map(chr, range(0xC0, sys.maxunicode + 1)):
        base = unicodedata.normalize("NFD", c).translate(dict.fromkeys(range(0x300, 0x370)))
        if len(base) == 1 and base != c:
            out[c] = base
    return out


_FOLDS = _folds()
#: Letters with accents, and what they are without, in the same order.
ACCENTED, PLAIN = "".join(_FOLDS), "".join(_FOLDS.values())
_TABLE = str.maketrans(ACCENTED, PLAIN, MARKS)

#: Which letters a letter of a search term also finds. Fixed values.
VARIANTS = {"a": "aáàâãä", "e": "eéèêë", "i": "iíìîï", "o": "oóòôõö", "u": "uúùûü", "c": "cç", "n": "nñ"}


def strip(text: Column) -> Column:
    """Without white space at either end, all of Unicode's included (trim only takes spaces)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def strip_accents(text: Column) -> Column:
    """Without accents, in any script: letters that are one character with accents become it, and combining marks go."""
    return F.translate(text, ACCENTED + MARKS, PLAIN)


def plain(text: str) -> str:
    """The driver's side of search_key, for what a user types."""
    return text.lower().translate(_TABLE).replace("\u00a0", " ")


def search_key(text: Column) -> Column:
    """What search terms are compared with: lower case, no accents, plain spaces."""
    return F.replace(strip_accents(F.lower(text)), F.lit(" "), F.lit(" "))


def _each(text: Column, pairs) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_html(text: Column, quotes: bool = False) -> Column:
    """&, < and > as entities; with quotes, both quotation marks too."""
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]
    return _each(text, pairs + [('"', "&quot;"), ("'", "&#x27;")] if quotes else pairs)


def tagless(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]*>", "")


def html_to_markdown(text: Column) -> Column:
    """Bold tags as asterisks, entities as characters."""
    return _each(F.regexp_replace(text, "<b>(.*?)</b>", "**$1**"), [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")])


def accent_pattern(term: str) -> str:
    """A regular expression that finds term whatever its accents; letters without variants stay."""
    return "".join(f"[{VARIANTS[c.lower()]}]" if c.lower() in VARIANTS else re.escape(c) for c in term)


#: Stand for the tags until the text is escaped; Unicode gives these code points to no character.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"


def highlight(text: Column, phrases: list[str], words: list[str]) -> Column:
    """text, escaped, with every hit of a phrase or word in <mark>; longer phrases win over words. Hits are those of the text before it is escaped."""
    found = [accent_pattern(p).replace(r"\ ", r"[\s\u00a0]+") for p in phrases] + [accent_pattern(w) for w in words]
    text = F.translate(text, _OPEN + _CLOSE, "")
    if found:
        text = F.regexp_replace(text, f"(?iu)({'|'.join(found)})", f"{_OPEN}$1{_CLOSE}")
    return _each(escape_html(text), [(_OPEN, "<mark>"), (_CLOSE, "</mark>")])


def heading_short_title(text: Column, subtitle: Column) -> Column:
    """The number of a heading and its subtitle, without the word for its level."""
    number = strip(F.regexp_replace(strip(text), r"(?iu)^(T[IÍ]TULO|CAP[IÍ]TULO|SE[CÇ][AÃ]O|SUBSE[CÇ][AÃ]O)\s*", ""))
    sub = strip(F.coalesce(subtitle, F.lit("")))
    return F.when(sub != "", F.concat(F.when(number != "", F.concat(number, F.lit("-"))).otherwise(""), sub)).when(number != "", number).otherwise(strip(text))


def compact_label(text: Column) -> Column:
    """A marker's label: no "Art.", ordinal marks or spaces."""
    text = F.regexp_replace(text, "(?iu)Parágrafo único", "§ú")
    text = F.regexp_replace(text, r"Art\.\s*", "")
    return F.regexp_replace(F.replace(text, F.lit("º"), F.lit("")), r"(?U)\s+", "")


def ancestor_paths(path: Column) -> Column:
    """The paths from the article down to a unit: 'I,a' gives '', 'I' and 'I,a'."""
    parts = F.when(F.coalesce(path, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(path, ","))
    return F.concat(F.array(F.lit("")), F.transform(parts, lambda _, i: F.array_join(F.slice(parts, F.lit(1), i + 1), ",")))


def section_level(section: Column) -> Column:
    """norma, tit, cap, subsec or sec by a section's id; '' for others."""
    return (
        F.when(section.startswith("norma"), "norma").when(section.startswith("tit") | section.isin("adt", "dgt"), "tit").when(section.startswith("cap"), "cap").when(section.startswith("subsec"), "subsec").when(section.startswith("sec"), "sec").otherwise("")
    )


#: Colours of an outline strip by heading level; articles are white and the rest grey. Fixed values.
LEVEL_COLOURS = {"norma": "#222", "tit": "#b71c1c", "cap": "#f57c00", "sec": "#fdd835", "subsec": "#2e7d32"}


def level_colour(kind: Column, section: Column) -> Column:
    level, out = section_level(section), F.lit("#999")
    for k, v in LEVEL_COLOURS.items():
        out = F.when(level == k, v).otherwise(out)
    return F.when(kind == "heading", out).when(kind == "article", "#fff").otherwise("#eee")
