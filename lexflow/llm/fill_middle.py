"""Fill-in-the-middle: documents cut at two drawn places and put together with the middle last.

A pandas UDF gets Arrow batches of whole texts. A text's units (code points, or what another pattern matches) are
found by one pass of regex's finditer, their end offsets kept in an array of four or eight bytes each; two draws pick
units, two lookups in the array give the places, and three slices the parts. Draws and digests are hashlib's, of the
document's id, so a retried or repeated task gives the same output and rows need no order.
"""

import hashlib
import re
from array import array

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexflow.llm.common import free_name

MARKS = ("<P>", "<S>", "<M>")
#: Of a hundred documents so many stay plain, and of a hundred others so many have the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: A unit: one code point.
UNIT = r"(?s)."

SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


def draws(doc_id, seed: int) -> list[int]:
    """Four numbers of 32 bits; a missing id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def ends_of(units, text: str) -> array:
    """Where each unit ends."""
    return array("I" if len(text) < 1 << 32 else "Q", (m.end() for m in units.finditer(text)))


def cut(text: str, ends: array, a: int, b: int) -> tuple[str, str, str]:
    """The text before the end of so many units, from there to the end of so many others, and the rest."""
    low, high = (ends[k - 1] if k else 0 for k in sorted((a, b)))
    return text[:low], text[low:high], text[high:]


def rearranged(text: str, doc_id, units, seed: int, marks: tuple = MARKS, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> tuple:
    """Number of units, form, code points of prefix and middle, and the output."""
    p, s, m = marks
    ends = ends_of(units, text)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or p in text or s in text or m in text or h3 % 100 >= 100 - plain:
        return n, "plain", None, None, text
    prefix, middle, suffix = cut(text, ends, h1 % (n + 1), h2 % (n + 1))
    if h4 % 100 < suffix_first:
        return n, "spm", len(prefix), len(middle), f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", len(prefix), len(middle), f"{p}{prefix}{s}{suffix}{m}{middle}"


def _udf(seed: int, unit: str, marks: tuple, plain: int, suffix_first: int):
    @F.pandas_udf(SCHEMA)
    def run(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        import regex

        units, out = regex.compile(unit, regex.V1), []
        for doc_id, text in zip(ids, texts, strict=True):
            row = rearranged(text or "", doc_id, units, seed, marks, plain, suffix_first)
            out.append((*row, hashlib.sha256(row[-1].encode()).hexdigest()))
        frame = pd.DataFrame(out, columns=[f.split()[0] for f in SCHEMA.split(", ")])
        return frame.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    return run


def fill_middle(docs: DataFrame, *, seed: int = 1, unit: str = UNIT, marks: tuple = MARKS, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, name: str = "fim") -> DataFrame:
    """docs with a column ``name`` (fim, fim_ and so on: the first that is free): a structure of SCHEMA.

    n is the number of units of the text; form is plain, psm (prefix, suffix, middle) or spm; output the text to train
    on. The whole text is cut; no row moves. Defined cases: a null text is an empty one, and an empty one is plain; so is a text that holds
    a mark, as its parts couldn't be told; prefix_chars and middle_chars of plain rows are null; characters that unit doesn't match
    belong to the part they lie in; a row without doc_id draws by the seed alone, and rows that repeat an id draw the
    same numbers; no rows give no rows. A text needs four bytes a unit and some copies of itself while it is cut.
    """
    if len(set(marks)) != 3 or any(a != b and a in b for a in marks for b in marks):
        raise ValueError("marks are three texts, none within another")
    run = _udf(seed, unit, tuple(marks), plain, suffix_first)
    return docs.withColumn(free_name(name, docs.columns), run(F.col("doc_id").cast("string"), F.col("text")))


def restored(output: Column, form: Column, marks: tuple = MARKS) -> Column:
    """The exact text again, from output and form alone."""
    p, s, m = (re.escape(x) for x in marks)
    psm = F.regexp_replace(output, f"(?s)^{p}(.*?){s}(.*?){m}(.*)$", "$1$3$2")
    spm = F.regexp_replace(output, f"(?s)^{s}(.*?){p}(.*?){m}(.*)$", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
