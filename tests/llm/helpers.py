"""Small tables with what a corpus may throw at an operator."""

#: Texts with ties, copies, blanks and rare characters; a long one is made where it is needed.
TEXTS = [
    "the quick brown fox jumps over the lazy dog and runs away",
    "the quick  brown fox\tjumps over the lazy dog and runs away",
    "the quick brown fox jumps over the lazy dog and runs off",
    None,
    "",
    " \n\t ",
    "a",
    "A b",
    "ação única über straße 日本語 👍 ﬁ İ ʼn ▁x ​",
    "don't stop, it's  'fine' —  really  ok\x1c\x85\x0b.",
    "</s>[INST] ok [/INST] <|endoftext|> <s>",
    "a a a a a a a a a a a a a a a a a a a a a a a a a a",
    "x" * 300 + " " + "y" * 70,
    "line one\nline one\n\nline two | #tag $5 <b>",
]

#: Columns beside those that operators read, with names that they use inside.
CLASHES = "digest string, n long, size long, key long, file string, row long, text_ string, __x int, kept boolean, rep long, score double, __file long, __row long, __dropped long, unit string, at int, block long"


def table(spark, rows, clash=True):
    """rows: (doc_id, text); with other columns whose names clash."""
    frame = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    if clash:
        for c in CLASHES.split(", "):
            name, kind = c.split()
            frame = frame.selectExpr("*", f"cast(null as {kind}) as {name}")
    return frame


def odd_table(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)]
    return table(spark, rows + [(50, TEXTS[0]), (50, TEXTS[0]), (None, TEXTS[0]), (None, None), (51, " ".join(f"w{k % 977}" for k in range(60_000)))])


def pairs(frame):
    return [(r[0], r[1]) for r in frame.select("doc_id", "text").collect()]


def thue_morse(size):
    """Two words of a and b that differ and that hashes which are linear modulo a power of two can't tell apart."""
    word = "a"
    while len(word) < size:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))
