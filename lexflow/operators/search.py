"""Search over article cards: phrases and words without accents, article jumps, filters, context, paging.

Cards have doc_id, seq, kind (heading or article), law_prefix, art_number, norm_text and norm_text_fn; the last
two are made once when cards are stored, so a search is a filter on stored columns.
"""

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexflow.functions.text import plain, search_key
from lexflow.operators.outline import context_headings


@dataclass(frozen=True)
class Query:
    phrases: tuple[str, ...] = ()
    words: tuple[str, ...] = ()
    with_footnotes: bool = False
    article: str = ""
    law: str = ""

    @property
    def terms(self) -> tuple[str, ...]:
        return self.phrases + self.words


def parse(text: str) -> Query:
    """'r ' first searches footnotes too; a43 or aLO23 is an article; "…" is a phrase, the rest are words."""
    text, notes = text.strip(), False
    if m := re.match(r"r\s+(.+)$", text, re.IGNORECASE):
        text, notes = m[1], True
    if m := re.fullmatch(r"a([A-Za-z]{2,})?(\d+[-A-Za-z]*)", text, re.IGNORECASE):
        return Query(with_footnotes=notes, article=m[2], law=(m[1] or "").upper())
    text = plain(text)
    phrases = [p.strip() for p in re.findall(r'"([^"]+)"', text)]
    return Query(tuple(p for p in phrases if p), tuple(re.sub(r'"[^"]+"', " ", text).split()), notes)


def contains_all(key: Column, terms) -> Column:
    """Whether a search key has every term."""
    out = F.lit(True)
    for t in terms:
        out = out & F.contains(key, F.lit(t))
    return out


def has_all(text: Column, query: str) -> Column:
    """Whether text has all of the query's words, wherever they stand."""
    return contains_all(search_key(text), plain(query).split())


def search_texts(rows: DataFrame, query: str, text: str = "text") -> DataFrame:
    """The rows whose text has all phrases and words of query."""
    return rows.where(contains_all(search_key(F.col(text)), parse(query).terms))


def with_keys(cards: DataFrame) -> DataFrame:
    """cards (text, footnote_text) with norm_text, and norm_text_fn which has the footnotes too."""
    return cards.withColumns({"norm_text": search_key(F.col("text")), "norm_text_fn": search_key(F.concat_ws(" ", "text", F.nullif("footnote_text", F.lit(""))))})


def search_cards(cards: DataFrame, query: str) -> DataFrame:
    """The article cards that match; for an article jump, the one card (of the default law first)."""
    q = parse(query)
    if q.article:
        return find_article(cards, q.article, q.law)
    return cards.where("kind = 'article'").where(contains_all(F.col("norm_text_fn" if q.with_footnotes else "norm_text"), q.terms))


def find_article(cards: DataFrame, article: str, law: str = "") -> DataFrame:
    """The first card of an article: of that law, else of the default law, else of any."""
    rows = cards.where((F.col("kind") == "article") & (F.col("art_number") == article))
    if law:
        rows = rows.where(F.col("law_prefix") == law)
    w = Window.partitionBy("doc_id").orderBy(F.col("law_prefix") != "", "seq")
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def of_subject(cards: DataFrame, refs: DataFrame) -> DataFrame:
    """The article cards that refs (law_prefix, art) name."""
    keys = refs.select("law_prefix", F.col("art").alias("art_number")).distinct()
    return cards.where("kind = 'article'").join(keys, ["law_prefix", "art_number"], "left_semi")


def marked(articles: DataFrame, units: DataFrame, markers: DataFrame) -> DataFrame:
    """The articles that hold a unit with a marker: (doc_id, uid), or uid alone for markers without a document, which hold in all."""
    key = [c for c in ("doc_id", "uid") if c in markers.columns]
    return articles.join(units.join(markers.select(*key).distinct(), key, "left_semi").select("doc_id", "block_id").distinct(), ["doc_id", "block_id"], "left_semi")


def filtered_view(cards: DataFrame, headings: DataFrame, articles: DataFrame, *, query: str = "", refs: DataFrame | None = None, marked_articles: DataFrame | None = None) -> DataFrame:
    """doc_id, seq, kind of what stays visible: articles that meet all filters, and the headings over them."""
    shown = cards.where("kind = 'article'")
    if refs is not None:
        shown = of_subject(shown, refs)
    if marked_articles is not None:
        shown = shown.join(marked_articles.select("doc_id", "seq"), ["doc_id", "seq"], "left_semi")
    if query:
        shown = search_cards(shown, query)
    shown = shown.select("doc_id", "seq")
    over = context_headings(headings, articles).join(shown, ["doc_id", "seq"], "left_semi").select("doc_id", F.col("heading_seq").alias("seq")).distinct()
    return shown.withColumn("kind", F.lit("article")).unionByName(over.withColumn("kind", F.lit("heading")))


def step(matches: DataFrame, current: int, delta: int) -> DataFrame:
    """The match that lies delta from the one at current, around the ends; matches are in order of doc_id and seq."""
    n = matches.count()
    if not n:
        return matches
    rows = matches.orderBy("doc_id", "seq").offset((current + delta) % n).limit(1)
    return rows


def match_numbers(matches: DataFrame) -> DataFrame:
    """matches with idx and n within their document, and prev_seq and next_seq around its ends."""
    w, whole = Window.partitionBy("doc_id").orderBy("seq"), Window.partitionBy("doc_id")
    rows = matches.withColumns({"idx": F.row_number().over(w) - 1, "n": F.count("*").over(whole), "__first": F.min("seq").over(whole), "__last": F.max("seq").over(whole)})
    return rows.withColumns({"prev_seq": F.coalesce(F.lag("seq").over(w), "__last"), "next_seq": F.coalesce(F.lead("seq").over(w), "__first")}).drop("__first", "__last")
