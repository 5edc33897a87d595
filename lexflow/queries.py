"""The queries of the statute operators, one for each group of them, and the SQL that checks them."""

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexflow.functions import text as T
from lexflow.operators import bitmaps, checks, classify, diff, export, hash_tree, intervals, markdown, outline, render, search, segments, side_documents, structure, subjects, targets, text_index, versions
from lexflow.plans import files, statute, tabs, views
from lexflow.plans.views import table
from lexflow.schemas import FOOTNOTE_DEFS, PARAGRAPHS, STYLED, SUBJECT_ROWS
from lexflow.session import discard, stored
from lexflow.sources import marker_log, ooxml


def _classified(spark, d) -> DataFrame:
    return classify.classify(views.paragraphs(spark, d))


def _states(spark, d) -> DataFrame:
    return structure.states(structure.events(_classified(spark, d)))


def _headings(spark, d) -> DataFrame:
    return structure.headings(structure.events(_classified(spark, d)))


def _articles(spark, d) -> DataFrame:
    """The articles; their rows are stored, as articles and summaries both come from them and the states would be made twice."""
    states = stored(_states(spark, d).where("is_art").select("doc_id", "seq", "block_id", "is_art", "number", "in_adt", "law_name", "footnote_ids"), "article-rows")
    return targets.stamp_articles(structure.articles(states, structure.article_summaries(states, views.footnote_defs(spark))), views.laws(spark))


def _units(spark, d) -> DataFrame:
    return versions.resolve(structure.units(_states(spark, d)))


def _statute(spark, d) -> statute.Statute:
    return statute.build(views.paragraphs(spark, d), views.footnote_defs(spark), views.laws(spark))


def _entries(spark, d) -> DataFrame:
    return subjects.entries(views.subject_sheet(spark, d))


def _known(spark, d) -> DataFrame:
    """The articles as a table, for what reads them more than once."""
    return stored(_articles(spark, d), "articles")


def _refs(spark, d, articles: DataFrame) -> DataFrame:
    lettered = articles.select("art_number").where("art_number rlike '^[0-9]+-[A-Z]$'").distinct()
    return subjects.references(_entries(spark, d), lettered)


# Search over documents.


def search_all_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = search.search_texts(table(spark, d, "documents"), "eaux tion")
    return rows.select("doc_id", "lang", "source", F.length("text").alias("n"))


def search_phrase(spark, d):
    return search.search_texts(table(spark, d, "documents"), '"de la" élément').select("doc_id", "lang")


#: Searches of one to some twenty characters, of several terms, of a phrase, and one that nothing meets.
INDEXED = ("e", "qu", "eau", "eaux tion", '"de la" élément', "r dans", "zq", "internationalisations", "constantly forgotten")


def indexed_search(spark, d):
    """Searches over documents by an index of trigrams."""
    index = text_index.build(table(spark, d, "documents").select("doc_id", "text"))
    found = [text_index.search(index, q).select(F.lit(k).alias("query"), "doc_id") for k, q in enumerate(INDEXED)]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows


def search_keys(spark, d):
    rows = table(spark, d, "documents")
    return rows.select("doc_id", F.md5(T.search_key(F.col("text"))).alias("key_md5"), F.md5(T.escape_html(F.col("text"))).alias("html_md5"))


def highlight_hits(spark, d):
    rows = search.search_texts(table(spark, d, "documents"), "element")
    return rows.select("doc_id", F.regexp_count(T.highlight(F.col("text"), [], ["element"]), F.lit("<mark>")).alias("hits"))


def highlight_html(spark, d):
    """Hits beside and inside entities of the escaped text."""
    return table(spark, d, "documents").select("doc_id", F.md5(T.highlight(F.col("text"), ["amp et"], ["amp", "lt", "que"])).alias("html_md5"))


def page_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(T.tagless(F.col("html"))).alias("text_md5"))


def filter_pages(spark, d):
    return table(spark, d, "pages").where(search.has_all(T.tagless(F.col("html")), "reau elle")).select("page_id")


# Classification and structure.


def classify_units(spark, d):
    return _classified(spark, d).select("doc_id", "seq", "unit_type", "identifier", "art_number")


def unit_type_counts(spark, d):
    return _classified(spark, d).groupBy("unit_type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def amendment_notes(spark, d):
    rows = _classified(spark, d)
    return rows.select("doc_id", "seq", classify.amendment_note(F.col("text")).alias("note"), classify.is_revoked(F.col("text")).alias("is_revoked"))


def section_headings(spark, d):
    return _headings(spark, d)


def law_ffill(spark, d):
    return _states(spark, d).select("doc_id", "seq", "law_name", "in_adt", F.coalesce("open", F.lit("")).alias("open_article"), "kept")


def version_islands(spark, d):
    return structure.articles(_states(spark, d)).select("doc_id", "block_id", "seq", "art_number", "is_adt", "law_name", "n_versions")


def hier_uid(spark, d):
    return structure.base_uids(_states(spark, d)).select("doc_id", "seq", "base_uid")


def uid_dedup(spark, d):
    return structure.units(_states(spark, d)).select("doc_id", "seq", "role", "uid")


def _segmented(spark, d, *without: str) -> DataFrame:
    """The states of all orders as one document, in segments, without columns that the query has no use for: segments are stored, so later choices don't reach what is exchanged for them."""
    return segments.states(classify.classify(views.paragraphs(spark, d, whole=True)).drop("runs", "bookmark_name", "indent_left", *without), 4096)


def segmented_states(spark, d):
    return _segmented(spark, d, "footnote_ids").select("seq", "law_name", "in_adt", F.coalesce("open", F.lit("")).alias("open_article"), "kept", "block_id", "art_run")


def segmented_headings(spark, d):
    return segments.headings(_segmented(spark, d, "footnote_ids")).drop("doc_id")


def segmented_uids(spark, d):
    return segments.units(_segmented(spark, d, "footnote_ids")).select("block_id", "seq", "role", "uid")


def segmented_footnotes(spark, d):
    return segments.footnotes(_segmented(spark, d), views.footnote_defs(spark), 4096).select("seq", "fn_id", "is_private", "number")


def old_versions(spark, d):
    return _units(spark, d).select("doc_id", "block_id", "seq", "role", "identifier", "is_old_version")


def article_revoked(spark, d):
    return versions.revoked_articles(_units(spark, d))


def next_versions(spark, d):
    return versions.next_versions(_units(spark, d)).select("doc_id", "seq", "next_seq")


def footnote_numbers(spark, d):
    return structure.footnotes(_states(spark, d), views.footnote_defs(spark)).select("doc_id", "seq", "fn_id", "is_private", "number")


def article_summaries(spark, d):
    return _articles(spark, d).select("doc_id", "block_id", "art_number", "law_prefix", "summary")


def unit_paths(spark, d):
    return targets.paths(_units(spark, d)).where("role = 'child' and not is_old_version").select("doc_id", "seq", "path")


def element_counts(spark, d):
    return statute.counts(_statute(spark, d))


def document_elements(spark, d):
    return structure.elements(_headings(spark, d), _articles(spark, d))


def structure_snapshot(spark, d):
    s = _statute(spark, d)
    return export.structure_snapshot(s.articles, s.provisions)


# Subjects and checks.


def device_lines(spark, d):
    return subjects.device_lines(_entries(spark, d)).select("row_no", "line", "law_prefix", "hint", "lo", "hi", "art", "detail")


def range_expand(spark, d):
    return _refs(spark, d, _articles(spark, d)).where("step > 0").select("row_no", "line", "step", "art")


def range_targets(spark, d):
    """The known articles that ranges reach, some of them three thousand million numbers wide."""
    return intervals.range_targets(subjects.entries(views.subject_sheet(spark, d, wide=True)), _known(spark, d))


def dangling_ranges(spark, d):
    """The parts of these ranges that have no article."""
    return intervals.dangling_ranges(subjects.entries(views.subject_sheet(spark, d, wide=True)), _known(spark, d))


def subject_index_flat(spark, d):
    arts = _known(spark, d)
    refs = subjects.transitional_refs(_refs(spark, d, arts), arts)
    return refs.groupBy("subject", "sub_subject").agg(F.count("*").alias("n_refs"), F.countDistinct("law_prefix", "art").alias("n_articles"))


def subject_index_nested(spark, d):
    index = subjects.nested_index(_entries(spark, d), _refs(spark, d, _known(spark, d)))
    every = subjects.all_refs(index).select("subject", F.size("refs").alias("n_all"))
    return index.join(every, "subject").select("subject", F.coalesce(F.size("refs"), F.lit(0)).alias("n_own"), F.coalesce(F.size("children"), F.lit(0)).alias("n_children"), F.coalesce(F.size("vides"), F.lit(0)).alias("n_vides"), "n_all")


def subject_filter(spark, d):
    whole = subjects.nested_index(_entries(spark, d), _refs(spark, d, _known(spark, d)))
    index, below = subjects.filter_index(whole, "brand#1 4"), subjects.filter_index(whole, "small")
    rows = index.withColumn("query", F.lit("subject")).unionByName(below.withColumn("query", F.lit("below")))
    return rows.select("query", "subject", F.coalesce(F.size("children"), F.lit(0)).alias("n_children"))


def index_rows(spark, d):
    """The whole subject index line by line, and what a filter leaves of it."""
    arts = _known(spark, d)
    refs, entries = _refs(spark, d, arts), _entries(spark, d)
    rows = [subjects.index_rows(entries, refs, subjects.summaries(arts), q).withColumn("query", F.lit(q)) for q in ("", "small brass")]
    return rows[0].unionByName(rows[1])


def formatted_refs(spark, d):
    arts = _known(spark, d)
    return subjects.formatted_refs(_refs(spark, d, arts), subjects.summaries(arts)).select("row_no", "line", "step", "sub", "label", "hint")


def dangling_refs(spark, d):
    arts = _known(spark, d)
    return checks.dangling_references(_refs(spark, d, arts), arts)


def dangling_see_also(spark, d):
    return checks.dangling_see_also(_entries(spark, d))


def see_also_links(spark, d):
    return subjects.see_also_targets(_entries(spark, d)).select("row_no", "pos", "label", "subject_key", "found")


def sheet_lint(spark, d):
    return checks.sheet_faults(views.subject_sheet(spark, d), ["CF", "LO"]).select("row_no", "field", "line_no", "fault_no", "fault")


def lint_codes(spark, d):
    return checks.document_lint(views.paragraphs(spark, d)).select("doc_id", "seq", "code", "context")


def issue_counts(spark, d):
    arts, entries = _known(spark, d), _entries(spark, d)
    found = checks.issues(checks.dangling_references(_refs(spark, d, arts), arts), checks.dangling_see_also(entries), checks.sheet_faults(views.subject_sheet(spark, d), ["CF", "LO"]), checks.document_lint(views.paragraphs(spark, d)))
    return checks.issue_counts(found)


def lint_listing(spark, d):
    """All findings of a document lint, of all codes."""
    return checks.lint_listing(checks.document_lint(views.paragraphs(spark, d, odd=True)))


def odd_units(spark, d):
    """What odd lines are taken for."""
    rows = classify.classify(views.paragraphs(spark, d, odd=True)).where("seq % 4 = 1")
    return rows.select("doc_id", "seq", "unit_type", "identifier", classify.uid_suffix(F.col("unit_type"), F.col("text")).alias("suffix"))


def _issues(spark, d) -> DataFrame:
    arts, entries = _known(spark, d), _entries(spark, d)
    return checks.issues(checks.dangling_references(_refs(spark, d, arts), arts), checks.dangling_see_also(entries), checks.sheet_faults(views.subject_sheet(spark, d), ["CF", "LO"]), checks.document_lint(views.paragraphs(spark, d, odd=True)))


def issue_listing(spark, d):
    """All issues of a build, whole, in the order of a report."""
    rows = checks.issue_listing(_issues(spark, d))
    return rows.withColumn("place", F.array_join(F.transform("place", lambda x: x.cast("string")), "/"))


def issues_json(spark, d):
    return checks.issues_json(_issues(spark, d))


def issue_totals(spark, d):
    return checks.issue_totals(_issues(spark, d))


def marker_state(spark, d):
    """What a log of marks leaves marked, document by document."""
    return marker_log.markers(views.marker_events(spark, d))


def marker_colours(spark, d):
    return marker_log.next_colours(marker_log.markers(views.marker_events(spark, d)))


def locale_sort(spark, d):
    """All words of documents with their place in dictionary order."""
    words = table(spark, d, "documents").select(F.explode(F.split("text", r"[^\p{L}]+")).alias("subject")).where("subject <> ''").distinct()
    return subjects.display_places(words)


# Outline, context, targets.


def systematic_outline(spark, d):
    return outline.outline(_headings(spark, d))


def section_ranges(spark, d):
    return outline.section_ranges(_headings(spark, d), _articles(spark, d))


def outline_search(spark, d):
    index = stored(outline.systematic_index(_headings(spark, d), _known(spark, d)), "outline")
    return outline.outline_matches(index, "capitulo").select("doc_id", "seq", "section_id")


def context_headings(spark, d):
    return outline.context_headings(_headings(spark, d), _articles(spark, d))


def ancestor_headings(spark, d):
    return outline.context_headings(_headings(spark, d), _articles(spark, d), closing=False)


def current_section(spark, d):
    return outline.current_section(_headings(spark, d), _articles(spark, d))


def breadcrumbs(spark, d):
    return outline.breadcrumbs(_headings(spark, d), _known(spark, d))


def unit_breadcrumbs(spark, d):
    s = _statute(spark, d)
    return outline.breadcrumbs(s.headings, s.articles, s.provisions)


def heading_titles(spark, d):
    rows = _headings(spark, d)
    return rows.select("doc_id", "seq", T.heading_short_title(F.col("text"), F.col("subtitle")).alias("short"), T.section_level(F.col("data_section")).alias("level"), T.level_colour(F.lit("heading"), F.col("data_section")).alias("colour"))


def subject_semi_filter(spark, d):
    s = _statute(spark, d)
    refs = _refs(spark, d, s.articles).where("subject = 'Brand#11'")
    return search.of_subject(statute.cards(s), refs).select("doc_id", "seq", "law_prefix", "art_number")


def marker_filter(spark, d):
    s = _statute(spark, d)
    markers = s.provisions.where("seq % 101 = 0").select("uid").distinct()
    return search.marked(s.articles, s.provisions, markers).select("doc_id", "block_id", "art_number")


def article_jump(spark, d):
    return search.search_cards(statute.cards(_statute(spark, d)), "a3").select("doc_id", "seq", "law_prefix")


def search_view(spark, d):
    s = _statute(spark, d)
    return search.filtered_view(statute.cards(s), s.headings, s.articles, query="urgent redacao")


def combined_view(spark, d):
    """What stays visible under two subjects' references, a document's marks and a search at once."""
    s = _statute(spark, d)
    refs = _refs(spark, d, s.articles).where("subject in ('Brand#11', 'Brand#23')")
    markers = s.provisions.where("seq % 3 = 0 and doc_id % 2 = 0").select("doc_id", "uid")
    return bitmaps.view(bitmaps.numbered(statute.cards(s)), s.headings, s.articles, s.provisions, query="dada", refs=refs, markers=markers)


def search_paging(spark, d):
    found = search.search_cards(statute.cards(_statute(spark, d)), "r urgent")
    return search.match_numbers(found).select("doc_id", "seq", "idx", "n", "prev_seq", "next_seq")


def ref_resolve(spark, d):
    s = _statute(spark, d)
    refs = _refs(spark, d, s.articles).select(F.concat_ws("/", "row_no", "line", "step", "sub").alias("ref_id"), F.floor(F.col("row_no") * 15 / 512).alias("doc_id"), "law_prefix", "art", "detail")
    return targets.resolve_refs(refs, s.articles, s.provisions)


def marker_paths(spark, d):
    return targets.paths(_units(spark, d)).select("doc_id", "seq", F.array_join(T.ancestor_paths(F.col("path")), "/").alias("paths"))


def snapshot_changes(spark, d):
    """Numbers of articles that have older versions somewhere but no summary anywhere, and the other way round."""
    arts = _known(spark, d)
    return export.snapshot_changes(arts.where("n_versions > 1"), arts.where("summary <> ''"))


def edition_changes(spark, d):
    """Articles that a later edition adds, takes away, changes or moves, by digests of documents, sections and articles."""
    trees = []
    for later in (False, True):
        s = statute.build(views.paragraphs(spark, d, later=later), views.footnote_defs(spark), views.laws(spark))
        trees.append(hash_tree.tree(s.headings, s.articles, s.provisions))
        discard(s.articles, s.provisions)  # the tree is stored
    return hash_tree.changes(*trees)


def lint_report(spark, d):
    return checks.lint_report(checks.document_lint(views.paragraphs(spark, d)))


def marker_labels(spark, d):
    s = _statute(spark, d)
    return targets.marker_labels(s.provisions.select("uid").distinct(), s.provisions, s.articles)


def word_diff(spark, d):
    def of(op: str):
        return F.filter("parts", lambda p: p["op"] == op)

    words = lambda op: F.array_join(F.transform(of(op), lambda p: p["word"]), " ")
    return diff.version_diffs(_units(spark, d)).select("doc_id", "seq", "next_seq", F.size(of("eq")).alias("kept"), words("del").alias("removed"), words("ins").alias("added"))


def turn_diff(spark, d):
    """Words kept, removed and added between an assistant's turns that follow one another."""
    rows = table(spark, d, "conversations").where("role = 'assistant'")
    rows = rows.withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("next is not null")
    parts = diff.word_diff_column(F.coalesce("text", F.lit("")), "next")

    def of(op: str, name: str):
        return F.size(F.filter("parts", lambda p: p["op"] == op)).alias(name)

    return rows.select("conv_id", "turn", parts.alias("parts")).select("conv_id", "turn", of("eq", "kept"), of("del", "removed"), of("ins", "added"))


# Renderers.


def heading_cards(spark, d):
    return render.heading_cards(_headings(spark, d))


def article_cards(spark, d):
    s = _statute(spark, d)
    return render.article_cards(s.articles, s.units)


def old_version_lines(spark, d):
    return _units(spark, d).where("role = 'version'").select("doc_id", "seq", render.old_version_html().alias("html"))


def article_markdown(spark, d):
    s = _statute(spark, d)
    return markdown.article_markdown(s.articles, s.units)


def heading_markdown(spark, d):
    return markdown.heading_markdown(_headings(spark, d))


def subject_markdown(spark, d):
    return markdown.subject_markdown(subjects.nested_index(_entries(spark, d), _refs(spark, d, _known(spark, d)))).drop("first_row")


def element_json(spark, d):
    s = _statute(spark, d)
    return export.element_json(s.headings, s.articles, s.provisions)


def _lines(spark, d) -> DataFrame:
    """The lines of documents as styled paragraphs, 64 documents in one: the first line of every tenth is a heading, a line in capitals bold."""
    rows = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 64).alias("doc_id"), F.col("doc_id").alias("of"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    heading = (F.col("of") % 10 == 0) & (F.col("pos") == 0)
    bold = F.col("text") == F.upper("text")
    text = F.when(F.col("pos") % 7 == 3, F.concat("text", F.lit(" – Art. 10, II."))).otherwise(F.col("text"))
    return rows.select("doc_id", (F.col("of") * 1_000_000 + F.col("pos")).alias("seq"), F.when(heading, "Heading1").alias("style"), F.array(F.struct(text.alias("text"), bold.alias("bold"))).alias("runs"), text.alias("text"), bold.alias("all_bold"), (T.strip(text) == "").alias("is_empty"))


def reference_entries(spark, d):
    return side_documents.reference_entries(_lines(spark, d)).select("doc_id", "seq", "category_no", "group_no", "title", F.md5("html").alias("html_md5"), "art_ref")


def reference_filter(spark, d):
    return side_documents.filter_entries(side_documents.reference_entries(_lines(spark, d)), "the tion").select("doc_id", "seq", targets.base_article(F.coalesce("art_ref", F.lit(""))).alias("article"))


def reference_tab(spark, d):
    entries = side_documents.reference_entries(_lines(spark, d))
    return side_documents.category_rows(entries, 1, "tion").withColumn("html", F.md5("html"))


def information_pages(spark, d):
    return side_documents.information_html(_lines(spark, d)).select("doc_id", F.length("html").alias("chars"), F.md5("html").alias("html_md5"))


# Readers of office files, and what else a page is made of.


def docx_paragraphs(spark, d):
    """The paragraphs of DOCX files: text, layout, strike, links and notes."""
    rows = ooxml.parsed(files.documents(spark, d), ooxml.paragraphs, PARAGRAPHS.removeprefix("doc_id long, "))
    return rows.select("doc_id", "seq", "text", "is_centered", "has_strike", "indent_left", F.size("runs").alias("n_runs"), F.get("runs", F.lit(0))["bold"].alias("bold"), F.get("runs", F.lit(0))["hyperlink_url"].alias("url"), F.get("footnote_ids", F.lit(0)).alias("fn_id"))


def docx_lint(spark, d):
    return checks.document_lint(ooxml.parsed(files.documents(spark, d), ooxml.lint_paragraphs, ooxml.LINT)).select("doc_id", "seq", "code", "context")


def docx_styled(spark, d):
    return ooxml.parsed(files.documents(spark, d), ooxml.styled_paragraphs, STYLED).select("doc_id", "seq", "style", "text", F.size("runs").alias("n_runs"), "all_bold", "is_empty")


def docx_footnotes(spark, d):
    """Definitions of notes by kind, private ones only where they are asked for."""
    docs, out = files.documents(spark, d), None
    for private in (False, True):
        rows = ooxml.parsed(docs, partial(ooxml.footnote_definitions, include_private=private), FOOTNOTE_DEFS)
        rows = rows.select(F.lit(private).alias("with_private"), "doc_id", "fn_id", "kind", "summary", F.get(F.get("paragraphs", F.lit(0))["runs"], F.lit(0))["text"].alias("text"))
        out = rows if out is None else out.unionByName(rows)
    return out


def xlsx_entries(spark, d):
    """Index entries of XLSX files; rows that are missing, blank or without subject give none."""
    rows = ooxml.parsed(files.workbooks(spark, d), ooxml.subject_rows, SUBJECT_ROWS)
    found = [c for c in rows.columns if c != "row_no"]
    rows = rows.select((F.col("doc_id") * 1_000_000 + F.col("row_no")).alias("row_no"), *found)
    return subjects.entries(rows).select("row_no", "subject", "sub_subject", "devices", F.array_join("vides", "/").alias("vides"))


def xlsx_laws(spark, d):
    rows = ooxml.parsed(files.workbooks(spark, d), ooxml.law_rows, ooxml.LAW_ROWS)
    return subjects.laws(rows)


def ref_highlights(spark, d):
    """Targets of all references, without the card in place of a detail that no provision has."""
    s = _statute(spark, d)
    refs = _refs(spark, d, s.articles).select(F.concat_ws("/", "row_no", "line", "step", "sub").alias("ref_id"), F.floor(F.col("row_no") * 15 / 512).alias("doc_id"), "law_prefix", "art", "detail")
    return targets.resolve_refs(refs, s.articles, s.provisions, fallback=False)


def unit_depths(spark, d):
    """Provisions in the order of their paths' depth, document by document."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("depth", "seq"))
    return targets.by_depth(targets.paths(_units(spark, d))).withColumn("place", place).select("doc_id", "seq", "depth", "place")


def markdown_lines(spark, d):
    """Lines of references as Markdown, from their HTML."""
    return side_documents.reference_entries(_lines(spark, d)).select("doc_id", "seq", F.md5(T.html_to_markdown(F.col("html"))).alias("markdown_md5"))


def category_markdown(spark, d):
    """Each document's reference lists by category, as Markdown."""
    return markdown.category_markdown(side_documents.reference_groups(_lines(spark, d))).withColumn("markdown", F.md5("markdown"))


def outline_pages(spark, d):
    """Each document's outline as one JSON text."""
    return outline.outline_json(outline.systematic_index(_headings(spark, d), _known(spark, d)))


def index_tabs(spark, d):
    """What each tab of the index shows under a filter."""
    refs, entries = _refs(spark, d, _known(spark, d)), _entries(spark, d)
    systematic = tabs.tab("systematic", "capitulo", systematic=stored(outline.systematic_index(_headings(spark, d), _known(spark, d)), "outline"))
    by_subject = tabs.tab("subjects", "small", index=subjects.nested_index(entries, refs))
    references = tabs.tab("references", "tion", references=side_documents.reference_entries(_lines(spark, d)), category=1)
    info = tabs.tab("info", information=side_documents.information_html(_lines(spark, d)))
    rows = [("systematic", systematic, F.concat_ws("/", "doc_id", "seq")), ("subjects", by_subject, F.col("subject")), ("references", references, F.concat_ws("/", "doc_id", "seq")), ("info", info, F.col("doc_id").cast("string"))]
    out = None
    for name, frame, key in rows:
        own = frame.select(F.lit(name).alias("tab"), key.alias("key"))
        out = own if out is None else out.unionByName(own)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        search_all_terms, search_phrase, indexed_search, search_keys, highlight_hits, highlight_html, page_text, filter_pages,
        classify_units, unit_type_counts, amendment_notes, section_headings, law_ffill, version_islands, hier_uid, uid_dedup, segmented_states, segmented_headings, segmented_uids, segmented_footnotes, old_versions, article_revoked, next_versions,
        footnote_numbers, article_summaries, unit_paths, element_counts, document_elements, structure_snapshot,
        device_lines, range_expand, range_targets, dangling_ranges, subject_index_flat, subject_index_nested, subject_filter, index_rows, formatted_refs, dangling_refs, dangling_see_also, see_also_links, sheet_lint, lint_codes, issue_counts, lint_listing, odd_units, issue_listing, issues_json, issue_totals, marker_state, marker_colours, locale_sort,
        systematic_outline, section_ranges, outline_search, context_headings, ancestor_headings, current_section, breadcrumbs, unit_breadcrumbs, heading_titles,
        subject_semi_filter, marker_filter, article_jump, search_view, combined_view, search_paging, ref_resolve, marker_labels, marker_paths, snapshot_changes, edition_changes, lint_report, word_diff, turn_diff,
        heading_cards, article_cards, old_version_lines, article_markdown, heading_markdown, subject_markdown, element_json, reference_entries, reference_filter, reference_tab, information_pages,
        docx_paragraphs, docx_lint, docx_styled, docx_footnotes, xlsx_entries, xlsx_laws, ref_highlights, unit_depths, markdown_lines, category_markdown, outline_pages, index_tabs,
    )
}
