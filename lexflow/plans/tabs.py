"""The tabs of a statute's index, each a frame that a page shows under a filter."""

from pyspark.sql import DataFrame

from lexflow.operators import outline, side_documents, subjects


def tab(name: str, query: str = "", *, systematic: DataFrame | None = None, index: DataFrame | None = None, references: DataFrame | None = None, information: DataFrame | None = None, category: int = 0) -> DataFrame:
    """systematic: outline nodes in order; subjects: the nested index in dictionary order; references: one category's entries; info: pages.

    Rows that the query doesn't find are left out; information has no filter.
    """
    if name == "info":
        return information
    if name == "systematic":
        return outline.outline_matches(systematic, query).orderBy("doc_id", "seq") if query else systematic
    if name == "references":
        own = references.where(references["category_no"] == category)
        return side_documents.filter_entries(own, query).orderBy("doc_id", "seq") if query else own
    if name == "subjects":
        return subjects.in_display_order(subjects.filter_index(index, query))
    raise ValueError(f"no tab is named {name}")
