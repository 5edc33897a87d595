"""A corpus pipeline: quality, exact copies, near copies, personal data, packing.

Each stage takes the rows that the stage before it kept, read again from Parquet, and its decisions take
effect on them; all but the last return the columns of documents. For all stages: null, empty and blank texts are
texts without words; columns beside doc_id and text are carried along whatever their names; an empty table gives
an empty one; what a stage does with ties, repeated rows and missing ids it says itself.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexflow.llm.common import stored, table
from lexflow.llm.exact_dedup import drop_copies
from lexflow.llm.minhash import drop_near_duplicates
from lexflow.llm.packing import packed
from lexflow.llm.pii import key_of, pseudonymised
from lexflow.llm.quality_model import good_documents
from lexflow.llm.queries import TEST_KEY


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the corpus's labels, doesn't reject.

    A row is judged by its text alone, so repeated rows stay or go together and a missing doc_id doesn't matter;
    without two labelled rows of each class all rows stay or all go, by which class has more.
    """
    return good_documents(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that with the smallest doc_id; a row without one loses, and of rows that tie the first in its file stays."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id; rows that repeat it stay, and so do rows without doc_id or words."""
    return drop_near_duplicates(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms for personal data, by the session's key; all rows stay, and equal texts stay equal."""
    return pseudonymised(docs, key=key_of(spark, TEST_KEY))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences; each row is a document by itself, a text without words being its closing id.

    Executors hold what the stages before have grown them to, so workers keep few units between tasks.
    """
    return packed(docs, public_tokenizers.path("word_bpe_49k.json"), frequent=40_000)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("private", private), ("packing", packing)]

#: SQL can't express the stages with models, pseudonyms or tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
