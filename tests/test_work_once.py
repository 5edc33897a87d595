"""Work that is done once."""

from lexflow import queries


def test_states_of_articles_are_made_once(spark, sf_dir):
    """Articles and their summaries come from the same stored rows, not each from the tables."""
    read = queries._articles(spark, sf_dir).inputFiles()
    assert read and not any("lineitem" in f for f in read)
