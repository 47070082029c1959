"""Edits' trigrams are made once a match."""

from threadloom.plans import registry


def test_trigrams_of_edits_are_written_once_and_read(spark):
    files = registry.attr_match(spark, "/root/testdata/sf0.001").inputFiles()
    assert any("edit-trigrams" in f for f in files)
