"""Text, names and matches beside results."""

import pytest

from lexigrove.functions.stem import stem_words
from lexigrove.operators import results
from lexigrove.operators.gcl import Engine
from lexigrove.sources.corpus import Corpus

DOCS = [(1, 'The  cat -- sat, on\n"the" 123456789 mat.', "a.txt"), (2, None, "b.txt"), (3, "", "c.txt"), (4, "abcdefghijklmnopqrstuvwxyz end", "d.txt")]


@pytest.fixture(scope="module")
def corpus(spark):
    return Corpus(spark.createDataFrame(DOCS, "doc_id long, text string, source string"))


def places(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, s long, e long, got string")


def test_text_between_positions(spark, corpus):
    rows = [(1, 0, 2, "x"), (1, 4, 5, "x"), (1, 4, 5, "x"), (1, 5, 6, "x"), (1, 3, 2, "x"), (2, 0, 0, "x"), (3, 0, 0, "x"), (4, 0, 1, "x"), (4, None, 1, "x"), (9, 0, 0, "x")]
    got = sorted(map(tuple, results.get(corpus, places(spark, rows)).collect()))
    # The long number takes no position and yet is text between two that do.
    assert got == [(1, 0, 2, "The  cat -- sat"), (1, 4, 5, 'the" 123456789 mat'), (1, 4, 5, 'the" 123456789 mat'), (4, 0, 1, "abcdefghijklmnopqrstuvwxyz")]
    got = sorted(map(tuple, results.get(corpus, places(spark, rows), filtered=True).collect()))
    assert got == [(1, 0, 2, "the cat sat"), (1, 4, 5, "the mat"), (1, 4, 5, "the mat"), (4, 0, 1, "abcdefghijklmnopqrs tuvwxyz")]
    assert results.get(corpus, places(spark, [])).count() == 0


def test_marked_up_text_is_refused(spark, corpus):
    with pytest.raises(ValueError):
        results.get(Corpus(corpus.docs, markup=True), places(spark, [(1, 0, 0, "")]))


def test_added_matches(spark, corpus):
    engine = Engine(corpus)
    rows = spark.createDataFrame([(1, 0, 5), (1, 1, 3), (1, 5, 5), (2, 0, -1), (4, 0, 2), (4, 0, 2)], "doc_id long, s long, e long")
    assert sorted(map(tuple, results.added(engine, rows, '"the"').collect())) == [(1, 0, 5, 0, 0), (1, 1, 3, -1, -1), (1, 5, 5, -1, -1), (2, 0, -1, -1, -1), (4, 0, 2, -1, -1), (4, 0, 2, -1, -1)]
    got = {(r.doc_id, r.s): r.added for r in results.added_text(engine, rows, '"on the mat"+"end"').collect()}
    assert got == {(1, 0): "on 'the' 123456789 mat", (1, 1): "n/a", (1, 5): "n/a", (2, 0): "n/a", (4, 0): "end"}


def test_names(spark, corpus):
    rows = spark.createDataFrame([(1, "old"), (9, "old")], "doc_id long, source string")
    assert sorted(map(tuple, results.named(corpus, rows, "source").collect())) == [(1, "a.txt"), (9, None)]


def test_stem_command():
    assert stem_words("information retrieval") == "inform retriev"
    assert stem_words("flown") == "fly"
    assert stem_words("42 c3po") == "[unstemmable]" == stem_words("")
