import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def one(spark, f, *values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, t string")
    return [r[0] for r in rows.orderBy("k").select(f(F.col("t"))).collect()]


def test_whitespace_runs_of_one_character_collapse(spark):
    assert one(spark, T.collapse_whitespace, "a  b\n\nc\t\td \n e", "", None) == ["a b\nc\td \n e", "", None]


def test_cut_before_drops_every_marker(spark):
    f = lambda c: T.cut_before_marker(c, "MARK")
    assert one(spark, f, " no ", "x MARK y MARK z ", "MARK", "a.MARK") == [" no ", "y  z", "", ""]


def test_cut_after_keeps_what_precedes_the_last(spark):
    f = lambda c: T.cut_after_marker(c, "MARK")
    assert one(spark, f, " no ", "x MARK y MARK z ", "MARK z") == [" no ", "x  y", ""]


def test_cut_mode_is_checked():
    with pytest.raises(ValueError):
        T.cut(None, ["a"], "between")


def test_section_moves_first(spark):
    f = lambda c: T.move_section_first(c, "Q")
    assert one(spark, f, "aQbQc", "none") == ["Q c a b", "none"]


def test_tokenizer_keeps_and_drops(spark):
    text = "Mail me@x.org, see www.site.com: the 3 Cats' tails!"
    assert one(spark, lambda c: T.tokenize(c, ["the"]), text) == [["mail", "see", "cats", "tails"]]
    assert one(spark, lambda c: T.tokenize(c, [], True, True, True), text) == [["mail", "me@x.org,", "see", "www.site.com:", "the", "3", "cats", "tails"]]


def test_ngrams_of_short_texts_are_empty(spark):
    f = lambda n: lambda c: T.ngrams(F.split(c, " "), n)
    assert one(spark, f(2), "a b c", "a") == [["a b", "b c"], []]
    with pytest.raises(ValueError):
        T.ngrams(F.lit(None), 5)


def test_sentences_and_abbreviations(spark):
    f = lambda c: T.sentences(c)
    assert one(spark, f, "One. Two!  \n three", "", "...") == [["One", "Two", "three"], [], []]
    g = lambda c: F.transform(T.sentences(T.protect_abbreviations(c)), lambda s: T.restore_abbreviations(s))
    assert one(spark, g, "Το άρθρο παρ. 2 ισχύει. Α. Β. λέγει") == [["Το άρθρο παρ. 2 ισχύει", "Α. Β. λέγει"]]


def test_budget_and_truncation(spark):
    assert one(spark, lambda c: T.token_budget(c, 0.5), "a b c d e", None) == [2, 1]
    assert one(spark, lambda c: T.first_tokens(c, 2), "a  b\nc", " a", "") == ["a  b", " a", ""]


def test_file_numbers(spark):
    assert one(spark, T.file_index, "a/417.json", "1.txt.json") == [417, 1]
