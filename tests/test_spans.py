import html
import random
import re

import pytest

from corpusloom.operators import fragments as Fr
from corpusloom.sources import readers


def bare(marked):
    return html.unescape(re.sub(r"</?(?:span|em)[^>]*>", "", marked).replace("<br/>", "\n"))


def pairs(spark, rows):
    return spark.createDataFrame([(k, s, t, "k") for k, (s, t) in enumerate(rows)], "doc_id int, summary string, text string, `key` string")


def texts(seed, n):
    r = random.Random(seed)
    words = ["The", "cat", "sat", "<b>", "&", "on", "mat", ",", "élan", "2", "  ", "\n", "\t", "(x)", '"q"', "don't", "\xa0"]
    return [(" ".join(r.choice(words) for _ in range(r.randint(0, 12))), "".join(r.choice(words) + r.choice([" ", "", "\n "]) for _ in range(r.randint(0, 40)))) for _ in range(n)]


@pytest.mark.parametrize("novel", [False, True])
def test_texts_come_back_without_the_marks(spark, novel):
    rows = [*texts(1, 60), (None, "a b"), ("a b", None), ("", ""), (" a ", " a  b ")]
    for r in Fr.annotate_texts(pairs(spark, rows), novel=novel).collect():
        assert bare(r.summary_html) == (r.summary or "") and bare(r.text_html) == (r.text or "")


def test_marks_numbers_and_lengths(spark):
    row = Fr.annotate_texts(pairs(spark, [("The cat  sat; birds sat", "So the cat  sat. The end sat")]), min_length=2, novel=True, colours=2).first()
    assert row.summary_html == '<span class="f0" data-ref="0">The cat  sat</span><em>;</em> <em>birds</em> sat'
    assert row.text_html == 'So <span class="f0" data-ref="0">the cat  sat</span>. The end sat'
    assert Fr.annotate_texts(pairs(spark, [])).columns == ["doc_id", "summary", "text", "key", "summary_html", "text_html"]


def test_truncation_cuts_runs(spark):
    row = Fr.annotate_texts(pairs(spark, [("a b c d", "x a b c d e")]), truncation=3).first()
    assert row.text_html == 'x <span class="f0" data-ref="0">a b</span>' and bare(row.summary_html) == "a b c d"
    rows = texts(5, 40)
    for r in Fr.annotate_texts(pairs(spark, rows), truncation=7).collect():
        assert (r.text or "").startswith(bare(r.text_html))


def test_clashing_names(spark):
    with pytest.raises(ValueError):
        Fr.annotate_texts(pairs(spark, [("a", "b")]).withColumnRenamed("key", "fragments"))


def test_counts_in_the_same_pass(spark):
    a = spark.createDataFrame([(1, "a"), (2, None), (4, "d")], "ix int, text string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "ix int, text string")
    found, seen = readers.pair_observed(a, b)
    assert sorted(tuple(r) for r in found.collect()) == [(1, "a", "x"), (2, None, "y")]
    assert seen.get == {"pairs": 2, "no_reference": 1, "no_generated": 1}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
