"""Cleaning order, abbreviations and what else this round has put right."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def one(spark, f, *texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "c string").select(f(F.col("c"))).collect()]


def test_line_feeds_alone_stay(spark):
    assert one(spark, T.clean_state_council, "line one\nline two\r\nline three", "a\n\nb\n \nc") == ["line one\nline two line three", "a\nb\n \nc"]


def test_noise_goes_before_markers(spark):
    end = "Η διάσκεψη   \nέγινε"
    # the carriage return in the marker is noise: with it gone there is no marker left to cut at
    assert one(spark, T.clean_state_council, f"Σκεφθέν κατά τον νόμον a {end} b") == ["a"]
    assert one(spark, T.clean_state_council, "x Η διάσκεψη\r\nέγινε y") == ["x"]  # made whole by the space
    assert one(spark, lambda c: T.clean_judgement(c, [], ["έγινε"], "z"), "a έγziνε b") == ["a έγ iνε b"]


def test_newlines_go_before_markers(spark):
    marked = "x Η διάσκεψη   \nέγινε y"
    clean = lambda newlines: lambda c: T.clean_raw(c, [], T.STATE_COUNCIL_ENDS, None, newlines)
    assert one(spark, clean(False), marked) == ["x"]
    assert one(spark, clean(True), marked) == ["x Η διάσκεψη έγινε y"]


def test_white_space_collapses_last(spark):
    assert one(spark, T.clean_supreme_court, "a ΣΚΕΦΘΗΚΕ ΣΥΜΦΩΝΑ ΜΕ ΤΟ ΝΟΜΟ b  c\n\n\td\t\te ") == ["b c\n\td\te"]
    # blanks of the marker itself are met before they collapse
    assert one(spark, T.clean_supreme_court, "a Σ Κ Ε Φ Θ Η Κ Ε  Σ Υ Μ Φ Ω Ν Α  Μ Ε  Τ Ο  Ν Ο Μ Ο b") == ["b"]


@pytest.mark.parametrize("form", T.ABBREVIATIONS)
def test_every_abbreviation_is_protected(spark, form):
    text = f"Κατά {form} 5 ισχύει. Τέλος"
    assert one(spark, T.whole_sentences, text) == [[f"Κατά {form} 5 ισχύει", "Τέλος"]]


def test_programs_take_the_kind_s_own_markers(spark):
    from corpusloom.plans import summarize as programs

    rows = spark.createDataFrame([(1, "x ΣΚΕΦΘΗΚΕ ΣΥΜΦΩΝΑ ΜΕ ΤΟ ΝΟΜΟ b  c", "s", "01/02/2003")], "row_ix int, text string, summary string, date string")
    assert programs.preprocess(rows, "AreiosPagos").first().text == "b c"
    assert programs.preprocess(rows, "STE").first().text.startswith("x ΣΚΕΦΘΗΚΕ")


def test_fuzzy_ratio_in_both_forms(spark):
    import random

    from corpusloom.operators import neighbours

    r = random.Random(1)
    a = "".join(r.choice("abcdefgh ") for _ in range(600))
    b = a[:100] + "X" + a[101:300] + "Y" + a[301:]
    assert neighbours.fuzzy_ratio(a, b) >= 99 > neighbours.fuzzy_ratio(a, b, compat=True)
    assert neighbours.fuzzy_ratio("abcd", "bcde") == neighbours.fuzzy_ratio("abcd", "bcde", compat=True) == 75
    pairs = [("".join(r.choice("ab c") for _ in range(r.randint(0, 12))), "".join(r.choice("ab c") for _ in range(r.randint(0, 12)))) for _ in range(80)]
    rows = spark.createDataFrame(pairs, "x string, y string").select("x", "y", neighbours.ratio_bound(F.col("x"), F.col("y")).alias("most")).collect()
    assert all(x.most >= neighbours.fuzzy_ratio(x.x, x.y) - 0.5 for x in rows)
    texts = spark.createDataFrame([(k, "c", t) for k, t in enumerate([a * 6, b * 6, "other " * 500])], "k int, category string, text string")
    found = lambda compat: [(x.ix, x.jx) for x in neighbours.near_duplicates(texts, "category", "k", compat=compat).collect()]
    assert found(False) == [(0, 1)] and found(True) == []


def test_exceptions_by_join(spark):
    from corpusloom.operators import stem

    words = spark.createDataFrame([("geese",), ("running",), ("was",), ("houses",)], "term string")
    table = spark.createDataFrame([("geese", "goose"), ("was", "be"), ("unmet", "x")], "word string, stem string")
    want = {(w, stem.stem_token(w, {"geese": "goose", "was": "be"})) for w in ("geese", "running", "was", "houses")}
    assert {tuple(r) for r in stem.stem_terms(words, table).collect()} == want and ("was", "was") in want


def test_summaries_drawn_to_vectors(spark):
    from corpusloom.plans import summarize as programs

    docs = spark.createDataFrame([(1, "Cats sit here. Dogs run there. Birds sing loud")], "doc_id long, text string")
    vectors = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (1, 2, [0.6, 0.8])], "doc_id long, sent_ix int, embedding array<double>")
    to = spark.createDataFrame([([0.0, 2.0],)], "embedding array<double>")
    out = programs.summarize(docs, programs.SummaryOptions(method="biased_lexrank", size=1), bias_vectors=(vectors, to)).first()
    assert out.summary.startswith("Dogs run")


def test_gram_overlaps_of_a_batch():
    import random
    from collections import Counter

    import pyarrow as pa

    from corpusloom.operators import rouge

    r = random.Random(2)
    one = lambda: None if r.random() < 0.1 else [r.choice(["a", "b", "c", "δ", ""]) for _ in range(r.randint(0, 12))]
    hyp, ref = [one() for _ in range(200)], [one() for _ in range(200)]
    for n in (1, 2, 3, 4):
        count = lambda t: Counter(tuple(t[k : k + n]) for k in range(len(t) - n + 1)) if t else Counter()  # noqa: B023, E731
        want = [(count(h) & count(x)).total() for h, x in zip(hyp, ref)]
        kind = pa.list_(pa.string())
        assert rouge.gram_overlaps(pa.array(hyp, kind), pa.array(ref, kind), n).tolist() == want
        assert rouge.gram_overlaps(pa.array([], kind), pa.array([], kind), n).tolist() == []
        # a batch that begins in the middle of its arrays
        assert rouge.gram_overlaps(pa.array(hyp, kind)[7:90], pa.array(ref, kind)[7:90], n).tolist() == want[7:90]


def test_bits_give_the_hits_of_the_table():
    import random

    import numpy as np

    from corpusloom.operators import rouge

    r = random.Random(3)
    for _ in range(400):
        x, y = ([r.choice("abcde"[: r.randint(1, 5)]) for _ in range(r.randint(0, 14))] for _ in range(2))
        _, move = rouge.lcs_table(x, y)
        want, i, j = np.zeros(len(x), dtype=bool), len(x), len(y)
        while i and j:
            m = move[i, j]
            want[i - 1] |= m == 0
            i, j = i - (m != 2), j - (m != 1)
        assert rouge.lcs_hits(x, y).tolist() == want.tolist()
    long = [r.choice("abcdefgh") for _ in range(3000)]
    assert rouge.lcs_hits(long, long[1:]).sum() == 2999


def test_token_budget_by_sentences(spark):
    from corpusloom.operators import rouge
    from corpusloom.plans import summarize as programs

    cut = lambda n: lambda c: F.array_join(rouge.truncate_tokens(T.sentences(c), n), "|")
    text = "one two. three four  five. six"
    assert [one(spark, cut(n), text)[0] for n in (1, 2, 4, 5, 9)] == ["one", "one two", "one two|three four", "one two|three four  five", "one two|three four  five|six"]
    rows = spark.createDataFrame([(1, "a b. c d", "a b. c d e")], "pair_id int, g string, r string")
    score = lambda **how: programs.evaluate(rows, F.col("g"), F.col("r"), metrics=("rouge-1",), **how).first()
    assert score().r < 1 and score(token_budget=3).r == score(token_budget=3).p == 1


def test_first_rows_of_a_csv_are_the_first(spark, tmp_path):
    from corpusloom.sources import readers

    for k in range(3):
        (tmp_path / f"{k}.csv").write_text("row_ix,text\n" + "".join(f'{k * 10 + j},"a\nb"\n' for j in range(10)))
    for n in (1, 10, 14, 99):
        got = readers.read_csv(spark, str(tmp_path), "row_ix long, text string", n)
        assert got.columns == ["row_ix", "text"] and [r.row_ix for r in got.collect()] == list(range(min(n, 30)))


def test_sentence_vectors_of_any_size(spark):
    from corpusloom.operators import similarity

    for size in (3, 64, 130):
        vectors = spark.createDataFrame([("a", [float(k) for k in range(size)]), ("b", [1.0] * size)], "term string, embedding array<float>")
        weighted = spark.createDataFrame([(1, 0, "a", 2.0), (1, 0, "b", 3.0), (1, 1, "b", 0.5), (2, 0, "z", 1.0)], "doc_id int, sent_ix int, term string, w double")
        got = {(r.doc_id, r.sent_ix): r.v for r in similarity.sentence_vectors(weighted, vectors).collect()}
        assert got == {(1, 0): [2.0 * k + 3 for k in range(size)], (1, 1): [0.5] * size}
    assert similarity.sentence_vectors(weighted, vectors.limit(0)).count() == 0
