import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import pages, rouge, similarity, tables
from corpusloom.plans import summarize as programs
from corpusloom.sources import readers, writers


def lines(spark, *rows):
    return spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, x array<string>").orderBy("k")


def test_court_type(spark):
    d = lines(spark, ["a", "COURT", "civil"], ["COURT section", "skip", "penal"], ["none"], ["COURT"])
    assert [r[0] for r in d.select(pages.court_type(F.col("x"), "COURT", "section")).collect()] == ["civil", "penal", None, None]


def test_body_and_summary_start(spark):
    d = spark.createDataFrame([(["s------", "b", "c"], ["x"]), (["a"], ["p", "q"])], "a array<string>, b array<string>")
    assert {r[0] for r in d.select(pages.body_or_fallback(F.col("a"), F.col("b"))).collect()} == {"\nb\nc", "p\nq"}
    assert spark.range(1).select(pages.starts_with_summary(F.lit("ΠΕΡΙΛΗΨΗ: x")), pages.starts_with_summary(F.lit("x"))).first()[:] == (True, False)


def test_parallel_lists(spark):
    d = spark.createDataFrame([(1, ["a", "b"], ["x", "y"])], "id int, p array<string>, q array<string>")
    assert sorted(map(tuple, tables.zip_equal(d, ["p", "q"]).collect())) == [(1, "a", "x"), (1, "b", "y")]
    with pytest.raises(Exception, match="unequal"):
        tables.zip_equal(spark.createDataFrame([(["a"], [])], "p array<string>, q array<string>"), ["p", "q"]).collect()


def test_links_seen_before(spark):
    a, seen = spark.createDataFrame([("u",), ("u",), ("v",), ("w",)], "url string"), spark.createDataFrame([("w",)], "url string")
    assert sorted(r.url for r in tables.duplicate_links(a, seen).collect()) == ["u", "w"]


def test_truncation(spark):
    d = lines(spark, ["abc", "def", "g"])
    assert d.select(rouge.truncate_chars(F.col("x"), 4)).first()[0] == ["abc", "d"]
    rows = spark.createDataFrame([(1, k, ["a", "b", "c"]) for k in range(3)], "doc_id int, sent_ix int, tokens array<string>")
    assert [r.tokens for r in rouge.truncate_sentences(rows, 4).orderBy("sent_ix").collect()] == [["a", "b", "c"], ["a"]]


def test_common_words_metric(spark):
    tf = spark.createDataFrame([(1, 0, "a", 1), (1, 1, "a", 2), (1, 1, "b", 1), (1, 2, "c", 1)], "doc_id int, sent_ix int, term string, tf long")
    rows = [(r.i, r.j, round(r.sim, 4)) for r in similarity.common_word_edges(tf).collect()]
    assert rows == [(0, 1, round(3 / 0.4771, 4))] or abs(rows[0][2] - 3 / 0.47712125) < 1e-3


def test_threshold_is_checked(spark):
    with pytest.raises(ValueError):
        similarity.markov(spark.createDataFrame([], "doc_id int, i int, j int, sim double"), 1.0)


def test_character_units(spark):
    pairs = spark.createDataFrame([(1, 0, ["ab", "c"], ["abc"])], "pair_id int, ref_id int, hyp array<string>, ref array<string>")
    r = rouge.rouge_n(pairs, 1, rouge.Options(char_units=True)).first()
    assert (r.overlap, r.evaluated, r.reference) == (3, 3, 3)
    with pytest.raises(ValueError):
        rouge.Options(weight=0)


def test_published_overlap_fractions(spark):
    rows = spark.createDataFrame([(37, 96, 104), (44, 96, 102), (14, 93, 103)], "overlap long, evaluated long, reference long")
    got = [(round(100 * r.p, 2), round(100 * r.r, 2), round(100 * r.f, 2)) for r in rouge.with_scores(rows).collect()]
    assert got == [(38.54, 35.58, 37.0), (45.83, 43.14, 44.44), (15.05, 13.59, 14.29)]


def test_programs_run_whole(spark, tmp_path):
    docs = spark.createDataFrame([(1, "The cat sat. A cat ran. Dogs bark. Birds sing loud", "cat,dogs"), (2, None, None), (3, "", "x")], "doc_id long, text string, tags string")
    for method in ("lexrank", "lexrank_undamped", "biased_lexrank", "random_sentence"):
        out = programs.summarize(docs, programs.SummaryOptions(method=method, size=2)).collect()
        assert {r.doc_id: bool(r.summary) for r in out} == {1: True, 2: False, 3: False}
    with pytest.raises(ValueError):
        programs.summarize(docs, programs.SummaryOptions(method="other", size=2))
    raw = spark.createDataFrame([(k, f"HEAD body {k}\n", "s", f"01/02/{2000 + k}", "c") for k in range(3)], "row_ix int, text string, summary string, date string, case_category string")
    assert programs.preprocess(raw, "STE", starts=["HEAD"], newlines=True, skip=1).count() == 2
    assert {r.text for r in programs.preprocess(raw, "AreiosPagos", starts=["HEAD"], newlines=True).collect()} == {f"body {k}" for k in range(3)}
    ready = raw.withColumn("subset", F.lit(1)).withColumn("case_tags", F.lit("a_b"))
    assert programs.model_input(ready, 1, prefix=True, stopwords=("body",)).first().text.startswith("a b [SEP] HEAD")


def test_model_tables_round_trip(spark, tmp_path):
    from corpusloom.operators import terms

    tf = terms.term_frequency(terms.sentence_rows(spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id int, text string")))
    writers.write_idf(terms.idf_table(tf), terms.default_idf(tf), str(tmp_path / "m"))
    idf, default = readers.read_idf(spark, str(tmp_path / "m"))
    assert idf.count() == 2 and default.count() == 1
    (tmp_path / "stop.txt").write_text("Και\nτο\n\nτο\n", encoding="utf-8")
    assert sorted(r.word for r in readers.read_stopwords(spark, str(tmp_path / "stop.txt"), "el").collect()) == ["και", "το"]
    (tmp_path / "ex.txt").write_text("geese|goose\n")
    assert readers.read_exceptions(spark, str(tmp_path / "ex.txt")).first()[:] == ("geese", "goose")
    rows = spark.createDataFrame([("s", "m", "r")], "summary string, metadata string, reference_summary string")
    writers.write_summaries(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().reference_summary == "r"
    assert T.ABBREVIATIONS
