import numpy as np
import pytest

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import centrality, fragments, neighbours, rouge, similarity, tables, terms
from corpusloom.plans import summarize as programs


def one(spark, f, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    return [r[0] for r in rows.orderBy("k").select(f(F.col("t"))).collect()]


def test_tokenizer_goldens(spark):
    shop = "www.6pm.com\nCall us: 1.888.676.2660 24/7\nEmail us: cs@6pm.com\n"
    plain = "Shipping & Delivery\nContact Information\nWe're here to help!"
    assert one(spark, lambda c: T.tokenize(c), plain) == [["shipping", "delivery", "contact", "information", "were", "here", "to", "help"]]
    assert one(spark, lambda c: T.tokenize(c, [], True, True, True), shop) == [
        ["www.6pm.com", "call", "us", "1", "888", "676", "2660", "24", "7", "email", "us", "cs@6pm.com"]
    ]
    assert one(spark, lambda c: T.tokenize(c), shop) == [["call", "us", "email", "us"]]
    assert one(spark, lambda c: T.tokenize(c, ["please"]), "Please, help!") == [["help"]]
    assert one(spark, lambda c: T.tokenize(c, keep_emails=True), "Don't γιάννης@δήμος.gr «λέει»…") == [["dont", "γιάννης@δήμος.gr", "λέει"]]


def test_text_helpers(spark):
    assert one(spark, T.whole_sentences, "Το άρθρο παρ. 2 ισχύει. Α. Β. λέγει") == [["Το άρθρο παρ. 2 ισχύει", "Α. Β. λέγει"]]
    assert one(spark, T.fold_greek, "ἂ ᾷ ῶ ἀΐ ᾳ ﬁ", None) == ["ά ά ώ αΐ α fi", None]
    assert one(spark, T.strip_acute, "ά é ö", None) == ["α e ö".replace("ö", "o\u0308"), None]
    assert one(spark, T.is_special_token, "[SEP]", "SEP") == [True, False]
    sub = lambda keep: lambda c: T.first_subwords(F.split(c, " "), 2, keep)
    assert one(spark, sub(False), "[CLS] a b c") == ["a b"] and one(spark, sub(True), "[CLS] a b c") == ["[CLS] a"]
    assert one(spark, T.clean_supreme_court, "αρχή ΣΚΕΦΘΗΚΕ ΣΥΜΦΩΝΑ ΜΕ ΤΟ ΝΟΜΟ μέση ΚΡΙΘΗΚΕ και αποφασίσθηκε τέλος") == ["μέση"]
    assert one(spark, lambda c: T.clean_judgement(c, [], [], T.STATE_COUNCIL_NOISE), "a Αριθμός 12/2001 -3- b\r\nc") == ["a   b c"]
    assert one(spark, T.clean_state_council, "x Σκεφθέν κατά τον νόμον το σώμα\r\nεδώ Η διάσκεψη έγινε y") == ["το σώμα εδώ"]
    assert one(spark, fragments.fragment_tokens, "The cat, 2!") == [["the", "cat", ",", "2", "!"]]
    assert one(spark, lambda c: fragments.fragment_tokens(c, False, True), "The cat, 2!") == [["The", "cat,", "2!"]]
    words = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    assert sorted(r.word for r in tables.union_stopwords(words("ἀπὸ", "και"), words("και", "ὀ")).collect()) == sorted(["από", "και", "ὀ"])


def literal_hits(hyp, ref):
    """Hits of plain common subsequences, by the definition: each marked word counts while both sides have it left."""
    left, there = {}, {}
    for s, bag in ((hyp, left), (ref, there)):
        for x in s:
            for w in x:
                bag[w] = bag.get(w, 0) + 1
    n = 0
    for s in ref:
        marked = np.zeros(len(s), dtype=bool)
        for h in hyp:
            marked |= rouge.lcs_hits(s, h)
        for w, m in zip(s, marked):
            if m and left.get(w, 0) > 0 and there[w] > 0:
                left[w] -= 1
                there[w] -= 1
                n += 1
    return n


def test_every_surviving_hit_counts_once():
    assert rouge.lcs_counts([list("pqa")], [list("pa"), list("qa")])[0] == 3
    rng = np.random.default_rng(0)
    for _ in range(300):
        hyp, ref = ([list(map(str, rng.integers(0, 6, rng.integers(1, 9)))) for _ in range(rng.integers(1, 4))] for _ in range(2))
        assert rouge.lcs_counts(hyp, ref)[0] == literal_hits(hyp, ref)


def test_weighted_runs():
    on = lambda s: np.array([x == "1" for x in s])
    assert rouge._weighted_runs(on("1110110"), on("1110110"), 2.0) == 13
    assert rouge._weighted_runs(on("111011"), on("110011"), 2.0) == 16  # two words without an end go to the next run
    assert rouge._weighted_runs(on("0011"), on("0010"), 2.0) == 0


def test_average_and_modes_of_several_references(spark):
    rows = spark.createDataFrame([(1, "the cats sat. on mats", ["a cat sat on the mat", "dogs"])], "pair_id int, g string, r array<string>")
    run = lambda **k: {(r.ref_id, r.metric): r for r in programs.evaluate(rows, F.col("g"), F.col("r"), **k).collect()}
    each = run()
    assert {k for k, _ in each} == {0, 1} and each[1, "rouge-1"].f == 0
    mean = run(mode="average", metrics=("rouge-1", "rouge-w"))
    counts = [rouge.lcs_counts([["the", "cats", "sat"], ["on", "mats"]], [ref], 1.2) for ref in (["a", "cat", "sat", "on", "the", "mat"], ["dogs"])]
    overlap, _, size = (sum(c) for c in zip(*counts))
    assert set(mean) == {(None, "rouge-1"), (None, "rouge-w")} and np.isclose(mean[None, "rouge-w"].r, (overlap / size) ** (1 / 1.2))
    assert run(mode="best", metrics=("rouge-1",))[0, "rouge-1"].r == each[0, "rouge-1"].r
    stemmed = run(options=rouge.Options(stemming=True))
    assert stemmed[0, "rouge-1"].r > each[0, "rouge-1"].r and stemmed[0, "rouge-l"].r > each[0, "rouge-l"].r
    assert run(options=rouge.Options(byte_limit=3))[0, "rouge-1"].p == 0
    with pytest.raises(ValueError):
        programs.evaluate(rows, F.col("g"), F.col("r"), mode="all")


def test_presentation(spark):
    scored = spark.createDataFrame([(1, 0, "rouge-l", 0.1234, 0.5, 0.2), (1, 0, "rouge-1", 1.0, 0.5, 0.2)], "pair_id int, ref_id int, metric string, p double, r double, f double")
    lines = [r.line for r in rouge.result_line(rouge.in_metric_order(scored)).collect()]
    assert lines == ["\trouge-1:\tP: 100.00\tR: 50.00\tF1: 20.00", "\trouge-l:\tP: 12.34\tR: 50.00\tF1: 20.00"]
    assert "+/-" in rouge.result_line(rouge.corpus_stats(scored)).first().line
    pairs = spark.createDataFrame([(1, 0, [["a", "b"]], [["a"], ["b", "c"]])], "pair_id int, ref_id int, hyp_sents array<array<string>>, ref_sents array<array<string>>")
    row = rouge.rouge_lsum(pairs).first()
    assert (row.metric, row.overlap, row.evaluated, row.reference) == ("rouge-lsum", 2, 3, 2)
    tokens = spark.createDataFrame([([" The ", "Cat", "x-y"],)], "t array<string>")
    assert tokens.select(rouge.normalised_tokens(F.col("t"), ("the",))).first()[0] == ["cat", "x", "y"]
    dots = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (0.999, 0.51), (2.0, 0.0)], "x double, y double")
    assert {tuple(r) for r in tables.histogram_2d(dots, "x", "y", (0, 1), (0, 1), 2).collect()} == {(0, 0, 1), (1, 1, 2)}


def test_undamped_scores_by_component(spark):
    text = "apple pear. pear apple. apple pear plum. iron steel. steel iron. solo. 12"
    other = "zinc. word"
    docs = spark.createDataFrame([(1, text), (2, other)], "doc_id long, text string")
    sents, _, unit = programs.weights(docs)
    got = {(r.doc_id, r.sent_ix): r.score for r in centrality.undamped(unit, sents).collect()}
    want = {(r.doc_id, r.sent_ix): r.score for r in centrality.per_document(unit, sents, method="undamped").collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)
    assert np.isclose(sum(got[1, k] for k in range(3)), 3) and np.isclose(sum(got[1, k] for k in (3, 4)), 2) and got[1, 5] == got[1, 6] == 1


def test_component_scores_of_random_graphs():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n, entries = int(rng.integers(1, 12)), int(rng.integers(1, 14))
        cells = {(int(r), int(t)) for r, t in zip(rng.integers(0, n, entries), rng.integers(0, 15, entries))} | {(k, 100 + k) for k in range(n)}
        row, term = (np.array(x) for x in zip(*sorted(cells)))
        x = rng.random(len(row)) + 0.1
        m = np.zeros((n, 200))
        m[row, term] = x
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        assert np.allclose(centrality.component_scores(row, term, m[row, term]), centrality.scores_of(m @ m.T, "undamped"))


def test_metrics_change_the_summary(spark):
    text = "a b c d. a b. c d e f g h. e f. x y z. z z z w"
    docs = spark.createDataFrame([(1, text), (2, "a c e. b d")], "doc_id long, text string")
    vectors = spark.createDataFrame([(w, [float(k % 3), float(k % 2), 1.0]) for k, w in enumerate("abcdefghxyzw")], "term string, embedding array<double>")
    found = [programs.summarize(docs, programs.SummaryOptions(size=6, similarity=m), vectors=vectors).filter("doc_id = 1").first().summary for m in similarity.METRICS[:3]]
    assert len(set(found)) == 3


def test_earlier_near_duplicates_go(spark):
    base = " ".join(f"w{k}" for k in range(200))
    rows = [(k, "c", base if k in (0, 3, 15) else " ".join(f"x{k}y{j}" for j in range(200)), 7) for k in range(16)] + [(99, None, base, 7)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string, n int")
    kept = neighbours.remove_near_duplicates(d, "source", "doc_id")
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [*range(1, 16), 99]
    shares = {r.category: (r.n, r.removed, r.kept_share) for r in neighbours.kept_shares(d, "source", "doc_id").collect()}
    assert shares == {"c": (16, 1, 0.9375), None: (1, 0, 1.0)}


def test_bias_by_vectors(spark):
    vectors = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 0.0]), (1, 2, [-1.0, 0.0])], "doc_id int, sent_ix int, embedding array<double>")
    bias = spark.createDataFrame([([1.0, 1.0],), ([1.0, -1.0],)], "embedding array<double>")
    assert {r.sent_ix: round(r.share, 6) for r in centrality.bias_by_vectors(vectors, bias).collect()} == {0: 1.0, 1: 0.0, 2: 0.0}


def test_idf_of_sentences_with_abbreviations(spark):
    docs = spark.createDataFrame([(1, "παρ. 2 ισχύει. ναι")], "doc_id int, text string")
    assert [r.sent for r in terms.sentence_rows(docs, True).orderBy("sent_ix").collect()] == ["παρ. 2 ισχύει", "ναι"]
