import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import centrality, fragments, neighbours, pages, rouge, select, tables, terms
from corpusloom.plans import summarize as programs


def test_keep_first_and_counts(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, "z"), (4, None, "w")], "ix int, url string, t string")
    assert {(r.url, r.t) for r in tables.keep_first(rows, "url", "ix").collect()} == {("a", "x"), (None, "z")}
    assert tuple(tables.duplicate_counts(rows, "url").first()) == (4, 2, 2)


def test_category_exclusion_keeps_nulls(spark):
    rows = spark.createDataFrame([("a_b",), ("a b",), (None,), ("c",)], "c string")
    assert sorted(str(r.c) for r in tables.exclude_categories(rows, "c", ["a b"]).collect()) == ["None", "c"]


def test_sort_by_year_drops_only_above_the_limit(spark):
    rows = spark.createDataFrame([(k, f"01/02/{2000 + k}") for k in range(5)], "row_ix int, date string")
    assert [r.row_ix for r in tables.sort_by_year(rows, "date", "row_ix", 2).collect()] == [2, 3, 4]
    assert tables.sort_by_year(rows, "date", "row_ix", 5).count() == 5


def test_undamped_scores_follow_row_sums():
    m = np.array([[1, 0.5, 0, 0], [0.5, 1, 0, 0], [0, 0, 1, 0.2], [0, 0, 0.2, 1]])
    assert np.allclose(centrality.scores_of(m, "undamped"), [1, 1, 1, 1])
    m = np.array([[1, 0.5, 0.5], [0.5, 1, 0], [0.5, 0, 1]])
    p = m / m.sum(1, keepdims=True)
    s = centrality.scores_of(m, "undamped") / 3
    assert np.allclose(s @ p, s)


def test_row_sums_without_pairs_match_pairs(spark):
    docs = spark.createDataFrame([(1, "red fox runs. the fox sleeps. a dog runs. zzz"), (2, "one word. two words here")], "doc_id long, text string")
    sents, _, unit = programs.weights(docs)
    from corpusloom.operators import similarity

    pairs = similarity.both_ways(similarity.cosine_edges(unit), sents).groupBy("doc_id", "i").agg(F.sum("sim").alias("t"))
    a = {(r.doc_id, r.i): round(r.t, 9) for r in pairs.collect()}
    b = {(r.doc_id, r.sent_ix): round(r.total, 9) for r in centrality.row_sums(unit, sents).collect()}
    assert a == b


def test_damped_sums_to_one(spark):
    docs = spark.createDataFrame([(1, "red fox runs. the fox sleeps. a dog runs. zzz"), (2, "x")], "doc_id long, text string")
    sents, _, unit = programs.weights(docs)
    total = centrality.per_document(unit, sents).groupBy("doc_id").agg(F.sum("score").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in total)


@pytest.mark.parametrize(
    "m, expected",
    [
        ([[1.0]], [1]),
        ([[0.6, 0.1, 0.3], [0.1, 0.7, 0.2], [0.2, 0.2, 0.6]], [0.2759, 0.3448, 0.3793]),
    ],
)
def test_stationary_distributions(m, expected):
    p = np.array(m)
    v = centrality.power_iteration(p, np.full(len(p), 1 / len(p)), damping=1.0, steps=500)
    assert np.allclose(v, expected, atol=1e-4)


def test_selection_sizes(spark):
    sents = spark.createDataFrame([(1, k, f"s{k}") for k in range(4)], "doc_id int, sent_ix int, sent string")
    ranked = select.rank_sentences(spark.createDataFrame([(1, 0, 0.1), (1, 1, 0.4), (1, 2, 0.4), (1, 3, 0.2)], "doc_id int, sent_ix int, score double"))
    assert select.summaries(ranked, sents, 2).first().summary == "s2 s1"
    assert select.summaries(ranked, sents, 0.5).first().summary == " s1 s2 "
    assert select.summaries(ranked, sents).first().summary == "s2 s1 s3 s0"
    with pytest.raises(TypeError):
        select.summaries(ranked, sents, "2")


def test_split_lengths(spark):
    parts = select.seeded_split(spark.range(101).withColumnRenamed("id", "doc_id"), [70, 20, 10]).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts} == {0: 71, 1: 20, 2: 10}


def test_rouge_n_counts_and_modes(spark):
    pairs = spark.createDataFrame([(1, 0, "a b c a".split(), "a a d".split()), (1, 1, "a b c a".split(), "a b c".split()), (2, 0, [], ["x"])], "pair_id int, ref_id int, hyp array<string>, ref array<string>")
    one = {(r.pair_id, r.ref_id): (r.overlap, r.evaluated, r.reference) for r in rouge.rouge_n(pairs, 1).collect()}
    assert one == {(1, 0): (2, 4, 3), (1, 1): (3, 4, 3), (2, 0): (0, 0, 1)}
    avg = {r.pair_id: r for r in rouge.average(rouge.rouge_n(pairs, 1)).collect()}
    assert (avg[1].overlap, avg[1].evaluated) == (5, 8) and avg[2].f == 0
    assert {r.pair_id: r.ref_id for r in rouge.best(rouge.rouge_n(pairs, 1)).collect()} == {1: 1, 2: 0}


def brute_lcs(x, y):
    if not x or not y:
        return 0
    return brute_lcs(x[1:], y[1:]) + 1 if x[0] == y[0] else max(brute_lcs(x[1:], y), brute_lcs(x, y[1:]))


def test_lcs_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(60):
        x, y = (list(map(str, rng.integers(0, 4, rng.integers(0, 8)))) for _ in range(2))
        assert rouge.lcs_hits(x, y).sum() == brute_lcs(x, y) == rouge.lcs_table(x, y)[0][-1, -1]


def test_lcs_exponent_golden():
    # 34 of 96 and 99 words with the exponent 1/1.2
    assert round(100 * (34 / 96) ** (1 / 1.2), 2) == 42.11
    o, e, r = rouge.lcs_counts([["a", "b", "c"]], [["a", "b", "x", "c"]], 1.2)
    assert np.isclose(o, 2**1.2 + 1) and np.isclose(e, 3**1.2) and np.isclose(r, (4**1.2) ** 1.2)


def brute_fragments(s, t):
    out, a = [], 0
    while a < len(s):
        best, b = (0, -1), 0
        while b < len(t):
            n = 0
            while a + n < len(s) and b + n < len(t) and s[a + n] == t[b + n]:
                n += 1
            if n > best[0]:
                best = (n, b)
            b += max(n, 1)
        if best[0]:
            out.append((a, best[1], best[0]))
        a += max(best[0], 1)
    return out


def test_fragments_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        s, t = (list(map(str, rng.integers(0, 3, rng.integers(0, 12)))) for _ in range(2))
        assert fragments.greedy_fragments(s, t) == brute_fragments(s, t)


def test_fragment_stats(spark):
    rows = spark.createDataFrame([(["a", "b"], ["x", "a", "b"]), ([], ["a"])], "summary_tokens array<string>, text_tokens array<string>")
    got = {(r.coverage, r.density, r.compression) for r in fragments.fragment_stats(rows).collect()}
    assert got == {(1.0, 2.0, 1.5), (0.0, 0.0, 0.0)}


def test_neighbours_reach_nine(spark):
    rows = spark.createDataFrame([("c", k, "text") for k in range(12)], "category string, row_ix int, text string")
    got = {(r.ix, r.jx) for r in neighbours.candidates(rows, "category", "row_ix").collect()}
    assert got == {(i, j) for i in range(12) for j in range(i + 1, min(12, i + 10))}
    assert max(r.jx for r in neighbours.candidates(rows, "category", "row_ix", skip_last=True).collect()) == 10


def test_pages(spark):
    html = "<html><title>T</title><script>x()</script><p>a&amp;b<br>c</p><a href=\"/u\">l</a>"
    row = pages.page_text(spark.createDataFrame([(html,)], "html string")).select("body", pages.title(F.col("html")), pages.links(F.col("html"))).first()
    assert tuple(row) == ("T\na&b\nc\nl", "T", ["/u"])
    assert pages.crawl_requests(spark, 2000, 2001, 3).count() == 6


def test_idf_defaults(spark):
    docs = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id int, text string")
    tf = terms.term_frequency(terms.sentence_rows(docs))
    assert {r.term: round(r.idf, 6) for r in terms.idf_table(tf).collect()} == {"one": 0.693147, "two": 0.693147}
    assert round(terms.default_idf(tf).first()[0], 6) == round(float(np.log(3)), 6)


def test_porter_examples():
    from corpusloom.operators.stem import porter, stem_token

    pairs = "caresses caress,ponies poni,feed feed,agreed agre,hopping hop,filing file,happy happi,sky sky,relational relat,vietnamization vietnam,electriciti electr,adjustment adjust,adoption adopt,cease ceas,controll control"
    assert all(porter(a) == b for a, b in (p.split() for p in pairs.split(",")))
    assert stem_token("dogs", {"dogs": "hound"}) == "hound" and stem_token("its") == "its"


def test_pair_similarity(spark):
    from corpusloom.operators import similarity

    pairs = spark.createDataFrame([(1, ["a", "b"], ["b", "a"]), (2, ["a"], ["c"]), (3, [], ["a"])], "id int, a array<string>, b array<string>")
    idf = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "term string, idf double")
    got = {r.id: round(r.sim, 9) for r in similarity.pair_similarity(pairs, idf, 3.0).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0}


def test_link_stream_gives_each_link_once(spark, tmp_path):
    from corpusloom.streaming.links import new_links

    rows = spark.createDataFrame([("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 01:00:00"), ("v", "2024-01-01 02:00:00")], "url string, t string")
    rows.select("url", F.to_timestamp("t").alias("ts")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("url string, ts timestamp").parquet(f"{tmp_path}/in")
    q = new_links(stream).writeStream.format("memory").queryName("seen_links").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.url for r in spark.table("seen_links").collect()) == ["u", "v"]


def test_idf_straight_from_documents(spark):
    docs = spark.createDataFrame([(1, "a b. a c!"), (2, "b\nB d"), (3, "12 ."), (4, None)], "doc_id int, text string")
    tf = terms.term_frequency(terms.sentence_rows(docs))
    both = [sorted((r.term, r.df, round(r.idf, 9)) for r in t.collect()) for t in (terms.idf_table(tf), terms.idf_of_documents(docs))]
    assert both[0] == both[1] and ("b", 2, 0.0) in both[0]
    assert {(r.doc_id, r.sent_ix, r.term, r.tf) for r in tf.filter("doc_id = 2").collect()} == {(2, 0, "b", 1), (2, 1, "b", 1), (2, 1, "d", 1)}
