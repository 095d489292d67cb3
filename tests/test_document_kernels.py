"""What is counted where a document lies: sentence graphs, n-grams, blocks of vectors, signed tokens, weighted subsequences."""

import random

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusloom.operators import boundaries, rouge, similarity, terms
from corpusloom.plans import summarize

DATA = entry.DATA


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_and_chains_without_a_join_of_pairs(spark):
    texts = ["the cat sat. the dog sat. a bird flew. the cat flew.", "one two. two three. four", None, "", "..", "same words. same words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    sents, tf, unit = summarize.weights(docs)
    keys, _, weighted = summarize.keyed_weights(docs)
    assert sorted(keys.collect()) == sorted(sents.select("doc_id", "sent_ix").collect())
    flat = lambda df, c: {(r.doc_id, r.i, r.j): round(r[c], 9) for r in df.collect()}
    edges = similarity.document_edges(weighted, keys)
    assert flat(edges, "sim") == flat(similarity.cosine_edges(unit), "sim") != {}
    m = similarity.both_ways(similarity.cosine_edges(unit), sents)
    assert flat(similarity.document_markov(weighted, keys), "p") == flat(similarity.markov(m), "p")
    assert flat(similarity.document_markov(weighted, keys, 0.1), "p") == flat(similarity.markov(m.withColumn("sim", F.round("sim", 9)), 0.1), "p")


def test_pairs_are_not_shuffled(spark):
    for name in ("cosine_edges", "markov_continuous", "markov_threshold", "common_word_edges"):
        plan = _plan(entry.queries()[name](spark, DATA))
        assert "SortMergeJoin" not in plan and "Window" not in plan and plan.count("hashpartitioning(doc_id") <= 2, name  # one exchange, shown twice at most


def test_term_rows_equal_term_frequency(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(50)
    found = terms.document_terms(docs, ["the"])
    want = terms.term_frequency(terms.sentence_rows(docs), stopwords=["the"])
    assert sorted(found.filter("term IS NOT NULL").drop("seen").collect()) == sorted(want.collect())
    assert sorted(terms.idf_of_terms(found).collect()) == sorted(terms.idf_table(want).collect())


def test_ngrams_are_counted_in_their_row(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a", "b"]), (2, ["a"]), (3, []), (4, None)], "k int, t array<string>")
    for n in (1, 2, 3):
        found = rouge.ngram_counts_by_row(rows, ["k"], "t", n)
        assert sorted(found.collect()) == sorted(rouge.ngram_counts(rows, ["k"], "t", n).collect())
        assert "Exchange" not in _plan(found)
    assert "Exchange" not in _plan(entry.queries()["ngram_counts"](spark, DATA))


def test_vectors_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 7)
    monkeypatch.setattr(similarity, "CELL", 20)
    v = np.random.default_rng(1).normal(size=(60, 4))
    rows = [(k % 2, k, v[k].tolist()) for k in range(60)] + [(0, 60, [0.0] * 4), (0, 61, None), (None, 62, [1.0] * 4), (1, 63, [1.0, 2.0])]
    df = similarity.vector_edges(spark.createDataFrame(rows, "g int, id int, v array<double>"), "g", "id", "v", 0.3)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    want = {(i % 2, i, j) for i in range(60) for j in range(i + 1, 60) if i % 2 == j % 2 and unit[i] @ unit[j] >= 0.3}
    got = df.collect()
    assert {(r.g, r.i, r.j) for r in got} == want and len(got) == len(want)
    assert all(abs(r.sim - unit[r.i] @ unit[r.j]) < 1e-12 for r in got) and "SortMergeJoin [g" not in _plan(df)


def test_word_vectors_are_not_shuffled(spark):
    weighted = spark.createDataFrame([(1, 0, "a", 2.0), (1, 0, "b", 1.0), (2, 0, "a", 1.0), (2, 1, "c", 1.0)], "doc_id int, sent_ix int, term string, w double")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 3.0])], "term string, embedding array<float>")
    found = similarity.sentence_vectors(weighted, vectors)
    assert sorted((r.doc_id, r.sent_ix, r.v) for r in found.collect()) == [(1, 0, [2.0, 3.0]), (2, 0, [1.0, 0.0])]
    plan = _plan(found)
    assert "hashpartitioning(term" not in plan and "hashpartitioning(doc_id#" in plan and "hashpartitioning(doc_id" in plan and "sent_ix" not in "".join(x for x in plan.split("\n") if "hashpartitioning" in x)


def test_tokens_are_counted_before_they_are_looked_at(spark):
    docs = spark.createDataFrame([(1, "Dr. Who said: (no!) \"well.\" Then 3.5 came... etc. and so on."), (2, None), (3, " "), (4, "a?! b. c.d. ,.")], "doc_id int, text string")
    pairs = boundaries.token_pairs(docs)
    assert sorted(boundaries.token_counts(docs).collect()) == sorted(boundaries.word_counts(pairs).collect())
    want = pairs.filter("stop OR ends").groupBy("word", "stop", "ends", "next").agg(F.count("*").alias("c"))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, boundaries.signed_pairs(docs).collect())) == sorted(map(key, want.collect()))


def test_weighted_subsequences_without_foreign_words():
    draw = random.Random(3)
    for _ in range(400):
        x, y = ([draw.choice("abcdefgh"[: draw.randint(2, 8)]) for _ in range(draw.randint(0, 14))] for _ in range(2))
        x = [w + draw.choice(["", "", "x"]) for w in x]
        _, move = rouge.lcs_table(x, y, 1.2)
        want, i, j = np.zeros(len(x), dtype=bool), len(x), len(y)
        while i and j:
            if move[i, j] == 0:
                want[i - 1] = True
            i, j = i - (move[i, j] != 2), j - (move[i, j] != 1)
        assert (rouge.lcs_hits(x, y, 1.2) == want).all(), (x, y)
    assert rouge._squeezed(list("pqabpqr"), set("ab"), None) == ([None, "a", "b", None], [0, 2, 3, 4])
