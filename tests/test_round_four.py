"""Cases of the findings of round 4."""

from __future__ import annotations

from pyspark.sql import functions as F


def test_csv_keeps_white_space_and_empty_texts(spark, tmp_path):
    from corpusloom.plans import more_queries

    texts = ["", None, " ", " lead", "trail ", "\ttab\t", "\r", "\n", "a\n", "\r\na\r\n", "\0", '"', '""', " ,", "\\", '\\"', "null", "x\r\ny"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", "text", F.col("text").alias("lang"))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    found = more_queries.csv_round_trip(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in found) == [(i, t, t) for i, t in enumerate(texts)]


def test_csv_limit_keeps_empty_texts(spark, tmp_path):
    from corpusloom.sources import readers, writers

    writers.write_table(spark.createDataFrame([(1, ""), (2, None), (3, " c")], "row_ix long, text string"), str(tmp_path / "c"), single=True)
    read = lambda **how: [r.text for r in readers.read_csv(spark, str(tmp_path / "c"), "row_ix long, text string", 3, **how).collect()]
    assert read(keep_empty=True) == ["", None, " c"]
    assert read() == [None, None, " c"]


def test_lines_round_by_the_binary_value(spark):
    import random

    from corpusloom.operators import rouge

    r = random.Random(4)
    sizes = [8, 16, 32, 80, 160, 200, 400, 800, 1600, 4000, 8000, 20000]
    scores = [0.0, 1.0, 0.28285, 0.00125, 0.00375, 0.03125, 1e-12] + [round(r.randint(0, n) / n, 12) for n in (r.choice(sizes) for _ in range(3000))]
    rows = spark.createDataFrame([(k, "rouge-1", p, p, p) for k, p in enumerate(scores)], "k int, metric string, p double, r double, f double")
    lines = {x.k: x.line for x in rouge.result_line(rows).collect()}
    assert lines == {k: "\trouge-1:\tP: {0:5.2f}\tR: {0:5.2f}\tF1: {0:5.2f}".format(100 * p) for k, p in enumerate(scores)}


def test_learned_model_keeps_all_entries(spark):
    from corpusloom.operators import boundaries as B

    # more abbreviations than any list of a fixed length held: `aa.` to `zzz.` with full stops, each twice
    letters = "abcdefghijklmnopqrstuvwxyz"
    short = [a + b + c for a in letters for b in letters for c in letters]
    texts = [" ".join(f"{w}. x {w}. y" for w in short[k : k + 500]) for k in range(0, len(short), 500)] + ["plain words " * 200_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    model = B.learn(rows)
    assert len(model.abbreviations) == len(short) > 10_000
    got = B.split(spark.createDataFrame([("zzz. Aaa. b",)], "text string"), model).first().sentences
    assert got == ["zzz. Aaa. b"]


def test_counts_of_odd_tokens(spark):
    import random

    from corpusloom.operators import boundaries as B

    r = random.Random(6)
    bits = ["a", "cf.", "U.S.", "J.", "We", "5.", "5,3.", ".", "..", "!", "?", "(", ")", '"', "»", ":", " ", " ", "\t", "\n", "\x0b", "\u0085", " ", "\xa0", "É.", "ΟΔΟΣ.", "İ.", "\x1c"]
    rows = spark.createDataFrame([("".join(r.choice(bits) for _ in range(r.randint(0, 14))),) for _ in range(3000)] + [(None,), ("",)], "text string")
    pairs = B.token_pairs(rows)
    assert sorted(map(tuple, B.token_counts(rows).collect())) == sorted(map(tuple, B.word_counts(pairs).collect()))
    want = pairs.filter("stop OR ends").groupBy("word", "stop", "ends", "next").agg(F.count("*").alias("c"))
    key = lambda x: (x.word, x.stop, x.ends, x.next or "", x.next is None, x.c)
    assert sorted(map(key, B.signed_pairs(rows).collect())) == sorted(map(key, want.collect()))


def _some_documents(spark, n=60):
    import random

    r = random.Random(7)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200)]
    texts = ["".join(" ".join(r.choice(words) for _ in range(r.randint(1, 9))) + r.choice([". ", "! ", "\n"]) for _ in range(r.randint(1, 20))) for _ in range(n)]
    texts += [None, "", " . ", "same same. same", "lonely" * 3, "Dr. who. Dr. who"]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_graphs_and_summaries_of_placed_documents(spark, monkeypatch):
    from corpusloom.operators import centrality, similarity
    from corpusloom.plans import summarize as programs

    docs = _some_documents(spark)
    monkeypatch.setattr(centrality, "PLACED_WORDS", 50)
    placed, rows = programs.document_weights(docs)
    assert isinstance(placed, centrality.Placed)
    # nothing but partial counts of the IDF table is shuffled: the plan of the matrix has no exchange
    markov = similarity.document_markov(placed, rows)
    assert "Exchange" not in markov._jdf.queryExecution().executedPlan().toString()
    sents, _, weighted = programs.keyed_weights(docs)
    key = lambda p: sorted((r.doc_id, r.i, r.j, round(r.p, 9)) for r in p.collect())
    assert key(markov) == key(similarity.document_markov(weighted, sents))
    options = [programs.SummaryOptions(**how) for how in ({"size": 4, "limit_fraction": 0.5}, {"size": 0.5}, {"method": "lexrank_undamped"}, {"size": 2, "threshold": 0.1, "stopwords": ("wab", "wcd")})]
    mine = [{r.doc_id: r.summary for r in programs.summarize(docs, o).collect()} for o in options]
    assert "Exchange" not in programs.summarize(docs, options[0])._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(programs, "PLACED_TERMS", -1)  # rows are brought together by id
    assert not isinstance(programs.document_weights(docs)[0], centrality.Placed)
    assert mine == [{r.doc_id: r.summary for r in programs.summarize(docs, o).collect()} for o in options]


def test_repeated_ids_are_brought_together(spark):
    from corpusloom.operators import centrality, similarity
    from corpusloom.plans import summarize as programs

    docs = spark.createDataFrame([(1, "a b. c d"), (1, "a c. b d"), (2, "a x")], "doc_id long, text string")
    found, rows = programs.document_weights(docs)
    assert not isinstance(found, centrality.Placed) and similarity.document_markov(found, rows).count() > 0
    assert programs.document_weights(docs.limit(0))[0].rows.count() == 0
