from corpusloom.runtime import settle

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    import corpus_pipeline as pipeline
    from test_jaccard_join import brute as components
    from test_substring_dedup import brute as repeats

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, []
    for _, stage in pipeline.STAGES[:-1]:
        before = docs
        docs = settle(stage(spark, docs, DATA), "test-stage")
        assert docs.columns == columns
        seen.append((before, docs))
    ids = lambda d: {r.doc_id for r in d.collect()}
    assert ids(seen[0][1]) < ids(seen[0][0]) and ids(seen[1][1]) <= ids(seen[1][0])
    before, after = seen[2]
    want = components([(r.doc_id, r.text) for r in before.collect()])
    assert ids(after) == {i for i, _, c in want if i == c}
    before, after = seen[3]
    lost = {i: n for i, _, n, _ in repeats([(r.doc_id, r.text) for r in before.collect()])}
    old = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        assert (len(old[r.doc_id].split()) - len(r.text.split()) if r.text != old[r.doc_id] else 0) == lost[r.doc_id]
    rows = pipeline.packed(spark, docs, DATA).collect()
    assert {r.doc_id for r in rows} == ids(docs) and all(r.offset + r.length <= 2048 for r in rows)


def test_empty_documents(spark, tmp_path):
    import corpus_pipeline as pipeline

    for name in ("documents", "labels"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
