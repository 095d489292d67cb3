import re

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import jaccard_join as J, joins

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def brute(rows, percent=75):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = []
    for i, t in rows:
        w = WORD.findall(low(t))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    label = {i: i for i, _ in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets:
            for j, b in sets:
                if a and b and label[i] != label[j] and 100 * len(a & b) >= percent * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return sorted((i, len(s), label[i]) for i, s in sets)


def check(docs, **options):
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.link(docs, J.Options(**options), partitions=3).collect())
    assert got == want


def corpus(seed, n=60):
    rng = np.random.default_rng(seed)
    out = []
    passage = [f"p{k}" for k in range(30)]
    for k in range(n):
        base = [f"b{k % 12}w{j}" for j in range(int(np.random.default_rng(k % 12).integers(1, 60)))]
        words = list(base)
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(0, len(words)))] = f"e{rng.integers(1000)}"
        if k % 5 == 0:
            words += passage
        out.append((k, " ".join(words).upper() if k % 7 == 0 else " ".join(words)))
    return out


def test_components_against_brute_force(make_docs):
    check(make_docs(*corpus(0)))


def test_small_blocks_and_buckets(make_docs):
    check(make_docs(*corpus(1, 40)), block=3, bucket_keys=10)


def test_short_sets_of_every_size(make_docs):
    texts = [" ".join(f"w{j}" for j in range(a, a + n)) for n in range(1, 14) for a in (0, 1)]
    check(make_docs(*enumerate(texts)))


def test_edges(edge_docs, no_docs):
    got = sorted((r.doc_id, r.component_id) for r in J.link(edge_docs).collect())
    assert got == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (5, 4), (6, 6), (7, 7), (8, 8)]
    assert J.link(no_docs).count() == 0 and J.keep_first(no_docs).count() == 0
    kept = J.keep_first(edge_docs)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6, 7, 8] and kept.columns == edge_docs.columns


def test_boundary_follows_cost():
    assert J.boundary({4: 100}, J.Options(meeting_cost=1.0), 100.0) >= 4
    assert J.boundary({40: 100}, J.Options(), 0.0) < 40


def test_mean_length_of_lists_is_measured_on_the_sample(spark):
    rng = np.random.default_rng(7)
    lists = [(int(k), int(rng.integers(1, 400))) for k in range(3000)]
    truth = sum(m * (m - 1) for _, m in lists) / sum(m for _, m in lists)
    sampled = [([k] * int(rng.binomial(m, 1 / J.SAMPLED)),) for k, m in lists]
    found = J.others_met(spark.createDataFrame([(x or None,) for (x,) in sampled], "sampled array<bigint>"))
    assert abs(found - truth) < 0.2 * truth
    assert J.others_met(spark.createDataFrame([], "sampled array<bigint>")) == 0


def test_a_shingle_that_all_documents_share(make_docs, monkeypatch):
    settled, plain = [], J.settle
    monkeypatch.setattr(joins, "HOT_KEYS", 5)
    monkeypatch.setattr(J, "settle", lambda df, name: settled.append(name) or plain(df, name))
    common = "one two three four five"
    rows = [(k, f"{common} " + t) for k, t in corpus(4, 50)] + [(100 + k, common) for k in range(30)] + [(200 + k, f"{common} tail{k}") for k in range(30)]
    check(make_docs(*rows), hot_bucket=5, hot_times=1.0, bucket_keys=20, block=4)
    assert "hot-entries" in settled


def test_sets_that_link_are_of_neighbouring_classes(spark):
    sizes = spark.range(1, 40_000).select(F.col("id").alias("n"), F.ceil(F.col("id") * 75 / 100).alias("least"))
    for percent in (75, 50, 90):
        d = sizes.select(J.size_class(F.col("n"), percent).alias("a"), J.size_class(F.greatest(F.ceil(F.col("n") * percent / 100), F.lit(1)), percent).alias("b"))
        assert d.filter("a - b not in (0, 1)").isEmpty()


def test_light_keys_meet_whenever_sets_link():
    rng = np.random.default_rng(3)
    o = J.Options()
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, rng.integers(2, 90)).astype(np.uint64))
        b = np.unique(np.concatenate([rng.permutation(a)[: max(1, int(len(a) * rng.uniform(0.7, 1)))], rng.integers(0, 2**63, rng.integers(0, 20)).astype(np.uint64)]))
        if J.links(len(a), len(b), len(np.intersect1d(a, b)), 75) and not np.array_equal(a, b):
            for limit in (0, 10, 30, 64):
                assert len(np.intersect1d(J.keys_of(a, limit, o), J.keys_of(b, limit, o)))


def test_ids_that_are_text(make_docs):
    docs = make_docs(*corpus(2, 40)).selectExpr("lpad(cast(doc_id as string), 4, '0') as doc_id", "text")
    got = sorted((int(r.doc_id), r.n_shingles, int(r.component_id)) for r in J.link(docs, J.Options(block=3)).collect())
    assert got == brute(corpus(2, 40))


def test_common_keys_are_dealt_out_once(spark):
    found = spark.createDataFrame([(5, 1, 2), (6, 1, 3), (5, 2, 2)], "key long, owner long, df long")
    classes = spark.createDataFrame([(1, 9, 10, 4), (2, 9, 11, 4)], "s1 long, s2 long, rep long, n long")
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        rows = J._keys_of_classes(found, classes)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(owner") + plan.count("Exchange hashpartitioning(s1") <= 2 and plan.count("Exchange") == 2
        assert sorted((r.rep, r.n, [(k.df, k.key) for k in r["keys"]]) for r in rows.collect()) == [(10, 4, [(2, 5), (3, 6)]), (11, 4, [(2, 5)])]
    finally:
        spark.conf.set(limit, before)


def test_texts_are_picked_where_they_lie(make_docs, monkeypatch):
    docs = make_docs(*corpus(5, 40)).select("doc_id", "text")
    wanted = docs.sparkSession.createDataFrame([(3,), (7,), (99,)], "rep long")
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = docs.sparkSession.conf.get(limit)
    docs.sparkSession.conf.set(limit, "-1")
    try:
        rows = J._picked(docs, "doc_id", wanted, "rep")
        assert "Exchange hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.doc_id for r in rows.collect()) == [3, 7]
        monkeypatch.setattr(J, "BROADCAST_IDS", 2)
        assert sorted(r.doc_id for r in J._picked(docs, "doc_id", wanted, "rep").collect()) == [3, 7]
        check(make_docs(*corpus(5, 40)))
    finally:
        docs.sparkSession.conf.set(limit, before)
