import math
import random
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import ranked_search as R


def brute(docs, items, k=20):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    docs = [(i, R.term_counts(t)) for i, t in docs]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, all_terms = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in docs:
            m, score = 75 + 25 * n * n_docs // all_terms, 0
            for t, q in R.term_counts(text).items():
                if c[t]:
                    score += q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            if score and i is not None:
                found.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def rows_of(frame):
    return sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in frame.collect())


def texts(seed, n, most=60):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(80)] + ["É", "漢字", "a1"]
    return [" ".join(r.choice(words[: r.choice([5, 20, 83])]).upper() if r.random() < 0.1 else r.choice(words) for _ in range(r.randint(0, most))) for _ in range(n)]


def items_of(spark, pairs):
    return spark.createDataFrame([(i, t, 1, "x", 2.0) for i, t in pairs], "item_id long, text string, rank int, term string, score double")


@pytest.mark.parametrize("options", [R.Options(), R.Options(k=5, shard_docs=32, block_terms=60), R.Options(k=3, shard_postings=50)], ids=["one shard", "blocks", "small shards"])
def test_against_brute_force(spark, make_docs, options):
    docs = [*enumerate(texts(1, 300)), (900, None), (901, ""), (902, "W1 w1 W1"), (903, "W1 w1 W1")]
    items = [*enumerate(texts(2, 12, 25)), (70, None), (71, "!!"), (72, "nowhere"), (73, "w1 w1 w1")]
    got = rows_of(R.search(make_docs(*docs).repartition(5), items_of(spark, items), options))
    assert got == brute(docs, items, options.k)


def test_edge_rows(spark, edge_docs, no_docs):
    items = [(1, "tie1 tie2 three"), (2, "w5x5 w6x6")]
    docs = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert rows_of(R.search(edge_docs, items_of(spark, items))) == brute(docs, items)
    assert R.search(no_docs, items_of(spark, items)).count() == 0
    assert R.search(edge_docs, items_of(spark, [])).count() == 0
    null_id = edge_docs.limit(0).union(spark.createDataFrame([(None, "tie1 b", "en", "s", 1, "k", 0.5, 7, "x", ["a"]), (3, "tie1", "en", "s", 1, "k", 0.5, 7, "x", ["a"])], edge_docs.schema))
    assert rows_of(R.search(null_id, items_of(spark, [(1, "tie1 b")]))) == brute([(None, "tie1 b"), (3, "tie1")], [(1, "tie1 b")])


def test_treaps_are_trees_by_document_and_heaps_by_impact():
    r = np.random.default_rng(3)
    doc, term, impact = (r.integers(0, n, 4000) for n in (1500, 7, 900))
    doc, term = np.divmod(np.unique(doc * 7 + term), 7)
    impact = impact[: len(doc)] + 1
    t = R.Treaps(doc, term, impact)
    assert (t.bound[:-1] >= t.impact[:-1]).all()
    for root in t.root.values():
        todo, depth = [(root, -1, 10**9, 0)], 0
        while todo:
            v, low, high, d = todo.pop()
            if v == t.none:
                continue
            depth = max(depth, d)
            assert low < t.doc[v] < high
            assert all(t.bound[x] <= t.bound[v] for x in (t.left[v], t.right[v]))
            todo += [(t.left[v], low, t.doc[v], d + 1), (t.right[v], t.doc[v], high, d + 1)]
        assert depth < 60


def test_equal_impacts_make_shallow_treaps():
    t = R.Treaps(np.arange(5000), np.zeros(5000, dtype=int), np.full(5000, 7))
    level, depth = [t.root[0]], 0
    while level:
        level, depth = [x for v in level for x in (t.left[v], t.right[v]) if x != t.none], depth + 1
    assert depth < 60


def test_bounds_prune():
    """A query whose best documents stand out looks at few of the others."""
    r = np.random.default_rng(5)
    n = 20_000
    rows = [(d, t, int(r.integers(1, 50))) for t in range(6) for d in r.choice(n, 4000, replace=False)]
    rows += [(d, t, 100_000) for t in range(6, 12) for d in range(0, n, 1000)]
    rows += [(d, t, 60_000) for t in range(12, 14) for d in range(100, n, 1500)]
    doc, term, impact = (np.array(x) for x in zip(*rows, strict=True))
    t = R.Treaps(doc, term, impact)
    looked = []
    t.top_in = lambda nodes, low, high, f=t.top_in: (looked.append(len(nodes)), f(nodes, low, high))[1]
    none = np.zeros(0, dtype=np.int64)
    roots = np.array([t.root[k] for k in range(14)])
    score, found = t.search(roots, np.ones(14, dtype=np.int64), n, (none, none), np.arange(n), 20)
    sums = np.bincount(doc, impact, minlength=n).astype(int)
    want = np.lexsort((np.arange(n), -sums))[:20]
    assert found.tolist() == want.tolist() and score.tolist() == sums[want].tolist()
    assert sum(looked) < n / 4
