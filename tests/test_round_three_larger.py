"""Steps that grew faster than their input: each against a plain form of itself."""

import random

import numpy as np

from corpusloom.operators import centrality, chains, neighbours


def test_neighbours_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 10)
    r = random.Random(3)
    base = ["".join(r.choice("abcdefgh ") for _ in range(r.choice([0, 1, 30, 400]))) for _ in range(9)]
    texts = [(k, r.choice(["a", "a", "b", None]), (lambda t: t[: len(t) // 2] + "x" * r.randint(0, 2) + t[len(t) // 2 :])(r.choice(base))) for k in range(120)]
    texts += [(k, "c", "one text " * 20) for k in range(200, 203)]
    rows = spark.createDataFrame(texts, "k int, category string, text string").repartition(5)
    for skip_last in (False, True):
        want = []
        for c in ("a", "b", "c"):
            t = [x[2] for x in texts if x[1] == c]
            for i in range(len(t)):
                for j in range(i + 1, min(i + 10, len(t) - skip_last)):
                    n = min(len(t[i]), len(t[j]))
                    x, y = (s[round(n * 0.4) : round(n * 0.5)] for s in (t[i], t[j]))
                    if (ratio := neighbours.fuzzy_ratio(x, y)) > 92:
                        want.append((c, i, j, ratio))
        found = neighbours.near_duplicates(rows, "category", "k", skip_last=skip_last)
        assert sorted(tuple(x) for x in found.collect()) == sorted(want) and want


def test_only_pairs_that_cannot_reach_are_dropped():
    r = random.Random(5)
    for _ in range(400):
        n = r.randint(1, 150)
        x = "".join(r.choice("abcd ") for _ in range(n))
        y = list(x)
        for _ in range(r.randint(0, 12)):
            y[r.randrange(n)] = r.choice("abcd ")
        k = r.randint(0, 6)
        y = ("".join(y)[k:] + "b" * k)[:n]
        ratio = neighbours.fuzzy_ratio(x, y)
        assert ratio <= 92 or neighbours.may_reach(x, y, n * 92.5 / 100 - 1e-6)


def test_rest_of_a_graph_is_joined_up_at_once(spark, monkeypatch):
    pairs = [(k, k + 1) for k in range(60) if k % 20] + [(100, 200), (200, 5), (7, 7)]
    e = spark.createDataFrame(pairs, "i int, j int")
    found = []
    for rest in (0, 15, 100_000):
        settled, plain = [], chains.settle
        monkeypatch.setattr(chains, "REST_EDGES", rest)
        monkeypatch.setattr(chains, "settle", lambda df, name: settled.append(name) or plain(df, name))
        found.append({x.node: x.component for x in chains.components(e).collect()})
        monkeypatch.setattr(chains, "settle", plain)
        if rest == 100_000:
            assert settled.count("moves") == 1  # one round, where a path took several
    assert found[0] == found[1] == found[2] and found[0][200] == 1 and found[0][7] == 1 and found[0][60] == 41


def test_documents_settle_together_as_each_alone():
    r = np.random.default_rng(2)
    docs = []
    for n in [1, 2, 5, 30, 0, 12, 3, 80]:
        row = np.repeat(np.arange(n), 4)[: max(4 * n - 3, 0)]
        key = np.unique(row * 1000 + r.integers(0, 3 * n + 1, len(row)))
        row, term = key // 1000, np.unique(key % 1000, return_inverse=True)[1]
        w = r.random(len(row))
        docs.append((row, term, w / np.sqrt(np.bincount(row, w * w, minlength=n))[row], n, r.random(n) * (n != 5)))
    for biased in (False, True):
        for options in ({"steps": 50}, {"steps": 1_000, "tolerance": 1e-12}):
            alone = [centrality.sparse_scores(*d[:4], bias=d[4] if biased else None, **options) for d in docs]
            assert np.allclose(centrality.damped_scores(docs, biased, **options), np.concatenate(alone), rtol=0, atol=1e-11)
