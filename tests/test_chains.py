"""Chains on edge tables against the published distributions of small matrices, dense algebra and brute force."""

import random

import numpy as np
import pytest

from corpusloom.operators import centrality, chains as C


def matrices():
    out = [np.array([[1.0]]), np.array([[0.6, 0.1, 0.3], [0.1, 0.7, 0.2], [0.2, 0.2, 0.6]])]
    m = np.zeros([5, 5])
    m[np.ix_([0, 3], [2, 4])], m[np.ix_([2], [0, 1, 3, 4])] = 0.5, 0.25
    m[1, 2], m[4, 4] = 1, 1
    out.append(m)
    out.append(np.array([[0, 1, 0, 0], [0, 1 / 3, 2 / 3, 0], [0, 0, 0, 1], [3 / 5, 0, 0, 2 / 5]]))
    m = np.zeros([7, 7])
    for i, j, w in [(0, 0, 5), (0, 1, 5), (1, 0, 5), (1, 1, 4), (1, 2, 1), (2, 1, 6), (2, 2, 4), (3, 2, 2), (3, 3, 4), (3, 4, 2), (3, 5, 2), (4, 3, 7), (4, 6, 3), (5, 6, 10), (6, 5, 9.5), (6, 6, 0.5)]:
        m[i, j] = w / 10
    out.append(m)
    out.append(np.array([[0.5, 0, 0.5], [0, 1, 0], [0.5, 0, 0.5]]))
    return out


#: Where the chains above settle.
SETTLED = [[1], [0.2759, 0.3448, 0.3793], [0, 0, 0, 0, 1], [6 / 31, 9 / 31, 6 / 31, 10 / 31], [0.2465, 0.2465, 0.0411, 0, 0, 0.2269, 0.2389], [1 / 3, 1 / 3, 1 / 3]]


def edges(spark, *blocks):
    rows, at = [], 0
    for m in blocks:
        rows += [(int(at + i), int(at + j), float(m[i, j])) for i, j in zip(*np.nonzero(m))]
        at += len(m)
    return spark.createDataFrame(rows, "i int, j int, w double")


def shares(frame):
    return np.array([r.share for r in frame.orderBy("node").collect()])


@pytest.mark.parametrize("squares", [False, True], ids=["steps", "squares"])
def test_small_chains_as_one_table(spark, squares):
    # plain steps take long on the chain of seven states, which leaks slowly
    chosen = [k for k in range(6) if squares or k != 4]
    got = shares(C.stationary(edges(spark, *[matrices()[k] for k in chosen]), C.Options(squares=squares)))
    sizes = [len(SETTLED[k]) for k in chosen]
    want = np.concatenate([np.array(SETTLED[k]) * len(SETTLED[k]) for k in chosen]) / sum(sizes)
    assert np.allclose(got, want, atol=1e-4 * 7 / sum(sizes)) and abs(got.sum() - 1) < 1e-9


def test_repetitions_settle_alike(spark):
    ms = matrices()
    got = shares(C.stationary(edges(spark, *ms * 2), C.Options(squares=True), normalized=False)).reshape(2, -1)
    assert np.allclose(got, got[0], rtol=0, atol=1e-12) and abs(got.sum() - 2 * sum(map(len, ms))) < 1e-6


def test_random_chain_and_lost_shares(spark):
    m = np.random.default_rng(2).random([40, 40]) ** 6
    p = m / m.sum(1, keepdims=True)
    value, vector = np.linalg.eig(p.T)
    want = np.real(vector[:, np.argmax(np.real(value))])
    assert np.allclose(shares(C.stationary(edges(spark, m), C.Options(rtol=1e-10))), want / want.sum(), atol=1e-8)
    m[7] = 0
    assert shares(C.stationary(edges(spark, m), C.Options(lost="leave", steps=40))).sum() < 0.9
    assert shares(C.stationary(edges(spark, m), C.Options(lost="stay", steps=40)))[7] > 0.3


@pytest.mark.parametrize("biased", [False, True])
def test_damped_against_algebra(spark, biased):
    m = (np.random.default_rng(3).random([25, 25]) < 0.15).astype(float)
    m[4], m[11], m[:, 24], m[24] = 0, 0, 0, 0
    jump = np.random.default_rng(4).random(25) if biased else np.ones(25)
    jump /= jump.sum()
    total = m.sum(1)
    p = np.where(total[:, None] > 0, m / np.where(total == 0, 1, total)[:, None], jump)
    want = np.linalg.solve(np.eye(25) - 0.85 * p.T, 0.15 * jump)
    nodes = spark.createDataFrame([(i,) for i in range(25)] + [(None,)], "node int")
    bias = spark.createDataFrame([(i, float(x)) for i, x in enumerate(jump)] + [(99, 5.0)], "node int, share double") if biased else None
    got = shares(C.stationary(edges(spark, m), C.Options(damping=0.85, lost="jump", rtol=1e-9), nodes, bias))
    assert np.allclose(got, want / want.sum(), atol=1e-7)


def test_many_nodes_go_as_few_do(spark, monkeypatch):
    m = np.random.default_rng(5).random([12, 12]) ** 4
    m[3] = 0
    run = lambda: shares(C.stationary(edges(spark, m), C.Options(damping=0.85, lost="jump", steps=3, rtol=0.0, atol=0.0)))
    few = run()
    monkeypatch.setattr(C, "BROADCAST_NODES", 0)
    assert np.allclose(few, run(), rtol=0, atol=1e-12)


def test_edges_that_are_none(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (1, 2, 1.0), (2, 1, 3.0), (None, 1, 1.0), (1, None, 1.0), (1, 3, 0.0), (1, 3, None), (3, 1, -1.0), (2, 2, 1.0)], "i int, j int, w double")
    assert np.allclose(shares(C.stationary(e, C.Options(rtol=1e-9))), [3 / 7, 4 / 7], atol=1e-6)
    assert C.stationary(e.limit(0)).count() == 0 and C.components(e.limit(0)).count() == 0
    with pytest.raises(ValueError):
        C.Options(lost="jump")


def brute_components(pairs):
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("shape", ["path", "star", "random", "ring of cliques"])
def test_components(spark, shape):
    r = random.Random(shape)
    pairs = {
        "path": [(k, k + 1) for k in range(24)],
        "star": [(500, k) for k in range(30)] + [(500, 500), (900, 900)],
        "random": [(r.randint(0, 60), r.randint(0, 60)) for _ in range(36)],
        "ring of cliques": [(a + 10 * c, b + 10 * c) for c in range(5) for a in range(5) for b in range(a)] + [(10 * c, 10 * ((c + 1) % 5) + 1) for c in range(5)],
    }[shape]
    got = C.components(spark.createDataFrame([*pairs, (None, 1)], "i int, j int"))
    assert {r.node: r.component for r in got.collect()} == brute_components(pairs)


def test_sparse_scores_equal_dense_ones():
    r = np.random.default_rng(8)
    x = np.where(r.random([40, 30]) < 0.2, r.random([40, 30]), 0.0)
    x[[3, 17]] = 0
    x /= np.where(np.linalg.norm(x, axis=1) == 0, 1, np.linalg.norm(x, axis=1))[:, None]
    m = x @ x.T
    np.fill_diagonal(m, 1.0)
    row, term = np.nonzero(x)
    bias = r.random(40)
    for method in ("damped", "undamped"):
        for threshold in (None, 0.0, 0.2, 0.999):
            for b in (None, bias):
                want = centrality.scores_of(m, method, b, threshold=threshold)
                got = centrality.sparse_scores(row, term, x[row, term], 40, method, b, threshold=threshold)
                assert np.allclose(got, want, atol=1e-12), (method, threshold)


def test_a_document_of_fifty_thousand_sentences_needs_no_matrix():
    import tracemalloc

    r = np.random.default_rng(9)
    row, term = np.repeat(np.arange(50_000), 12), r.zipf(1.3, 600_000) % 20_000
    x = np.full(len(row), 12**-0.5)
    tracemalloc.start()
    v = centrality.sparse_scores(row, term, x, 50_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert abs(v.sum() - 1) < 1e-9 and peak < 200e6
