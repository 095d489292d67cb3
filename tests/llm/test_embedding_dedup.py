import numpy as np
import pytest

from corpusloom.llm import embedding_dedup as E


def brute(ids, x, cosine=0.9):
    fine = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for v in x]
    unit = {k: np.array(x[k], float) / np.linalg.norm(x[k]) for k in range(len(x)) if fine[k]}
    n, label = [0] * len(x), list(ids)
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine]
    for a, b in links:
        n[a] += 1
        n[b] += 1
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return sorted(zip(ids, n, label))


def frame(spark, ids, x):
    return spark.createDataFrame([(i, v, 1, "r") for i, v in zip(ids, x)], "vec_id long, embedding array<float>, label int, rep string")


def test_links_against_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(200, 32))
    near = base[:40] + rng.normal(size=(40, 32)) * 0.08
    hub = base[0] + rng.normal(size=(30, 32)) * 0.05
    x = np.concatenate([base, near, hub, base[:3]]).astype(np.float32).astype(float).tolist()
    x += [None, [0.0] * 32, [float("nan")] + [1.0] * 31, [None] + [1.0] * 31, [], [1.0, 2.0], [float("inf")] + [1.0] * 31]
    ids = list(range(500, 500 + len(x)))
    want = brute(ids, x)
    for block in (512, 4):
        got = sorted((r.vec_id, r.n_links, r.component_id) for r in E.link(frame(spark, ids, x), E.Options(block=block), 3).collect())
        assert sum(r[1] for r in got) >= 0.95 * sum(r[1] for r in want)
        assert all(g[1] <= w[1] for g, w in zip(got, want))
        assert np.mean([g == w for g, w in zip(got, want)]) > 0.95


def test_empty_and_useless_tables(spark):
    assert E.link(frame(spark, [], [])).count() == 0
    rows = E.link(frame(spark, [1, 2], [None, [0.0, 0.0]])).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in rows) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_codes_are_balanced_and_near_vectors_agree():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1000, 64))
    rotations = E.learn_rotations(x, E.Options(rotations=2))
    codes = E.codes_of(x, rotations)
    ones = np.unpackbits(codes.view(np.uint8).reshape(len(x), -1), axis=1).mean(0)
    assert (abs(ones - 0.5) < 0.15).all()
    y = E.codes_of(x + rng.normal(size=x.shape) * 0.05, rotations)
    assert np.bitwise_count(codes ^ y).sum(1).mean() < 10


@pytest.mark.parametrize("length", (20, 24))
def test_recall_at_the_threshold_with_the_substrings_of_large_tables(spark, length):
    rng = np.random.default_rng(2)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    a = unit(rng.normal(size=(600, 64)))
    side = rng.normal(size=a.shape)
    side = unit(side - (side * a).sum(1, keepdims=True) * a)
    c = rng.uniform(0.9005, 0.93, size=(600, 1))
    x = np.concatenate([a, c * a + np.sqrt(1 - c * c) * side]).astype(np.float32).astype(float).tolist()
    rows = E.link(frame(spark, list(range(1200)), x), E.Options(length=length), 3).collect()
    assert sum(r.n_links for r in rows) >= 0.98 * 1200


def test_tables_follow_the_substring_length():
    p = np.arccos(0.9) / np.pi
    for length in (8, 13, 17, 20, 24, 28):
        assert 1 - (1 - (1 - p) ** length) ** E.tables_needed(length, 0.9, 0.99) >= 0.99


def test_each_dimension_links_its_own(spark):
    rng = np.random.default_rng(6)
    x = []
    for d, n in ((32, 60), (2, 9), (24, 20), (1, 3)):
        base = rng.normal(size=(n, d))
        x += np.concatenate([base, base[: n // 2] + rng.normal(size=(n // 2, d)) * 0.05, base[:2]]).astype(np.float32).astype(float).tolist()
    ids = list(range(len(x)))
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in E.link(frame(spark, ids, x), E.Options(), 3).collect())
    assert got == brute(ids, x)


def test_few_vectors_go_through_tables(spark, monkeypatch):
    """Without tables there is no link, at any size."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(20, 16))
    x = np.concatenate([x, x * 1.5 + 0.01]).tolist()
    ids = list(range(40))
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in E.link(frame(spark, ids, x), E.Options(), 2).collect())
    assert got == brute(ids, np.array(x, dtype=np.float32).astype(float).tolist()) and sum(g[1] for g in got) >= 40
    monkeypatch.setattr(E, "substrings", lambda codes, bits, length: np.arange(len(codes) * 2).reshape(-1, 2))
    assert sum(r.n_links for r in E.link(frame(spark, ids, x), E.Options(), 2).coalesce(1).collect()) < 40


def test_turned_copies_are_found(spark):
    rng = np.random.default_rng(11)
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(rng.normal(size=(150, 64)).astype(np.float32).tolist())], "vec_id long, embedding array<float>")
    d = E.turned_copies(rows)
    found = {r.vec_id: r.n_links for r in E.link(d, E.Options(recall=1 - 1e-6), 2).collect()}
    vectors = {r.vec_id: np.array(r.embedding) for r in d.collect()}
    ids = sorted(vectors)
    m = np.stack([vectors[i] / np.linalg.norm(vectors[i]) for i in ids])
    want = (m @ m.T >= 0.9).sum(1) - 1
    assert len(ids) == 750 and [found[i] for i in ids] == want.tolist() and want.min() >= 3


def test_a_dense_hub_is_counted_once(spark):
    rng = np.random.default_rng(12)
    hub = rng.normal(size=64) + rng.normal(size=(700, 64)) * 0.12
    x = np.concatenate([rng.normal(size=(600, 64)), hub]).astype(np.float32).astype(float)
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.link(frame(spark, list(range(1300)), x.tolist()), E.Options(), 4).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(1) - 1
    assert all(got[k][0] <= want[k] for k in got) and sum(g for g, _ in got.values()) >= 0.999 * want.sum() and want.sum() > 400_000
    assert {c for k, (_, c) in got.items() if k >= 600} == {600}


def test_few_candidates_leave_their_bucket_as_pairs(spark, monkeypatch):
    rng = np.random.default_rng(13)
    base = rng.normal(size=(150, 64))
    x = np.concatenate([base, base[:60] + rng.normal(size=(60, 64)) * 0.1, base[0] + rng.normal(size=(40, 64)) * 0.1]).astype(np.float32).astype(float).tolist()
    d = frame(spark, list(range(250)), x)
    got = lambda **o: sorted((r.vec_id, r.n_links, r.component_id) for r in E.link(d, E.Options(recall=1 - 1e-6, **o), 2).collect())
    want = brute(list(range(250)), x)
    assert got(dense=0) == want and got(dense=3) == want and got(dense=3, block=8) == want
    monkeypatch.setattr(E, "_cells", None)  # vectors are sent to dense buckets alone
    assert got(dense=1_000) == want
