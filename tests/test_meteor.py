from itertools import product

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from corpusloom.operators import meteor
from corpusloom.operators.stem import stem_token
from corpusloom.plans import more_queries, queries


def plain(hyp, ref, stemmed):
    """Pairs by two loops from the end, chunks by a walk."""
    links = {}
    for form in (str, stem_token)[: 1 + stemmed]:
        for i in reversed(range(len(hyp))):
            for j in reversed(range(len(ref))):
                if i not in links and j not in links.values() and form(hyp[i]) == form(ref[j]):
                    links[i] = j
    return len(links), sum(links.get(i - 1, -9) + 1 != j for i, j in links.items())


def test_alignment_against_two_loops(spark):
    rng = np.random.default_rng(5)
    words = ["run", "running", "runs", "cat", "cats", "tree", "a"]
    rows = [(k, 0, *(list(map(str, rng.choice(words, rng.integers(0, 15)))) for _ in range(2))) for k in range(200)]
    rows += [(200, 0, None, ["a"]), (201, 0, ["a"], None), (202, 0, None, None)]
    pairs = spark.createDataFrame(rows, "pair_id long, ref_id long, hyp array<string>, ref array<string>")
    for stemmed in (False, True):
        got = {r.pair_id: r for r in meteor.meteor(pairs, meteor.Options(stemmed=stemmed)).collect()}
        for k, _, h, r in rows:
            h, r = h or [], r or []
            m, c = plain(h, r, stemmed)
            assert (got[k].matches, got[k].chunks) == (m, c)
            p, q = m / len(h) if h else 0, m / len(r) if r else 0
            want = p * q / (0.9 * p + 0.1 * q) * (1 - 0.5 * (c / m) ** 3) if m else 0
            assert np.isclose(got[k].score, want) and np.isclose(got[k].p, p) and np.isclose(got[k].r, q)


def test_pairs_are_as_many_as_can_be_and_equal_words_do_not_cross():
    for hyp, ref in product(product("ab", repeat=4), product("ab", repeat=3)):
        matches, chunks = (int(x[0]) for x in meteor.align([(pa.array([list(hyp)]), pa.array([list(ref)]))]))
        assert matches == sum(min(hyp.count(w), ref.count(w)) for w in "ab") and 0 < chunks <= matches or not matches
    same = pa.array([["x"] * 50 + ["y"]])
    assert [int(x[0]) for x in meteor.align([(same, same)])] == [51, 1]


def test_alpha_and_best(spark):
    pairs = spark.createDataFrame([(1, 0, ["a", "b"], ["a", "b", "c", "d"]), (1, 1, ["a", "b"], ["a", "b"]), (1, 2, ["a", "b"], ["a", "b"])], "pair_id long, ref_id long, hyp array<string>, ref array<string>")
    for alpha, want in ((1.0, 0.5), (0.0, 1.0)):
        first = meteor.meteor(pairs, meteor.Options(alpha=alpha, gamma=0.0)).filter("ref_id = 0").first()
        assert first.score == pytest.approx(want)
    assert [tuple(r)[:2] for r in meteor.best(meteor.meteor(pairs)).collect()] == [(1, 1)]
    assert meteor.meteor(pairs.limit(0)).count() == 0


def test_whole_documents(spark, tmp_path):
    texts = ["One cat. Two cats. Three. Four cats and a cat.", "", "...", None, "x " * 3000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert more_queries.meteor_exact
    got = queries.QUERIES["meteor_exact"](spark, str(tmp_path)).toPandas().sort_values(["pair_id", "ref_id"])
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.sql(queries.SQL["meteor_exact"]).df()[list(got.columns)].sort_values(["pair_id", "ref_id"])
    assert len(got) and np.allclose(got.to_numpy(dtype=float), want.to_numpy(dtype=float))
    assert queries.QUERIES["meteor_stemmed"](spark, str(tmp_path)).filter("pair_id = 0").agg({"matches": "max"}).first()[0] >= got.matches[got.pair_id == 0].max()
