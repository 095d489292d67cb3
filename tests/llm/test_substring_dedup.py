import hashlib
import re

import numpy as np
import pytest

from corpusloom.llm import substring_dedup as S

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def brute(rows, n=50):
    first = {}
    words = sorted((i, WORD.findall(t or "")) for i, t in rows)
    for i, w in words:
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone.update(range(k, k + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def texts():
    rng = np.random.default_rng(0)
    passages = [[f"p{m}q{k}" for k in range(m)] for m in (49, 50, 51, 90, 200)]
    loop = ["x", "y"] * 60
    out = []
    for i in range(40):
        parts = [[f"d{i}w{k}" for k in range(int(rng.integers(0, 70)))] for _ in range(2)]
        w = parts[0] + passages[i % 5] + parts[1] + (passages[(i + 2) % 5][:60] if i % 3 == 0 else [])
        out.append((i, "  ".join(w)))
    return [*out, (50, " ".join(loop)), (51, " ".join(loop[:70])), (52, out[4][1]), (53, out[4][1].replace("  ", "\n"))]


def result(docs, **o):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in S.digest(docs, S.Options(**o)).collect())


def test_windows_against_brute_force(make_docs):
    docs = make_docs(*texts())
    assert result(docs, batches=3) == brute(texts())


def test_edges(edge_docs, no_docs):
    assert result(edge_docs, batches=2) == brute([(r.doc_id, r.text) for r in edge_docs.collect()])
    assert result(no_docs) == [] and S.dedup_documents(no_docs).count() == 0


def test_documents_keep_their_columns(make_docs):
    docs = make_docs(*texts())
    out = S.dedup_documents(docs, S.Options(batches=2))
    assert out.columns == docs.columns
    want = {i: (n, sha) for i, _, n, sha in brute(texts())}
    before = {r.doc_id: r.text for r in docs.collect()}
    for r in out.collect():
        n, sha = want[r.doc_id]
        assert r.text == before[r.doc_id] if n == 0 else hashlib.sha256(r.text.encode()).hexdigest() == sha
        assert n == 0 or r.n_chars == len(r.text)


def judged(marked, lost):
    rows = marked.join(lost, "doc_id", "left").collect()
    return sorted((r.doc_id, r.n_words, r.n_words if r.copy else r.n_removed or 0, S.EMPTY_SHA if r.copy else r.kept or r.sha) for r in rows)


def days(make_docs):
    rows = texts()
    return [make_docs(*rows[a:b]) for a, b in ((0, 9), (9, 20), (20, 21), (21, 44))]


def test_days_one_after_the_other_equal_all_at_once(spark, make_docs, tmp_path):
    archive, found = make_docs((-1, None)).limit(0), []
    for day in days(make_docs):
        index = S.FingerprintIndex.open(spark, str(tmp_path / "index"))  # as a new session does
        found += judged(*index.dedup(day, archive, text=False))
        archive = archive.union(day)
    assert sorted(found) == brute(texts())
    index = S.FingerprintIndex.open(spark, str(tmp_path / "index"))
    assert index.version == 4 and [level for level, _ in index.prints.state] == [2]
    more = [(100, texts()[0][1]), (101, "new " + texts()[3][1] + " end"), (102, "short")]
    index.compact()
    index = S.FingerprintIndex.open(spark, str(tmp_path / "index"))
    assert judged(*index.dedup(make_docs(*more), archive, text=False)) == [x for x in brute(texts() + more) if x[0] >= 100]
    assert len(list((tmp_path / "index" / "windows").iterdir())) == len(index.windows.state)


def test_a_day_that_failed_is_repeated(spark, make_docs, tmp_path, monkeypatch):
    one, two, *_ = days(make_docs)
    index = S.FingerprintIndex.open(spark, str(tmp_path / "index"), buckets=3)
    first = judged(*index.dedup(one, one.limit(0), text=False))
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(S.FingerprintIndex, "_commit", lambda self: (_ for _ in ()).throw(RuntimeError("lost")))
        S.FingerprintIndex.open(spark, str(tmp_path / "index")).dedup(two, one, text=False)
    index = S.FingerprintIndex.open(spark, str(tmp_path / "index"))
    assert index.version == 1 and index.buckets == 3
    assert sorted(first + judged(*index.dedup(two, one, text=False))) == brute(texts()[:20])
    with pytest.raises(ValueError):
        S.FingerprintIndex.open(spark, str(tmp_path / "index"), options=S.Options(window=30))


def test_runs_are_merged_without_moving_the_history(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "print long, doc_id long")
    runs = S.SortedRuns(spark, str(tmp_path / "runs"), {"print": "bigint"}, "bigint", 3, [])
    with S._bucketed_plans(spark, 3):
        a, b = runs.new_run(rows((1, 10), (2, 10), (2, 11))), runs.new_run(rows((1, 20), (3, 20)))
    assert runs.meet(a).count() == 0 and runs.append(a) == []
    again = S.SortedRuns(spark, str(tmp_path / "runs"), {"print": "bigint"}, "bigint", 3, [(0, a)])
    with S._bucketed_plans(spark, 3):
        met = again.meet(b)
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
        assert [tuple(r) for r in met.collect()] == [(1, 10, 10)]
        gone = again.append(b)
    assert sorted(gone) == sorted([a, b])
    assert {tuple(r) for r in again.read(again.state[0][1]).collect()} == {(1, 10, 20), (2, 10, 11), (3, 20, 20)}


def test_a_passage_in_most_documents(make_docs):
    passage = " ".join(f"z{k}" for k in range(70))
    rows = [(k, f"a{k} b{k} {passage} c{k}") for k in range(150)] + [(200 + k, f"{passage}") for k in range(20)]
    assert result(make_docs(*rows), batches=2) == brute(rows)


def test_clashing_names(make_docs):
    docs = make_docs(*texts()).selectExpr("*", "'mine' as `_substring_kept`", "'mine' as `_s_kept`", "'mine' as copy", "'mine' as prints")
    out = S.dedup_documents(docs, S.Options(batches=1))
    assert out.columns == docs.columns and all(tuple(r)[-4:] == ("mine",) * 4 for r in out.collect())


def test_rows_without_ids(make_docs):
    rows = [(None, texts()[0][1]), (None, None)]
    for more in ([], texts()[:6], texts()[:1]):
        got = [tuple(r) for r in S.digest(make_docs(*rows, *more), S.Options(batches=1)).collect()]
        assert sorted(r for r in got if r[0] is not None) == brute(more) and len(got) == len(more) + 2
        assert all(r[2] == 0 for r in got if r[0] is None)


def test_ids_that_are_text(make_docs):
    docs = make_docs(*texts()).selectExpr("lpad(cast(doc_id as string), 4, '0') as doc_id", "text")
    assert [(int(i), *r) for i, *r in result(docs, batches=2)] == brute(texts())
