import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import quality_model as M, toxicity as X


def test_additive_model_learns_main_effects_and_a_pair():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.7) | ((x[:, 1] > 0.5) ^ (x[:, 2] > 0.5))).astype(float)
    model = M.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9
    assert any(set(p) == {1, 2} for p in model.pairs)


def test_one_class_or_no_rows():
    assert M.Model().score(np.zeros((2, len(M.FEATURES)), dtype=np.float32)).tolist() == [0.5, 0.5]
    x = np.zeros((5, 3), dtype=np.float32)
    assert (M.fit(x, np.ones(5)).score(x) > 0.5).all()


def labelled(spark, make_docs):
    rng = np.random.default_rng(1)
    vocab = [f"w{k}" for k in range(300)]
    texts, rows = [], []
    for k in range(600):
        words = list(rng.choice(vocab, 40))
        bad, toxic = k % 4 == 0, k % 5 == 0
        if toxic:
            words[3] = "vileword"
        text = " | ".join(w + "###" for w in words) if bad else " ".join(words)
        texts.append((k, text))
        rows.append((k, int(not bad), int(toxic)))
    return make_docs(*texts), spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_rows_are_scored_well(spark, make_docs, edge_docs):
    docs, labels = labelled(spark, make_docs)
    truth = {r.doc_id: r for r in labels.collect()}
    model = M.train(docs, labels)
    scores = {r.doc_id: r.score for r in M.score_documents(docs, model).collect()}
    assert np.mean([(s >= 0.5) == truth[i].quality for i, s in scores.items()]) > 0.98
    toxic = X.train(docs, labels)
    scores = {r.doc_id: r.score for r in X.score_documents(docs, toxic).collect()}
    assert np.mean([(s >= 0.7) == truth[i].toxic for i, s in scores.items()]) > 0.98
    left = X.filter_documents(docs, toxic)
    assert {r.doc_id for r in left.collect()} == {i for i, s in scores.items() if s < 0.7} and left.columns == docs.columns
    for f, m in ((M.score_documents, model), (X.score_documents, toxic)):
        edge = f(edge_docs, m).collect()
        assert len(edge) == 9 and all(0 <= r.score <= 1 for r in edge)
        assert len({r.score for r in edge if r.doc_id in (1, 2)}) == 1 and len({r.score for r in edge if r.doc_id in (4, 5)}) == 1


def test_empty_tables(spark, no_docs, edge_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert M.score_documents(no_docs, M.train(no_docs, labels)).count() == 0
    assert X.score_documents(no_docs, X.train(no_docs, labels)).count() == 0
    assert X.filter_documents(edge_docs, X.train(edge_docs, labels)).count() == 9


def _risk_of(w, bias, p, u, prior, which):
    zp, zu = (np.array([w[x].sum() + bias for x in sets]) for sets in (p, u))
    first = prior * np.log1p(np.exp(-zp)).mean()
    second = np.log1p(np.exp(zu)).mean() - prior * np.log1p(np.exp(zp)).mean()
    return {"sum": first + second, "second": second}[which]


def test_gradient_on_both_sides_of_zero():
    """Above zero the step is the gradient of the whole risk, below it that of the second term, reversed."""
    rng = np.random.default_rng(3)
    p, u = ([np.unique(rng.integers(0, 12, 5)) for _ in range(n)] for n in (7, 30))
    for prior, bias, below in ((0.2, 0.3, False), (0.9, -4.0, False), (0.9, 2.0, True)):
        w = rng.normal(size=12)
        if below:
            w[:] = np.abs(w)
            u = [np.zeros(0, dtype=np.int64)] * 29 + [np.array([0])]
            bias = -0.5
        value, second, over_w, over_bias = X.risk(w, bias, X.Rows(p, 12), X.Rows(u, 12), prior)
        assert (second < 0) == below and np.isclose(second, _risk_of(w, bias, p, u, prior, "second"))
        sign, which = (-1, "second") if below else (1, "sum")
        assert np.isclose(value, _risk_of(w, bias, p, u, prior, "sum") if not below else value)
        for k in range(13):
            d = np.zeros(13)
            d[k] = 1e-6
            slope = (_risk_of(w + d[:12], bias + d[12], p, u, prior, which) - _risk_of(w - d[:12], bias - d[12], p, u, prior, which)) / 2e-6
            assert np.isclose(sign * slope, over_w[k] if k < 12 else over_bias, atol=1e-6)


def _mixture(rng, n, toxic):
    """Texts of 30 features; of six marks toxic texts hold one or two and others rarely one; two common words are commoner in toxic ones."""
    out = []
    for k in range(n):
        bad = toxic if isinstance(toxic, bool) else rng.random() < toxic
        x = set(rng.integers(20, 1000, 30).tolist())
        if bad or rng.random() < 0.03:
            x.update(rng.integers(0, 6, 1 + int(rng.integers(0, 2))).tolist())
        x.update([6, 7] if rng.random() < (0.6 if bad else 0.4) else [])
        out.append((np.array(sorted(x)), bad))
    return out


def _area(scores, truth):
    order = np.argsort(np.argsort(scores))
    k = truth.sum()
    return (order[truth].sum() - k * (k - 1) / 2) / (k * (len(truth) - k))


def test_trained_risk_ranks_better_than_untrained_and_uncorrected():
    rng = np.random.default_rng(5)
    positive = [x for x, _ in _mixture(rng, 400, True)]
    unlabelled = [x for x, _ in _mixture(rng, 3000, 0.1)]
    tested = _mixture(rng, 1500, 0.1)
    truth = np.array([t for _, t in tested])
    options = X.Options(buckets=1024)
    raw = lambda model: np.array([model.weights[x].sum() + model.bias for x, _ in tested])
    trained, plain = X.fit(positive, unlabelled, options), X.fit(positive, unlabelled, options, corrected=False)
    untrained = X.fit(positive, unlabelled, X.Options(buckets=1024, steps=0))
    assert (untrained.weights == 0).all() and (trained.weights < 0).any() and (trained.weights[:6] > 0.5).all()
    assert _area(raw(trained), truth) > max(0.88, _area(raw(plain), truth) + 0.02)
    right = lambda model: ((raw(model) >= np.log(0.7 / 0.3)) == truth).mean()
    assert right(trained) > max(right(untrained), right(plain)) and trained.prior < plain.prior


def test_estimated_prior_of_known_mixtures():
    rng = np.random.default_rng(6)
    for prior in (0.05, 0.2):
        scores = lambda n, share: np.where(rng.random(n) < share, rng.normal(3, 1, n), rng.normal(-1, 1, n))
        assert abs(X.estimated_prior(scores(600, 1.0), scores(6000, prior)) - prior) < 0.03


def test_features_are_words_and_beginnings_of_whole_texts():
    from corpusloom.llm.kernels import slices

    def sets(*texts):
        return [set(b[d == k].tolist()) for part in slices(pa.array(texts), lower=True) for d, b in [X.slice_features(part, X.Options())] for k in range(part.count)]

    one, two, three, none = sets("Moron!", "a (moron), b", "morons", None)
    assert len(one) == 2 and one <= two and none == set()  # the word and its beginning of four letters
    assert len(one & three) == 1 and len(three) == 3


def test_little_to_learn_from_is_told():
    with pytest.warns(UserWarning, match="no text will score"):
        model = X.fit([np.array([1])], [np.array([2])], X.Options(buckets=8))
    assert model.score(pa.array(["x y z"]))[0] < 0.01


def test_rows_without_an_id_are_scored(spark, make_docs):
    docs, labels = labelled(spark, make_docs)
    more = docs.unionByName(make_docs((None, "vileword w1"), (None, None)))
    found = {(r.doc_id, r.score > 0.5) for r in X.score_documents(more, X.train(more, labels.unionByName(spark.createDataFrame([(None, 1, 1)], labels.schema)))).collect() if r.doc_id is None}
    assert found == {(None, True), (None, False)}
