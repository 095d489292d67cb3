import numpy as np
import pytest

from corpusloom.operators import centrality
from corpusloom.plans import summarize as programs

TEXT = "Red fox runs far. Red fox. Blue whale swims. Red whale sings. Owl"
SENTS = [s.split() for s in "red fox runs far|red fox|blue whale swims|red whale sings|owl".split("|")]


def ranking(scores):
    names = "Red fox runs far|Red fox|Blue whale swims|Red whale sings|Owl".split("|")
    return " ".join(names[k] for k in sorted(range(len(names)), key=lambda k: (-round(scores[k], 6), -k)))


def common(a, b):
    if len(a) == len(b) == 1:
        return float(a == b)
    return sum(a.count(w) + b.count(w) for w in set(a) & set(b)) / (np.log10(len(a)) + np.log10(len(b)))


def cosine(v):
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    return unit @ unit.T


def summary(spark, vectors=None, **options):
    docs = spark.createDataFrame([(1, TEXT), (2, "Other words here")], "doc_id long, text string")
    rows = programs.summarize(docs, programs.SummaryOptions(size=5, **options), vectors=vectors).collect()
    return next(r.summary for r in rows if r.doc_id == 1)


@pytest.mark.parametrize("method", ["lexrank", "lexrank_undamped"])
def test_each_metric_makes_its_own_ranking(spark, method):
    kind = method.replace("lexrank_", "").replace("lexrank", "damped")
    m = np.array([[common(a, b) for b in SENTS] for a in SENTS])
    assert summary(spark, method=method, similarity="common_words") == ranking(centrality.scores_of(m, kind))
    rng = np.random.default_rng(5)
    words = sorted({w for s in SENTS for w in s})
    table = {w: rng.uniform(0.1, 1, 4) for w in words}
    v = np.array([sum(np.log(2) * table[w] for w in s) for s in SENTS])
    frame = spark.createDataFrame([(w, x.tolist()) for w, x in table.items()], "term string, embedding array<double>")
    assert summary(spark, frame, method=method, similarity="word2vec_sim") == ranking(centrality.scores_of(cosine(v), kind))
    e = rng.uniform(0.1, 1, (5, 4))
    frame = spark.createDataFrame([(1, k, x.tolist()) for k, x in enumerate(e)], "doc_id long, sent_ix int, embedding array<double>")
    assert summary(spark, frame, method=method, similarity="bert_sim") == ranking(centrality.scores_of(cosine(e), kind))


def test_undamped_scores_honour_the_threshold(spark):
    plain, cut = (summary(spark, method="lexrank_undamped", threshold=t) for t in (None, 0.5))
    w = sorted({w for s in SENTS for w in s})
    m = cosine(np.array([[s.count(x) for x in w] for s in SENTS], float))
    assert cut == ranking(centrality.scores_of(m, "undamped", threshold=0.5)) != plain


def test_vectors_and_threshold_are_checked(spark):
    with pytest.raises(ValueError):
        summary(spark, similarity="bert_sim")
    with pytest.raises(ValueError):
        summary(spark, threshold=1.0)
