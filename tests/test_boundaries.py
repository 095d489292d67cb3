import math
import random
from collections import Counter

from pyspark.sql import functions as F

from corpusloom.operators import boundaries as B


def corpus(seed=1, n=300):
    """Sentences of lower-case words; `cf.` and `u.s.` stand inside them, `We` begins many, `5.` is an ordinal before `may`."""
    r = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bdgkm" for b in "aeiou" for c in "lnrst"]
    texts = []
    for _ in range(n):
        sents = []
        for _ in range(r.randint(1, 5)):
            w = [r.choice(words) for _ in range(r.randint(4, 9))]
            if r.random() < 0.5:
                w.insert(r.randint(1, len(w) - 1), r.choice(["cf.", "u.s.", "J."]))
            if r.random() < 0.2:
                w[1:1] = ["5.", "may"]
            w[0] = "We" if r.random() < 0.4 else w[0].capitalize()
            sents.append(" ".join(w) + r.choice("...!?"))
        texts.append(sents)
    return texts


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id int, text string, word int")


def test_learns_and_splits_planted_abbreviations(spark, tmp_path):
    known = corpus()
    model = B.learn(frame(spark, [" ".join(s) for s in known]))
    assert {"cf", "u.s"} <= set(model.abbreviations) and len(model.abbreviations) <= 4
    assert "we" in model.starters and "## may" in model.collocations
    B.save(model, spark, str(tmp_path / "m"))
    assert B.load(spark, str(tmp_path / "m")) == model
    fresh = corpus(2, 80)
    got = [r.sentences for r in B.split(frame(spark, ["\n ".join(s) for s in fresh]), model).orderBy("doc_id").collect()]
    assert got == fresh


def test_counts_and_scores_against_a_plain_count(spark):
    texts = [" ".join(s) for s in corpus(3, 40)] + [None, "", "  "]
    words = {r.word: (r.n, r.stops) for r in B.word_counts(B.token_pairs(frame(spark, texts))).collect()}
    n, stops = Counter(), Counter()
    for t in " ".join(x or "" for x in texts).split():
        bare = t.rstrip(".!?").lower()
        bare = "##" if bare.isdigit() else bare
        n[bare] += 1
        stops[bare] += t.endswith(".")
    assert words == {w: (n[w], stops[w]) for w in n}
    scores = {r.word: r.score for r in B.abbreviation_scores(B.word_counts(B.token_pairs(frame(spark, texts)))).collect()}
    p = sum(stops.values()) / sum(n.values())
    for w in ("cf", "u.s"):
        k, rest, size = stops[w], n[w] - stops[w], len(w.replace(".", ""))
        raw = -2 * (k * math.log(p) + rest * math.log(1 - p) - k * math.log(0.99) - rest * math.log(0.01))
        assert math.isclose(scores[w], raw * math.exp(-size) * (w.count(".") + 1) * size**-rest, rel_tol=1e-9)


def test_empty_model_and_edges(spark):
    model = B.learn(frame(spark, []))
    assert model == B.Model()
    texts = ["One. Two! Three", None, "", " \n", "(He said.) Then... more... Yes 3. may", "No end"]
    got = [r.sentences for r in B.split(frame(spark, texts), model).orderBy("doc_id").collect()]
    assert got == [["One.", "Two!", "Three"], None, [], [], ["(He said.)", "Then... more...", "Yes 3. may"], ["No end"]]
    assert B.split(frame(spark, texts), model).columns == ["doc_id", "text", "word", "sentences"]
