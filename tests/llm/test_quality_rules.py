import math
import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    runs = {}
    for k in range(len(w) - 4):
        runs.setdefault(tuple(w[k : k + 5]), []).append(k)
    hit = {k + j for at in runs.values() if len(at) > 1 for k in at for j in range(5)}
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed


def rows_of(frame):
    return [(r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in frame.collect()]


def test_counts_against_brute_force(spark, make_docs, edge_docs):
    texts = ["a b c d e a b c d e x", "a a a a a a a", "l1\nl1\n\n \nl2\nl1", "é😀 <b>#|&</b>", "a b c d e f\ta b c d e f g"]
    docs = make_docs(*enumerate(texts, 100)).union(edge_docs)
    want = sorted((r.doc_id, brute(r.text)) for r in docs.collect())
    assert sorted(rows_of(Q.score(docs))) == want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t#.A", max_size=60), min_size=1, max_size=30))
def test_counts_of_random_texts(spark, make_docs, texts):
    docs = make_docs(*enumerate(texts))
    assert sorted(rows_of(Q.score(docs, Q.Options()))) == sorted((k, brute(t)) for k, t in enumerate(texts))


def test_far_histograms_are_rejected(make_docs):
    words = "the cat of the house and a dog in town is to that was for with it".split()
    good = [" ".join(words[(k + j) % 17] + ("" if j % 4 else f"{k}x{j}") for j in range(60)) for k in range(40)]
    bad = " ".join(f"QX{k}!!#|" for k in range(60))
    docs = make_docs(*enumerate(good), (99, bad))
    kept = {r.doc_id: (r.base_failed, r.kept) for r in Q.score(docs).collect()}
    assert kept[99] == (False, False)
    ids = {r.doc_id for r in Q.keep(docs).collect()}
    assert ids == {i for i, (_, k) in kept.items() if k} and 99 not in ids and Q.keep(docs).columns == docs.columns


def test_empty_table(no_docs):
    assert Q.score(no_docs).count() == 0 and Q.keep(no_docs).count() == 0


def text_of(k, n=60):
    words = "the cat of the house and a dog in town is to that was for with it".split()
    return " ".join(words[(k + j) % 17] + ("" if j % 4 else f"{k}x{j}") for j in range(n))


def test_distances_against_brute_force(make_docs):
    docs = make_docs(*enumerate([text_of(k) for k in range(5)] + ["The END, 12 #", "zz " * 30, text_of(9, 3000)]))
    vocab = Q.vocabulary()

    def histograms(t):
        classes = [r"[^\W\d_]", r"[ \t-\r]"]
        upper, digit = len(re.findall("[A-Z]", t)), len(re.findall("[0-9]", t))
        stop, bang, symbol = (len(re.findall(p, t)) for p in (r"[.,;:?'\"()\-]", "!", r"[#*$%&|<>]"))
        lower, white = len(re.findall("[a-z]", t)), len(re.findall(classes[1], t))
        words = WORD.findall(t)
        hits = [sum(w in (v, v.capitalize()) for w in words) for v in vocab]
        return [lower, white, upper, digit, stop, bang, symbol, len(t) - lower - white - upper - digit - stop - bang - symbol], [*hits, len(words) - sum(hits)]

    def distance(p, q):
        p, q = ([x / max(sum(v), 1) for x in v] for v in (p, q))
        term = lambda a, b: a * math.log2(2 * a / (a + b)) if a else 0.0
        return math.sqrt(max(sum(term(a, b) + term(b, a) for a, b in zip(p, q)) / 2, 0))

    rows = {r.doc_id: (r.text, histograms(r.text)) for r in docs.collect()}
    fine = [h for t, h in rows.values() if not brute(t)[-1]]
    refs = [[sum(h[k][j] * min(sum(h[k]), bound) / sum(h[k]) for h in fine) for j in range(len(fine[0][k]))] for k, bound in ((0, 2000), (1, 400))]
    for r in Q.score(docs).collect():
        chars, common = rows[r.doc_id][1]
        assert math.isclose(r.char_distance, distance(chars, refs[0]), abs_tol=1e-9) and math.isclose(r.word_distance, distance(common, refs[1]), abs_tol=1e-9)


def test_references_can_be_kept(spark, make_docs, tmp_path):
    good = make_docs(*enumerate(text_of(k) for k in range(30)))
    junk = make_docs(*[(100 + k, " ".join(f"QX{k}!!#|{j}" for j in range(300))) for k in range(60)])
    Q.save_references(Q.references(Q.counted(good)), str(tmp_path / "refs"))
    refs = Q.load_references(spark, str(tmp_path / "refs"))
    alone = {r.doc_id: r.kept for r in Q.score(good, refs=refs).collect()}
    both = {r.doc_id: r.kept for r in Q.score(good.union(junk), refs=refs).collect()}
    assert all(both[i] == k for i, k in alone.items()) and not any(k for i, k in both.items() if i >= 100)
    assert {r.doc_id for r in Q.keep(good.union(junk), refs=refs).collect()} == {i for i, k in both.items() if k}


def test_one_huge_document_does_not_move_a_reference(make_docs):
    good = [(k, text_of(k)) for k in range(60)]
    huge = (99, " ".join(f"QX{j}!!#|" for j in range(40_000)))
    assert {r.doc_id for r in Q.score(make_docs(*good, huge)).filter("kept").collect()} == set(range(60))


def test_a_language_without_reference_is_judged_by_characters(spark, make_docs):
    greek = " ".join(f"{a}{b}" for a in "και του της από στην για που θα δεν είναι".split() for b in ("", "ς", "ν", "ων", "μα"))
    junk = " ".join(f"QX{j}!!#|" for j in range(60))
    letters = str.maketrans("0123456789", "abcdefghij")
    docs = make_docs(*[(k, text_of(k).translate(letters)) for k in range(30)], (50, greek), (51, junk)).withColumn("lang", F.when(F.col("doc_id") >= 50, "el").otherwise("en"))
    found = {r.doc_id: r.kept for r in Q.score(docs).collect()}
    assert found[50] and not found[51]
    assert Q.score(docs.drop("lang")).count() == 32


def test_clashing_names(make_docs):
    docs = make_docs(*[(k, text_of(k)) for k in range(12)]).withColumns({c: F.lit("mine") for c in ("_q_text", "_q_words", "_Q_kept", "_q_lang", "__q_row")})
    kept = Q.keep(docs)
    assert kept.columns == docs.columns and {tuple(r)[-5:] for r in kept.collect()} == {("mine",) * 5} and Q.score(docs).count() == 12
