import hashlib
import random
import re
import string

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import secret_scan as S
from corpusloom.llm.arrays import running

PATTERNS = {
    "assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}
LEAST = {"assign": 12, "access": 18, "hex": 16}
RUN = re.compile(r"[A-Za-z0-9+/_-]{10,}={0,2}")


def brute_base(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text or ""):
            value = m[2] if kind == "assign" else m[0]
            if len(value) >= LEAST[kind]:
                out.append((m.start(), k, m.end(), value))
    return sorted(out)


def brute(texts, ratios=None):
    base = [brute_base(t) for t in texts]
    runs = [[(m.start(), m.end(), m[0]) for m in RUN.finditer(t or "") if not any(s <= m.start() and m.end() <= e for s, _, e, _ in b)] for t, b in zip(texts, base, strict=True)]
    out = []
    for b, r in zip(base, runs, strict=True):
        more = [(s, 3, e, t) for s, e, t in r if ratios and len(t) >= 16 and score(t, ratios) >= 10_000]
        out.append(sorted(b + more))
    return out


def score(token, ratios):
    numbers = [0] + [S.CHARACTERS.find(c) + 1 for c in token.lower()]
    return sum(ratios[a * S.STATES + b] for a, b in zip(numbers, numbers[1:]))


def rows_of(frame):
    return {r.doc_id: [tuple(x) for x in r.spans] for r in frame.collect()}


def noise(seed, n):
    r = random.Random(seed)
    parts = ["password", "TOKEN", "api_key", "apikey", "Secret", ":", "=", " ", '"', "'", "AKIA", "0123456789abcdef", "deadbeef", "ABCDEFGH12", "é", "😀", "\n", "word", "internationalisation", ".", "-"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(n)]
    return texts + ["secret=token: abcdefghijklmnop", "token==abcdefghijkl", 'api_key" : \'0123456789abcdefXYZ', "AKIAAKIA" + "B" * 20, "x" * 30 + "AKIA"]


def test_spans_against_brute_force(make_docs, edge_docs):
    docs = make_docs(*enumerate(noise(1, 150), 100)).union(edge_docs.filter("doc_id <> 5"))
    ids, texts = zip(*[(r.doc_id, r.text) for r in docs.collect()])
    ratios = S.train(S.samples(docs))
    assert any(ratios)
    want = dict(zip(ids, brute(texts, ratios), strict=True))
    assert rows_of(S.scan(docs)) == want == rows_of(S.scan(docs, ratios=ratios))
    assert any(kind < 3 for x in want.values() for _, kind, _, _ in x)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="tokenTOKEN:= \"'0aAé😀KI+", max_size=80), min_size=1, max_size=30))
def test_base_spans_of_random_texts(make_docs, texts):
    want = {k: [x for x in v] for k, v in enumerate(brute(texts))}
    assert rows_of(S.scan(make_docs(*enumerate(texts)), ratios=[0] * S.STATES**2)) == want


def test_random_strings_are_found_and_identifiers_left(make_docs):
    r = random.Random(7)
    syllables = ["in", "ter", "na", "tion", "al", "con", "fig", "ur", "a", "ble", "ser", "vice", "man", "ag", "er", "get", "User"]
    names = ["".join(r.choice(syllables) for _ in range(7)) for _ in range(600)]
    found = ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    docs = [(k, f"call {n}() at once") for k, n in enumerate(names)] + [(1000 + k, f"token = {t}") for k, t in enumerate(found)]
    ratios = S.train(S.samples(make_docs(*docs)))
    fresh = ["".join(r.choice(string.ascii_letters + string.digits) for _ in range(24)) for _ in range(50)]
    more = ["".join(r.choice(syllables) for _ in range(7)) for _ in range(200)]
    new = make_docs(*[(k, f"see {t} there") for k, t in enumerate(fresh)], *[(100 + k, f"see {n} there") for k, n in enumerate(more)])
    spans = rows_of(S.scan(new, ratios=ratios))
    assert sum(spans[k] == [(4, 3, 28, fresh[k])] for k in range(50)) >= 49
    assert sum(bool(spans[100 + k]) for k in range(200)) <= 1


def test_long_text_of_many_matches(make_docs):
    text = " ".join(f"token: {k:016x}" for k in range(6_000))
    (spans,) = rows_of(S.scan(make_docs((1, text)))).values()
    assert spans == brute([text])[0] and len(spans) == 12_000


def test_no_samples_no_rows(make_docs, no_docs):
    assert S.scan(no_docs).count() == 0
    assert rows_of(S.scan(make_docs((1, "a b c"), (2, None)))) == {1: [], 2: []}


def test_running_folds(spark):
    arrays = [[], [3], list(range(1, 40)), [5, 1, 9, 2] * 100]
    d = spark.createDataFrame([(a,) for a in arrays], "a array<long>")
    zero = F.lit(0).cast("long")
    d = d.select("a", running("a", lambda x: x, lambda s, x: s + x, zero).alias("s"), running("a", lambda x: x, lambda s, x: F.greatest(s, x), zero).alias("m"))
    for r in d.collect():
        assert r.s == [sum(r.a[:k]) for k in range(len(r.a))] and r.m == [max(r.a[:k], default=0) for k in range(len(r.a))]


def test_written_form(spark, tmp_path, make_docs):
    text = "x AKIA" + "A1" * 10 + " and 0123456789abcdef0"
    make_docs((1, text), (2, None)).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in S.query(spark, str(tmp_path)).collect()}
    assert (rows[1].n_assign, rows[1].n_access, rows[1].n_hex) == (0, 1, 1)
    assert rows[1].base_sha256 == hashlib.sha256(b"access:2:26,hex:31:48").hexdigest() and rows[1].spans == "access:2:26,hex:31:48"
    assert rows[2].spans == "" and rows[2].base_sha256 == hashlib.sha256(b"").hexdigest()
