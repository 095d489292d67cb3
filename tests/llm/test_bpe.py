import hashlib
import time

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_library(text):
    assert bpe.Encoder.load(PATH).encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_compatible_pairs_are_those_that_merging_keeps():
    v = bpe.Encoder.load(PATH).vocabulary
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, len(v.ids), (2, 3000))
    a[:200] = b[:200]
    got = v.compatible(a, b)
    want = [v.merge_exactly(v.bytes[x] + v.bytes[y]) == [x, y] for x, y in zip(a, b)]
    assert got.tolist() == want


def test_proposals_that_fail_are_merged_exactly():
    v = bpe.Encoder.load(PATH).vocabulary
    words = [bytes(w) for w in np.random.default_rng(1).choice(list(b"abehinorst"), (500, 12)).tolist()]
    assert v.encode_words(words) == [v.merge_exactly(w) for w in words]


def test_cache_is_emptied_without_harm(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 20)
    e = bpe.Encoder(PATH)
    texts = [f"word{k} and others {k}" for k in range(50)]
    for k in range(0, 50, 5):
        assert e.decode_batch(*e.encode_batch(texts[k : k + 5])) == texts[k : k + 5]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, LIBRARY.get_vocab_size() - 1), max_size=40))
def test_any_ids_decode_as_the_library_does(ids):
    assert bpe.Encoder.load(PATH).decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_rows_of_ids_decode_each_for_itself(spark):
    rows = [(1, [72, 101, 50256]), (2, []), (3, None), (4, [195, 40, 10**6, -1, 64]), (5, [162, 94])]
    got = {r.k: r.decoded for r in bpe.decode_documents(spark.createDataFrame(rows, "k int, ids array<int>"), PATH).collect()}
    assert got == {k: LIBRARY.decode([i for i in ids or [] if 0 <= i < 50257], skip_special_tokens=False) for k, ids in rows}


def test_long_words_take_the_same_merges():
    v = bpe.Encoder.load(PATH).vocabulary
    rng = np.random.default_rng(4)
    for n in (bpe.LONG, 150, 700):
        words = [bytes(w) for w in rng.choice(list(b"aehinorst"), (20, n)).tolist()] + [b"a" * n, b"ab" * n, "é漢".encode() * n]
        assert v.encode_words(words) == [library_tokens(v, w) for w in words]
        assert [v._propose_long(np.frombuffer(w, dtype=np.uint8).astype(np.int64)).tolist() for w in words] == [greedy(v, w) for w in words]


def library_tokens(v, word):
    number = {i: t for t, i in enumerate(v.ids)}
    return [number[i] for i in LIBRARY.encode(word.decode(), add_special_tokens=False).ids] if word.decode().isalpha() else v._merge_long(word)


def greedy(v, word):
    known, out, at = {b: t for t, b in enumerate(v.bytes)}, [], 0
    while at < len(word):
        size = next(k for k in range(min(v.longest, len(word) - at), 0, -1) if word[at : at + k] in known)
        out.append(known[word[at : at + size]])
        at += size
    return out


def test_a_word_of_a_megabyte_takes_seconds():
    rng = np.random.default_rng(5)
    text = bytes(rng.choice(list(b"abcdefghijklmnopqrstuvwxyz"), 1 << 20).tolist()).decode()
    began = time.time()
    e = bpe.Encoder(PATH)
    ids = e.encode(text)
    assert time.time() - began < 30
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids and e.decode(ids) == text


def test_documents(edge_docs, no_docs):
    rows = bpe.encode_documents(edge_docs, PATH, digests=True).collect()
    texts = sorted((r.doc_id, r.text or "") for r in edge_docs.collect())
    for r, (i, t) in zip(sorted(rows, key=lambda r: r.doc_id), texts):
        ids = LIBRARY.encode(t, add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens, list(r.ids), r.decoded) == (i, len(ids), ids, LIBRARY.decode(ids, skip_special_tokens=False))
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe.encode_documents(no_docs, PATH).count() == 0
