import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def first_fit_decreasing(counts, capacity):
    room = []
    for x in sorted(Counter(counts).elements(), reverse=True):
        for k, r in enumerate(room):
            if r >= x:
                room[k] -= x
                break
        else:
            room.append(capacity - x)
    return len(room)


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_all_pieces_and_fits(seed):
    rng = np.random.default_rng(seed)
    counts = {int(x): int(rng.integers(1, 50)) for x in rng.integers(1, 65, 30)}
    patterns = P.plan(counts, 64)
    used = Counter()
    for p in patterns:
        assert sum(p.lengths) <= 64 and p.copies > 0
        for x in p.lengths:
            used[x] += p.copies
    assert used == Counter(counts)
    assert sum(p.copies for p in patterns) <= 1.02 * first_fit_decreasing(counts, 64) + 1


def test_complements_are_exact():
    assert sorted((p.lengths, p.copies) for p in P.plan({60: 2, 4: 2}, 64)) == [((60, 4), 2)]
    assert P.plan({60: 1, 3: 1, 1: 1}, 64)[0].lengths == (60, 3, 1)
    assert P.plan({50: 1, 7: 1, 4: 1, 3: 1}, 64)[0].lengths == (50, 7, 4, 3)
    assert P.plan({32: 3}, 64)[0] == P.Pattern((32, 32), 1)
    assert P.plan({}, 64) == []


def test_pieces_and_places(edge_docs, make_docs):
    docs = edge_docs.union(make_docs(*[(100 + k, "some words here " * k) for k in range(40)]))
    t = Tokenizer.from_file(PATH)
    rows = P.pack_documents(docs, PATH, capacity=256, ids=True).collect()
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    want = Counter()
    for i, x in texts:
        ids = [*t.encode(x, add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            want[i, p, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        assert len(r.ids) == r.length
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256


def test_empty_table(no_docs):
    assert P.pack_documents(no_docs, PATH).count() == 0


def test_words_in_lines_equal_whole_texts():
    tokens, t = P.WordTokens(PATH), Tokenizer.from_file(PATH)
    rng = np.random.default_rng(0)
    letters = list("  \n'sStrevldm.,!aAeé0195²ªñ½€“”-İ漢Σ<|>")
    texts = ["".join(rng.choice(letters, rng.integers(0, 80))) for _ in range(3000)]
    assert [x.tolist() for x in tokens.encode_batch(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
