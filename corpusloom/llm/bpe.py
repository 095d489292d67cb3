"""Byte-level BPE by speculation and verification.

A text is cut into words by the vocabulary's pattern. Words not met before are encoded together: greedy longest match
proposes tokens (a vectorised walk of the vocabulary's trie), then every adjacent pair of proposed tokens is tested at
once for compatibility. A proposal all of whose pairs are compatible is what merging would give; only the words that
fail undergo exact merging (of long words over a heap of pairs, so that the work grows as n log n). Encoded words are
remembered per Python worker, in a table that is emptied when it grows beyond CACHE_WORDS words or CACHE_TOKENS tokens, so
memory stays bounded. Decoding gathers the bytes of many texts' ids from one table at once.

Defined results: a null or empty text has no ids and decodes to the empty text; ids that the vocabulary lacks decode to
nothing, and bytes that are not UTF-8 to the replacement sign; the special token's string in a text
is that token; each row is encoded alone, so ties and repeated rows need nothing; an empty table gives an empty
result; other columns are ignored by the query and kept by `encode_documents` where they are named.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from corpusloom.llm.kernels import text_bytes
from corpusloom.runtime import ship, table

CACHE_WORDS = 400_000
CACHE_TOKENS = 4_000_000
#: Words of this many bytes or more are matched at all places at once, and merged over a heap.
LONG = 96
SLICE_BYTES = 2 << 20
#: White space as the tokenizer's pattern understands it.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters and numbers below U+0250, where the standard library's faster engine needs no properties.
LETTERS = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
NUMBERS = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
#: Texts of these characters alone take the faster engine; the second range holds punctuation and signs only.
SIMPLE = "\\x00-\\u024f\\u2010-\\u2027\\u2030-\\u203e\\u20ac"


def word_pattern(letters: str, numbers: str) -> str:
    return (
        rf"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^{WHITE}{letters}{numbers}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
    )


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file, back to the byte: printable Latin-1 stands for
    itself, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Pieces:
    """A byte string for each id, and the joined strings of many ids at once."""

    def __init__(self, strings: list[bytes]):
        self.data = np.frombuffer(b"".join(strings), dtype=np.uint8)
        self.size = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
        self.start = np.cumsum(self.size) - self.size

    def join(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """One string for each row: rows of `counts` ids follow one another in `ids`. Unknown ids give nothing."""
        known = (ids >= 0) & (ids < len(self.size))
        ids = np.where(known, ids, 0)
        size = np.where(known, self.size[ids], 0)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        joined = self.data[np.repeat(self.start[ids] - (ends - size), size) + np.arange(total)].tobytes()
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [joined[a:b] for a, b in zip(cuts, cuts[1:])]


class Vocabulary:
    """Tokens numbered in the order in which merging makes them: bytes first, then one for each merge."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        raw = lambda t: bytes(letters[c] for c in t)
        self.bytes: list[bytes] = [bytes([b]) for b in range(256)]
        by_letter = {b: c for c, b in letters.items()}
        self.ids: list[int] = [vocab[by_letter[b]] for b in range(256)]
        number = {by_letter[b]: b for b in range(256)}
        self.left, self.right = list(range(256)), list(range(256))
        self.merge: dict[tuple[int, int], int] = {}
        for pair in spec["model"]["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            t = len(self.ids)
            self.merge[number[a], number[b]] = t
            number[a + b] = t
            self.ids.append(vocab[a + b])
            self.bytes.append(raw(a + b))
            self.left.append(number[a])
            self.right.append(number[b])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*self.ids, *self.special.values()]) + 1
        raw_of = [b""] * size
        for t, i in enumerate(self.ids):
            raw_of[i] = self.bytes[t]
        for mark, i in self.special.items():
            raw_of[i] = mark.encode()
        self.raw = Pieces(raw_of)
        self.decimal = Pieces([b"%d," % i for i in range(size)])
        self.longest = max(map(len, self.bytes))
        self.ids_of = np.array(self.ids, dtype=np.int64)
        self.left_of, self.right_of = np.array(self.left), np.array(self.right)
        keys = np.array([(a << 20) | b for a, b in self.merge], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_token = np.array(list(self.merge.values()), dtype=np.int64)[order]
        self._grow_trie()

    def _grow_trie(self) -> None:
        edges: dict[tuple[int, int], int] = {}
        token_at = [-1]
        for t, word in enumerate(self.bytes):
            node = 0
            for b in word:
                nxt = edges.get((node, b))
                if nxt is None:
                    nxt = edges[node, b] = len(token_at)
                    token_at.append(-1)
                node = nxt
            token_at[node] = t
        self.token_at = np.array(token_at)
        keys = np.array([(n << 8) | b for n, b in edges], dtype=np.int64)
        order = np.argsort(keys)
        self.edge_keys = keys[order]
        self.edge_to = np.array(list(edges.values()), dtype=np.int64)[order]
        self.from_root = np.zeros(256, dtype=np.int64)
        for (n, b), to in edges.items():
            if n == 0:
                self.from_root[b] = to

    def propose(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words at once: (word, token) in the order of each word."""
        words, tokens = [], []
        for k in np.flatnonzero(end - begin >= LONG).tolist():
            found = self._propose_long(data[begin[k] : end[k]])
            words.append(np.full(len(found), k))
            tokens.append(found)
        live, at = np.arange(len(begin)), begin.copy()
        live = live[(at < end) & (end - begin < LONG)]
        while len(live):
            start, stop = at[live], end[live]
            node = self.from_root[data[start]]
            best, size = self.token_at[node], np.ones(len(live), dtype=np.int64)
            walk, depth = np.flatnonzero(start + 1 < stop), 1
            while len(walk):
                key = (node[walk] << 8) | data[start[walk] + depth]
                k = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
                found = self.edge_keys[k] == key
                walk, to = walk[found], self.edge_to[k[found]]
                node[walk] = to
                depth += 1
                token = self.token_at[to]
                whole = token >= 0
                best[walk[whole]], size[walk[whole]] = token[whole], depth
                walk = walk[start[walk] + depth < stop[walk]]
            words.append(live)
            tokens.append(best)
            at[live] += size
            live = live[at[live] < end[live]]
        if not words:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        w, t = np.concatenate(words), np.concatenate(tokens)
        order = np.argsort(w, kind="stable")
        return w[order], t[order]

    def _propose_long(self, word: np.ndarray) -> np.ndarray:
        """The same for one long word: the longest match at every place at once, then the places that the walk meets."""
        out: list[np.ndarray] = []
        at, step = 0, 1 << 18
        while at < len(word):
            part = word[at : at + step + self.longest]
            node = self.from_root[part]
            best, size = self.token_at[node], np.ones(len(part), dtype=np.int64)
            walk, depth = np.arange(max(len(part) - 1, 0)), 1
            while len(walk):
                key = (node[walk] << 8) | part[walk + depth]
                k = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
                found = self.edge_keys[k] == key
                walk, to = walk[found], self.edge_to[k[found]]
                node[walk] = to
                depth += 1
                token = self.token_at[to]
                whole = token >= 0
                best[walk[whole]], size[walk[whole]] = token[whole], depth
                walk = walk[walk + depth < len(part)]
            sizes, places, i, stop = size.tolist(), [], 0, min(step, len(part))
            while i < stop:
                places.append(i)
                i += sizes[i]
            out.append(best[places])
            at += i
        return np.concatenate(out)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that a and b merge to; a number above all tokens where they don't."""
        key = (a << 20) | b
        k = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[k] == key, self.pair_token[k], len(self.ids) + 1)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of a and b gives back just a and b, for all pairs at once.

        Merges are undone from the last to the first. `limit` is the step before which the two pieces that now meet
        at the boundary stood side by side: had they a merge of their own before it, it would have come first. Of
        equal merges the left one comes first, hence the limit one higher when the right piece is undone."""
        fine = np.ones(len(a), dtype=bool)
        live, a, b = np.arange(len(a)), a.copy(), b.copy()
        limit = np.full(len(a), len(self.ids) + 1)
        while len(live):
            crossed = self.merged(a, b) < limit
            fine[live[crossed]] = False
            on = ~crossed & ((a > 255) | (b > 255))
            live, a, b = live[on], a[on], b[on]
            undo_left = a > b
            limit = np.where(undo_left, a, b + 1)
            a, b = np.where(undo_left, self.right_of[a], a), np.where(undo_left, b, self.left_of[b])
        return fine

    def merge_exactly(self, word: bytes) -> list[int]:
        """Merge the earliest pair, leftmost first, until none is left; only the pairs beside a merge are looked up anew."""
        if len(word) >= LONG:
            return self._merge_long(word)
        merged, none = self.merge.get, 1 << 30
        parts = list(word)
        pairs = [merged(p, none) for p in zip(parts, parts[1:])]
        while pairs and (token := min(pairs)) != none:
            at = pairs.index(token)
            parts[at : at + 2] = [token]
            del pairs[at]
            if at:
                pairs[at - 1] = merged((parts[at - 1], token), none)
            if at < len(pairs):
                pairs[at] = merged((token, parts[at + 1]), none)
        return parts

    def _merge_long(self, word: bytes) -> list[int]:
        """The same over a heap of (token, place); parts are linked, and a pair whose parts have changed is passed over."""
        merged = self.merge.get
        parts, n = list(word), len(word)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(t, i) for i, t in enumerate(map(merged, zip(parts, parts[1:]))) if t is not None]
        heapq.heapify(heap)
        while heap:
            token, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or merged((parts[i], parts[j])) != token:
                continue
            parts[i], parts[j] = token, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (t := merged((token, parts[k]))) is not None:
                    heapq.heappush(heap, (t, i))
            h = before[i]
            if h >= 0 and (t := merged((parts[h], token))) is not None:
                heapq.heappush(heap, (t, h))
        return [t for t in parts if t >= 0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Tokens (in this class's numbers) of each word."""
        if not words:
            return []
        data = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        end = np.cumsum(sizes)
        word, token = self.propose(data, end - sizes, end)
        meets = np.flatnonzero(word[1:] == word[:-1])
        bad = np.unique(word[meets[~self.compatible(token[meets], token[meets + 1])]])
        cuts = np.searchsorted(word, np.arange(len(words) + 1)).tolist()
        flat = token.tolist()
        out = [flat[i:j] for i, j in zip(cuts, cuts[1:])]
        for k in bad.tolist():
            out[k] = self.merge_exactly(words[k])
        return out


_LOADED: dict[str, Encoder] = {}


class Encoder:
    """Encodes and decodes whole texts with one vocabulary file, remembering words."""

    def __init__(self, path: str):
        import regex

        self.vocabulary = Vocabulary(path)
        self.simple = re.compile(f"[{SIMPLE}]*")
        self.fast = re.compile(word_pattern(LETTERS, NUMBERS))
        self.full = regex.compile(word_pattern("\\p{L}", "\\p{N}"))
        self.marks = self.vocabulary.special
        self.split = re.compile("(" + "|".join(map(re.escape, self.marks)) + ")") if self.marks else None
        self.forget()

    @classmethod
    def load(cls, path: str) -> Encoder:
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def forget(self) -> None:
        """Only the special strings are known; a word's place is its row of `start` and `size` in the table of ids."""
        self.place = {m: k for k, m in enumerate(self.marks)}
        self.table = np.array(list(self.marks.values()), dtype=np.int64)
        self.start, self.size = np.arange(len(self.marks)), np.ones(len(self.marks), dtype=np.int64)

    def words(self, text: str) -> list[str]:
        if any(m in text for m in self.marks):
            out = []
            for k, part in enumerate(self.split.split(text)):
                out += [part] if k % 2 else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        return (self.fast if self.simple.fullmatch(text) else self.full).findall(text)

    def learn(self, texts: list[list[str]]) -> None:
        words = set(chain.from_iterable(texts))
        new = words.difference(self.place)
        if len(self.place) + len(new) > CACHE_WORDS or len(self.table) > CACHE_TOKENS:
            self.forget()
            new = words.difference(self.place)
        if not new:
            return
        new, v = list(new), self.vocabulary
        tokens = v.encode_words([w.encode("utf-8", "surrogatepass") for w in new])
        sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        at = len(self.place)
        self.place.update(zip(new, range(at, at + len(new))))
        self.start = np.concatenate([self.start, len(self.table) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        flat = np.fromiter(chain.from_iterable(tokens), dtype=np.int64, count=int(sizes.sum()))
        self.table = np.concatenate([self.table, v.ids_of[flat]])

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)."""
        words = [self.words(t) for t in texts]
        self.learn(words)
        counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=int(counts.sum()))
        size = self.size[at]
        ends = np.cumsum(size)
        ids = self.table[np.repeat(self.start[at] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(bounds)

    def decode_batch(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of rows of ids, from the ids alone."""
        return [raw.decode("utf-8", "replace") for raw in self.vocabulary.raw.join(ids, counts)]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return self.decode_batch(np.array(ids, dtype=np.int64), np.array([len(ids)]))[0]


def text_slices(column, size: int = SLICE_BYTES) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in slices of about the given bytes."""
    _, offsets = text_bytes(column)
    i, n = 0, len(column)
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1))
        yield i, ["" if t is None else t for t in column.slice(i, j - i).to_pylist()]
        i = j


def encode_documents(docs, path: str, columns: tuple[str, ...] = ("doc_id",), ids: bool = True, digests: bool = False):
    """The named columns with n_tokens and, as wanted, ids (array) and decoded text, or the digests of both."""
    ship(docs.sparkSession)
    kept = docs.select(*columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", n_tokens bigint"
    schema += ", ids array<int>, decoded string" * ids + ", ids_sha256 string, decoded_sha256 string" * digests

    def run(batches):
        encoder = Encoder.load(path)
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("_text"))
            for first, texts in text_slices(text):
                flat, counts = encoder.encode_batch(texts)
                decoded = encoder.decode_batch(flat, counts)
                arrays = [batch.column(k).slice(first, len(texts)) for k in range(len(columns))]
                arrays.append(pa.array(counts, type=pa.int64()))
                if ids:
                    offsets = np.concatenate([[0], np.cumsum(counts)])
                    arrays.append(pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(flat, type=pa.int32())))
                    arrays.append(pa.array(decoded, type=pa.string()))
                if digests:
                    decimals = [x[:-1] for x in encoder.vocabulary.decimal.join(flat, counts)]
                    for raw in (decimals, [d.encode("utf-8") for d in decoded]):
                        arrays.append(pa.array([hashlib.sha256(x).hexdigest() for x in raw], type=pa.string()))
                names = [*columns, "n_tokens"] + ["ids", "decoded"] * ids + ["ids_sha256", "decoded_sha256"] * digests
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(*columns, F.col("text").alias("_text")).mapInArrow(run, schema)


def decode_documents(docs, path: str, column: str = "ids", decoded: str = "decoded"):
    """All columns of the rows and the text of the array of ids; null ids are none."""
    ship(docs.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{decoded}` string"
    at = docs.columns.index(column)

    def run(batches):
        encoder = Encoder.load(path)
        for batch in batches:
            lists = batch.column(at)
            counts = np.array([n or 0 for n in pc.list_value_length(lists).to_pylist()], dtype=np.int64)
            flat = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(encoder.decode_batch(flat, counts), type=pa.string())], names=[*batch.schema.names, decoded])

    return docs.mapInArrow(run, schema)


def query(spark, sf_dir: str):
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ids=False, digests=True)
