"""Best-fit packing by exact complements.

Documents become token ids and an end id; longer ones than a sequence are cut into full pieces and a rest. Packing
looks only at how many pieces there are of each length: the plan is made on those at most `capacity` counts, so it
has the same size whatever the input. From the longest length down, the gap that a piece leaves is filled exactly by
one length, or by a pair or a triple of lengths whose sum is the gap, as long as they last; what cannot be
complemented is filled best-fit: the longest length that fits, again and again. Each step takes as many copies as
all its lengths allow. A pattern of lengths and a number of copies then stands for that many sequences.

Pieces are numbered within their length by a range-partitioned sort (no length is gathered in one task), and a
piece's number tells its pattern, copy and offset by binary search in the plan.

Defined results: a null text is empty and yields the end id alone; ties and repeated rows are separate pieces; an
empty table gives an empty result; other columns are ignored by `pack_documents`.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.bpe import text_slices
from corpusloom.runtime import settle, ship, table

CAPACITY = 2048
CACHE_WORDS = 400_000
#: The pattern of the word vocabulary, with its letters and numbers below U+0250 written out.
LETTERS = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
NUMBERS = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
#: Characters that normalisation leaves alone but for lower case, and whose lower case is in the range again.
SIMPLE = "\\t-\\r\\x20-\\x7e\\xa1-\\u012f\\u0131-\\u0239\\u023b-\\u023d\\u023f-\\u024f\\u2010-\\u2027\\u2030-\\u203e\\u20ac"


class WordTokens:
    """Token ids of whole texts by a tokenizer file that drops white space, remembering words.

    Texts of simple characters are cut into words here, and only words not met before go to the tokenizer; all other
    texts, and those with a special token's string, go to it whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.simple = re.compile(f"[{SIMPLE}]*")
        #: A special string is looked for in lower case as well, as the tokenizer may do either.
        self.marks = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.word = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.table = np.zeros(0, dtype=np.uint32)
        self.start = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)

    def learn(self, texts: list[list[str]]) -> None:
        words = set(chain.from_iterable(texts))
        new = words.difference(self.place)
        if len(self.place) + len(new) > CACHE_WORDS:
            self.forget()
            new = words
        if not new:
            return
        new = list(new)
        flat, sizes = self._together(new)
        at = len(self.place)
        self.place.update(zip(new, range(at, at + len(new))))
        self.start = np.concatenate([self.start, len(self.table) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.table = np.concatenate([self.table, flat])

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words encoded in lines of many, and each word's number of ids; a line whose words can't be told apart
        again goes word by word."""
        if not hasattr(self, "ends"):
            self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), dtype=bool)
            for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
                self.ends[i] = token.endswith("</w>")
        flat, sizes = [], []
        for k in range(0, len(words), 1024):
            line = words[k : k + 1024]
            ids = np.array(self.tokenizer.encode(" ".join(line), add_special_tokens=False).ids, dtype=np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(line) and cuts[-1] == len(ids):
                flat.append(ids)
                sizes.append(np.diff(cuts, prepend=0))
            else:
                own = [e.ids for e in self.tokenizer.encode_batch_fast(line, add_special_tokens=False)]
                flat.append(np.array(list(chain.from_iterable(own)), dtype=np.uint32))
                sizes.append(np.array([len(x) for x in own], dtype=np.int64))
        return np.concatenate(flat), np.concatenate(sizes)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        lower = [t.lower() for t in texts]
        whole = [k for k, t in enumerate(texts) if not self.simple.fullmatch(t) or any(m in lower[k] for m in self.marks)]
        words = [self.word.findall(t) for t in lower]
        for k in whole:
            words[k] = []
        self.learn(words)
        counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=int(counts.sum()))
        size = self.size[at]
        ends = np.cumsum(size)
        flat = self.table[np.repeat(self.start[at] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        out = [flat[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        for k in whole:
            out[k] = np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, dtype=np.uint32)
        return out


_LOADED: dict[str, WordTokens] = {}


def _tokens(path: str) -> WordTokens:
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if wanted, the ids."""
    ship(docs.sparkSession)
    key = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * ids

    def run(batches):
        tokens = _tokens(path)
        for batch in batches:
            for first, texts in text_slices(batch.column(1)):
                rows, piece, start, length, crc, parts = [], [], [], [], [], []
                for k, found in enumerate(tokens.encode_batch(texts)):
                    full = np.append(found, np.uint32(end_id)).astype("<u4")
                    for p, at in enumerate(range(0, len(full), capacity)):
                        part = full[at : at + capacity]
                        rows.append(first + k)
                        piece.append(p)
                        start.append(at)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if ids:
                            parts.append(part.tolist())
                columns = [
                    batch.column(0).take(pa.array(rows, type=pa.int64())),
                    pa.array(piece, type=pa.int32()),
                    *[pa.array(x, type=pa.int64()) for x in (start, length, crc)],
                ]
                if ids:
                    columns.append(pa.array(parts, type=pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


@dataclass(frozen=True)
class Pattern:
    """Lengths that share a sequence, and the number of such sequences."""

    lengths: tuple[int, ...]
    copies: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that use up all counts (pieces by length, each from 1 to capacity)."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] += n
    out: list[Pattern] = []

    def take(lengths: list[int]) -> None:
        need: dict[int, int] = {}
        for x in lengths:
            need[x] = need.get(x, 0) + 1
        copies = min(int(left[x]) // n for x, n in need.items())
        for x, n in need.items():
            left[x] -= n * copies
        out.append(Pattern(tuple(lengths), copies))

    def pair(gap: int, spare: int, ceiling: int) -> tuple[int, int] | None:
        """Two lengths with that sum, the longer as long as can be; `spare` is in use once already."""
        high = np.arange(min(gap - 1, ceiling), (gap + 1) // 2 - 1, -1)
        if not len(high):
            return None
        low = gap - high
        has = left - (np.arange(len(left)) == spare)
        fits = (has[high] > 0) & (has[low] > np.where(high == low, 1, 0))
        k = int(np.argmax(fits))
        return (int(high[k]), int(low[k])) if fits[k] else None

    def complement(first: int, gap: int) -> list[int] | None:
        if left[gap] > (1 if gap == first else 0):
            return [gap]
        if two := pair(gap, first, gap - 1):
            return list(two)
        for a in range(gap - 2, (gap + 2) // 3 - 1, -1):
            if left[a] > (1 if a == first else 0):
                left[a] -= 1
                two = pair(gap - a, first, a)
                left[a] += 1
                if two:
                    return [a, *two]
        return None

    for length in range(capacity, 0, -1):
        while left[length]:
            gap = capacity - length
            lengths = [length]
            if gap and (more := complement(length, gap)):
                lengths += more
            else:
                while gap:
                    fits = np.flatnonzero(left[: gap + 1])
                    for x in fits[::-1].tolist():
                        if left[x] > lengths.count(x):
                            break
                    else:
                        break
                    lengths.append(x)
                    gap -= x
                    if gap and (last := [x for x in [gap] if left[x] > lengths.count(x)]):
                        lengths += last
                        break
            take(lengths)
    return out


def place(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, in the order of its pieces: first piece of each run, first sequence and offset of the run."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for p in patterns:
        offset = 0
        for x in p.lengths:
            runs.setdefault(x, []).append((used.get(x, 0), sequence, offset))
            used[x] = used.get(x, 0) + p.copies
            offset += x
        sequence += p.copies
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*rs)) for x, rs in runs.items()}


def pack(found: DataFrame, capacity: int = CAPACITY, partitions: int | None = None) -> DataFrame:
    """Add sequence_id and offset to rows that have a column `length` (and doc_id, piece for the order of equals)."""
    spark = found.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    order = ["length", "doc_id", "piece"]
    found = settle(found, "pieces")  # range partitioning reads its input twice
    placed = found.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = settle(placed, "pack-order")
    counts = {r["length"]: r["n"] for r in placed.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # lengths are sorted over all partitions, so a row's rank among all rows is its partition's start and its place
    part = F.shiftright(F.col("_place"), 33)
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    starts = np.zeros(max(sizes, default=0) + 2, dtype=np.int64)
    for p, k in sizes.items():
        starts[p + 1] = k
    starts = np.cumsum(starts)
    first, total = {}, 0
    for x in sorted(counts):
        first[x] = total
        total += counts[x]
    # one table over all ranks: where each run begins, then its sequence and offset
    runs = [(first[x] + a, s, o) for x, (begins, seqs, offs) in place(plan(counts, capacity)).items() for a, s, o in zip(begins.tolist(), seqs.tolist(), offs.tolist())]
    runs.sort()
    begins, sequences, offsets = (np.array(c, dtype=np.int64) for c in zip(*runs)) if runs else (np.zeros(0, dtype=np.int64),) * 3
    kept = [f for f in placed.schema if f.name != "_place"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id bigint, offset bigint"

    def run(batches):
        for batch in batches:
            at = batch.column(batch.schema.get_field_index("_place")).to_numpy()
            rank = starts[at >> 33] + (at & ((1 << 33) - 1))
            k = np.searchsorted(begins, rank, side="right") - 1
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequences[k] + rank - begins[k]), pa.array(offsets[k])], names=[f.name for f in kept] + ["sequence_id", "offset"]
            )

    return placed.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    return pack(pieces(docs, path, capacity, ids=ids), capacity)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
