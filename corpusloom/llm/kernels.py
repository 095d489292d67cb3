"""Vectorised text kernels over Arrow string buffers: words, word hashes, window hashes.

Everything works on whole texts. A batch is walked in slices of about SLICE_BYTES of text, so memory follows the
longest single text, not the batch. Null texts count as empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
#: Space, tab, line feed, vertical tab, form feed, carriage return separate words.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[ord("A") : ord("Z") + 1] += 32

_U = np.uint64
_SEED = np.random.default_rng(20240229)
_BYTE = _SEED.integers(1, 2**64, 256, dtype=np.uint64)
#: Odd numbers have inverses modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_WINDOW_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    known = _powers.get(base)
    if known is None or len(known[0]) < n:
        size = max(n, SLICE_BYTES + 1024)
        tables = []
        for b in (base, pow(base, -1, 2**64)):
            t = np.full(size, b, dtype=np.uint64)
            t[0] = 1
            np.multiply.accumulate(t, out=t)
            tables.append(t)
        known = (tables[0], tables[1])
        if size <= 8 * SLICE_BYTES:
            _powers[base] = known
    return known


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a finaliser of the splitmix kind)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Slice:
    """Some consecutive texts of a batch: their bytes and where each text begins."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.count = len(offsets) - 1

    def words(self) -> None:
        """Find words: starts, ends and, for each text, the index of its first word (one more at the end)."""
        space = IS_SPACE[self.data]
        begin = ~space
        end = begin.copy()
        begin[1:] &= space[:-1]
        end[:-1] &= space[1:]
        if len(self.data):
            cuts = self.offsets[1:-1]
            first = cuts[cuts < len(self.data)]
            begin[first] = ~space[first]
            last = cuts[cuts > 0] - 1
            end[last] = ~space[last]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.n_words = np.diff(self.bounds)

    def hash_words(self) -> np.ndarray:
        up, down = _power_tables(_BASE, len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[self.data] * up[: len(self.data)], out=total[1:])
        h = (total[self.ends] - total[self.starts]) * down[self.starts]
        self.hashes = mix(h + (self.ends - self.starts).astype(np.uint64))
        return self.hashes

    def runs(self, k: int, which: int = 0) -> np.ndarray:
        """For each word i, the hash of words i to i+k-1 of the slice; it may cross texts: see inside()."""
        return run_hashes(self.hashes, k, which)

    def inside(self, k: int) -> np.ndarray:
        """For each run of k words of the slice, whether it lies within one text."""
        n = max(0, len(self.hashes) - k + 1)
        ok = np.ones(n, dtype=bool)
        for b in self.bounds[1:-1]:
            ok[max(0, b - k + 1) : b] = False
        return ok


def run_hashes(h: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    if len(h) < k:
        return np.zeros(0, dtype=np.uint64)
    up, down = _power_tables(_WINDOW_BASES[which], len(h) + 1)
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: len(h) - k + 1] + _U(k))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array | pa.ChunkedArray, lower: bool = False, size: int = SLICE_BYTES) -> Iterator[Slice]:
    if len(column) == 0:
        return
    data, offsets = text_bytes(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(n, max(j, i + 1))
        part = data[offsets[i] : offsets[j]]
        yield Slice(i, TO_LOWER[part] if lower else part, offsets[i : j + 1] - offsets[i])
        i = j


def shingle_sets(column, k: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of the k-word runs) of each text, letters A-Z lower-cased; a text of fewer words
    counts as one run, one without words has no run."""
    for part in slices(column, lower=True):
        part.words()
        h = part.hash_words()
        runs = part.runs(k)
        for d in range(part.count):
            a, b = int(part.bounds[d]), int(part.bounds[d + 1])
            if b - a >= k:
                yield part.first + d, np.unique(runs[a : b - k + 1])
            elif b > a:
                yield part.first + d, run_hashes(h[a:b], b - a)
            else:
                yield part.first + d, np.zeros(0, dtype=np.uint64)
