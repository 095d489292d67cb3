"""Centrality of sentences.

Undamped scores have a closed form: the chain of a symmetric graph is reversible, so within a connected component a
sentence's share is its row sum.
A row sum of cosines needs no pairs at all: sum over its terms of its own weight times the document's total weight of the
term. Damped and biased scores are power iterations, one NumPy kernel per document over Arrow batches; without a threshold
a step goes through the terms (to the terms and back), so no matrix of sentences is made and a step is linear in a
document's terms. With one, the sentences above it are found in blocks of rows. Chains of other tables: see `chains`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pandas.util import hash_array
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.runtime import ship


def row_sums(unit: DataFrame, sents: DataFrame) -> DataFrame:
    """(doc_id, sent_ix, total): sum of a sentence's cosines to all sentences of its document, itself included; a sentence
    without weights has its edge to itself."""
    together = F.sum("x").over(Window.partitionBy("doc_id", "term"))
    total = unit.withColumn("s", together).groupBy("doc_id", "sent_ix").agg(F.sum(F.col("x") * F.col("s")).alias("t"))
    return sents.select("doc_id", "sent_ix").join(total, ["doc_id", "sent_ix"], "left").select("doc_id", "sent_ix", F.coalesce("t", F.lit(1.0)).alias("total"))


def undamped(unit: DataFrame, sents: DataFrame) -> DataFrame:
    """(doc_id, sent_ix, score): row sums scaled, within each component of a document, to the component's size.

    Two sentences with a weighted term in common are joined; a sentence without weights is a component of its own, with
    score 1. One kernel call for each document is linear in its terms: no pair of sentences is made."""
    return _each_document(unit, sents, lambda row, term, x, n, share: [sparse_scores(row, term, x, n, "undamped")], "score double")


def weighed(unit: DataFrame) -> DataFrame:
    """Entries of a table of unit vectors (.., x), or of weights (.., w) that aren't divided by their norm yet: (doc_id, sent_ix, t, w)."""
    w = "x" if "x" in unit.columns else "w"
    return unit.filter(F.col(w) > 0).select("doc_id", "sent_ix", F.xxhash64("term").alias("t"), F.col(w).alias("w"))


#: Rows of a batch that kernels give back.
OUT_ROWS = 100_000


def _documents(unit: DataFrame, sents: DataFrame, bias: DataFrame | None = None) -> DataFrame:
    """(doc_id, e): all entries of a document's sentences in one row, and an entry without a term for each sentence. Lists are
    begun before the one shuffle, and words are hashes in it."""
    rows = weighed(unit).withColumn("share", F.lit(None).cast("double"))
    none = lambda share: [F.lit(None).cast("long").alias("t"), F.lit(None).cast("double").alias("w"), share.alias("share")]
    rows = rows.unionByName(sents.select("doc_id", "sent_ix", *none(F.lit(None).cast("double"))))
    if bias is not None:
        rows = rows.unionByName(bias.select("doc_id", "sent_ix", *none(F.col("share"))))
    return rows.groupBy("doc_id").agg(F.collect_list(F.struct("sent_ix", "t", "w", "share")).alias("e"))


def _entries(inner: pa.StructArray, normal: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sentences in order, row, term, x, share) of a document's entries, ordered by row and term, so that sums don't depend on
    the order in which entries came."""
    at, row = np.unique(inner.field("sent_ix").to_numpy(), return_inverse=True)
    real = np.asarray(inner.field("t").is_valid())
    share = np.zeros(len(at))
    if inner.field("share").null_count < len(inner):
        given = np.asarray(inner.field("share").is_valid())
        share[row[given]] = inner.field("share").fill_null(0.0).to_numpy()[given]
    row, t, w = row[real], inner.field("t").fill_null(0).to_numpy()[real], inner.field("w").fill_null(0.0).to_numpy()[real]
    order = np.lexsort((t, row))
    row, t, w = row[order], t[order], w[order]
    _, term = np.unique(t, return_inverse=True)
    if not normal:
        w = w / np.sqrt(np.bincount(row, w * w, minlength=len(at)))[row]
    return at, row, term, w, share


def _shuffled(batch: pa.RecordBatch, normal: bool) -> Iterator[tuple]:
    """(place in the batch, `_entries`) of each row of `_documents`."""
    for k in range(batch.num_rows):
        yield k, *_entries(batch.column(1)[k].values, normal)


@dataclass(frozen=True)
class Placed:
    """Documents with the words of their sentences (doc_id, w), whose entries are made where they lie, by a broadcast IDF table: (hashes
    of terms in order, their idf, the idf of all others). It takes the place of a table of weights; nothing is shuffled or written."""

    rows: DataFrame
    idf: Broadcast
    columns: tuple[str, ...] = ("w",)


#: Words of documents that are counted together.
PLACED_WORDS = 1_000_000


def hashed(terms: pa.Array) -> np.ndarray:
    """A number of 64 bits for each term, the same in every process."""
    return hash_array(np.asarray(terms.to_pylist(), dtype=object), categorize=False).view(np.int64)


def placed_entries(lists: pa.Array, idf: tuple[np.ndarray, np.ndarray, float]) -> Iterator[tuple]:
    """As `_shuffled`, of the lists of words of each document's sentences; documents without sentences are left out."""
    hashes, weights, rest = idf
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    in_sents = np.concatenate([[0], np.cumsum(np.asarray(lists.flatten().value_lengths().fill_null(0)))])
    words_to = in_sents[np.cumsum(sizes)] if len(sizes) else np.zeros(0, dtype=np.int64)
    begins = np.flatnonzero(np.diff(words_to // PLACED_WORDS, prepend=-1))
    for low, high in zip(begins, [*begins[1:], len(lists)]):
        n = sizes[low:high]
        first = np.concatenate([[0], np.cumsum(n)])
        sents = lists.slice(low, high - low).flatten()
        words = sents.flatten().dictionary_encode()
        size = max(len(words.dictionary), 1)
        code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        found, tf = np.unique(np.repeat(np.arange(len(sents)), np.asarray(sents.value_lengths().fill_null(0))) * size + code, return_counts=True)
        sent, term = np.divmod(found, size)
        own = hashed(words.dictionary)
        at = np.searchsorted(hashes, own)
        held = np.append(hashes, 0)[at] == own
        held &= at < len(hashes)
        w = tf * np.where(held, np.append(weights, rest)[at], rest)[term]
        keep = w > 0
        sent, t, w = sent[keep], own[term[keep]], w[keep]
        order = np.lexsort((t, sent))
        sent, t, w = sent[order], t[order], w[order]
        cuts = np.searchsorted(sent, first)
        for k in np.flatnonzero(n):
            own = slice(cuts[k], cuts[k + 1])
            row, x = sent[own] - first[k], w[own]
            x = x / np.sqrt(np.bincount(row, x * x, minlength=n[k]))[row]
            yield int(low + k), np.arange(n[k]), row, np.unique(t[own], return_inverse=True)[1], x, np.zeros(n[k])


def _mapped(unit: DataFrame | Placed, sents: DataFrame, bias: DataFrame | None, run, schema: str) -> DataFrame:
    """What run(batches, read) gives over all documents, where read(batch) gives (place in the batch, `_entries`)."""
    if isinstance(unit, Placed):
        held = unit.idf
        return unit.rows.mapInArrow(lambda batches: run(batches, lambda batch: placed_entries(batch.column(1), held.value)), schema)
    normal = "x" in unit.columns
    return _documents(unit, sents, bias).mapInArrow(lambda batches: run(batches, lambda batch: _shuffled(batch, normal)), schema)


def placed_scores(placed: Placed, words: Column, method: str = "damped", **options) -> Column:
    """The scores of each document's sentences as a column of lists, of the column that has their words; a document without
    sentences has none."""
    held, plain = placed.idf, method == "damped" and options.get("threshold") is None

    @F.arrow_udf("array<double>")
    def scores(lists: pa.Array) -> pa.Array:
        found: list = [None] * len(lists)
        held_docs, size = [], 0

        def flush():
            if plain:
                every = damped_scores([f[2:] for f in held_docs], **{k: v for k, v in options.items() if k != "threshold"})
                parts = np.split(every, np.cumsum([len(f[1]) for f in held_docs])[:-1])
            else:
                parts = [sparse_scores(row, term, x, n, method, **options) for _, _, row, term, x, n, _ in held_docs]
            for f, part in zip(held_docs, parts):
                found[f[0]] = part

        for k, at, row, term, x, share in placed_entries(lists, held.value):
            held_docs.append((k, at, row, term, x, len(at), share))
            size += len(x) + len(at)
            if size > TOGETHER:
                flush()
                held_docs, size = [], 0
        if held_docs:
            flush()
        return pa.array(found, pa.list_(pa.float64()))

    return scores(words)


def _each_document(unit: DataFrame, sents: DataFrame, kernel, schema: str, bias: DataFrame | None = None) -> DataFrame:
    """(doc_id, sent_ix, what the kernel gives for each sentence), one call for each document."""
    ship(sents.sparkSession)
    key = sents.schema["doc_id"].dataType.simpleString()

    def run(batches, read):
        for batch in batches:
            for k, at, row, term, x, share in read(batch):
                found = kernel(row, term, x, len(at), share)
                ids = batch.column(0).slice(k, 1).take(pa.array(np.zeros(len(at), dtype=np.int64)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(at, type=pa.int32()), *[pa.array(f) for f in found]], names=["doc_id", "sent_ix", *[c.split()[0] for c in schema.split(", ")]])

    return _mapped(unit, sents, bias, run, f"doc_id {key}, sent_ix int, {schema}")


def component_scores(row: np.ndarray, term: np.ndarray, x: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
    """Scores of rows 0 to n-1 from the entries (row, term, x) of a matrix of unit rows, or of rows with the given sums."""
    n = int(row.max(initial=-1)) + 1
    if total is None:
        total = np.bincount(row, x * np.bincount(term, x)[term], minlength=n) if n else np.zeros(0)
    label = np.arange(n)
    while True:  # the smallest row that terms lead to, with its own label at the next turn
        low = np.full(int(term.max(initial=-1)) + 1, n)
        np.minimum.at(low, term, label[row])
        new = label.copy()
        np.minimum.at(new, row, low[term])
        new = new[new]
        if (new == label).all():
            break
        label = new
    size, mass = np.bincount(label, minlength=n), np.bincount(label, total, minlength=n)
    return total * size[label] / np.where(mass[label] > 0, mass[label], 1.0)


def iterate(step, n: int, teleport: np.ndarray, lost: np.ndarray, damping: float = 0.85, steps: int = 50, tolerance: float = 0.0) -> np.ndarray:
    """Shares that sum to 1, from a uniform start. step: shares to shares, along the chain; what is at `lost` nodes, which
    lead nowhere, follows the teleport vector."""
    v = np.full(n, 1.0 / max(n, 1))
    for _ in range(steps):
        new = damping * (step(v) + v[lost].sum() * teleport) + (1 - damping) * teleport
        done = np.abs(new - v).sum() < tolerance * n
        v = new
        if done:
            break
    return v


def power_iteration(p: np.ndarray, teleport: np.ndarray, damping: float = 0.85, steps: int = 50, tolerance: float = 0.0) -> np.ndarray:
    """`iterate` along a matrix; rows that are all zero lead nowhere."""
    return iterate(lambda v: v @ p, len(p), teleport, p.sum(1) == 0, damping, steps, tolerance)


#: Cells of a block of rows against all rows that are held at a time.
BLOCK_CELLS = 4_000_000


def product_blocks(row: np.ndarray, term: np.ndarray, x: np.ndarray, n: int, y: np.ndarray | None = None):
    """(low, block): the products of rows from `low` on with all n rows, a block of rows at a time; y: entries of the second
    side where they differ, of the same terms."""
    y = x if y is None else y
    by_term = np.argsort(term, kind="stable")
    rows_of, y_of, sizes = row[by_term], y[by_term], np.bincount(term, minlength=int(term.max(initial=-1)) + 1)
    starts = np.cumsum(sizes) - sizes
    by_row = np.argsort(row, kind="stable")
    cuts = np.searchsorted(row[by_row], np.arange(n + 1))
    size = max(1, BLOCK_CELLS // max(n, 1))
    for low in range(0, n, size):
        high = min(n, low + size)
        own = by_row[cuts[low] : cuts[high]]
        block = np.zeros((high - low) * n)
        # the rows of each term are met a bounded number at a time
        many = np.cumsum(sizes[term[own]])
        for part in np.split(own, np.flatnonzero(np.diff(many // BLOCK_CELLS)) + 1) if len(own) else ():
            lengths = sizes[term[part]]
            at = np.repeat(starts[term[part]] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            cell = np.repeat((row[part] - low) * n, lengths) + rows_of[at]
            block += np.bincount(cell, np.repeat(x[part], lengths) * y_of[at], minlength=len(block))
        yield low, block.reshape(high - low, n)


def pairs_above(row: np.ndarray, term: np.ndarray, x: np.ndarray, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), both ways and with i = j, of rows whose product is above the threshold; a row's product with itself is 1."""
    found = []
    for low, block in product_blocks(row, term, x, n):
        block[np.arange(len(block)), low + np.arange(len(block))] = 1.0
        i, j = np.nonzero(block > threshold)
        found.append((i + low, j))
    return tuple(np.concatenate(p) for p in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))


def each_pair(unit: DataFrame, sents: DataFrame, kernel, value: str) -> DataFrame:
    """(doc_id, i, j, value) of pairs of sentences of a document, without a shuffle of pairs: kernel(row, term, x, n) gives
    (i, j, value) by blocks of rows, and its pairs leave in batches of OUT_ROWS."""
    ship(sents.sparkSession)
    key = sents.schema["doc_id"].dataType.simpleString()

    def run(batches, read):
        for batch in batches:
            for k, at, row, term, x, _ in read(batch):
                for i, j, v in kernel(row, term, x, len(at)):
                    for low in range(0, len(i), OUT_ROWS):
                        a, b, c = (z[low : low + OUT_ROWS] for z in (i, j, v))
                        ids = batch.column(0).slice(k, 1).take(pa.array(np.zeros(len(a), dtype=np.int64)))
                        yield pa.RecordBatch.from_arrays([ids, pa.array(at[a], type=pa.int32()), pa.array(at[b], type=pa.int32()), pa.array(c)], names=["doc_id", "i", "j", value])

    return _mapped(unit, sents, None, run, f"doc_id {key}, i int, j int, {value} double")


def sparse_scores(
    row: np.ndarray, term: np.ndarray, x: np.ndarray, n: int, method: str = "damped", bias: np.ndarray | None = None, damping=0.85, steps=50, threshold: float | None = None, tolerance=0.0
) -> np.ndarray:
    """Scores of n unit rows given by entries (row, term, x); method: damped or undamped (by component, sum n)."""
    i, j = pairs_above(row, term, x, n, threshold) if threshold is not None else (None, None)
    if method == "undamped":
        if threshold is None:
            score = np.ones(n)
            known = component_scores(row, term, x)
            score[np.unique(row)] = known[np.unique(row)]
            return score
        # an edge is a term that two rows have
        ends, edges = np.concatenate([i, j]), np.tile(np.arange(len(i)), 2)
        return component_scores(ends, edges, np.ones(len(ends)), np.bincount(i, minlength=n).astype(float))
    teleport = np.full(n, 1.0 / max(n, 1)) if bias is None or bias.sum() == 0 else bias / bias.sum()
    if threshold is None:
        own = np.bincount(row, x * x, minlength=n)
        terms = int(term.max(initial=-1)) + 1
        # the matrix has 1 on its diagonal, whatever a row's own product
        times = lambda y: np.bincount(row, x * np.bincount(term, x * y[row], minlength=terms)[term], minlength=n) + (1 - own) * y
    else:
        times = lambda y: np.bincount(i, y[j], minlength=n).astype(float)
    total = times(np.ones(n))
    lost = total == 0
    share = np.where(lost, 1.0, total)
    return iterate(lambda v: times(np.where(lost, 0.0, v / share)), n, teleport, lost, damping, steps, tolerance)


def component_labels(joined: np.ndarray) -> np.ndarray:
    """The smallest member of each row's component, by spreading minima over a boolean matrix."""
    label = np.arange(len(joined))
    while True:
        low = np.minimum(label, np.where(joined, label[None, :], len(joined)).min(1, initial=len(joined)))
        low = np.minimum(low, low[low])
        if (low == label).all():
            return label
        label = low


def scores_of(matrix: np.ndarray, method: str, bias: np.ndarray | None = None, damping=0.85, steps=50, threshold: float | None = None, tolerance=0.0) -> np.ndarray:
    """Scores of one document's similarity matrix; method: damped or undamped (by component, sum n)."""
    m = matrix if threshold is None else (matrix > threshold).astype(float)
    total = m.sum(1)
    if method == "undamped":
        label = component_labels(m != 0)
        size, mass = np.bincount(label, minlength=len(m)), np.bincount(label, total, minlength=len(m))
        return np.where(mass[label] > 0, total * size[label] / np.where(mass[label] > 0, mass[label], 1), 1.0)
    p = m / np.where(total == 0, 1.0, total)[:, None]
    n = len(m)
    teleport = np.full(n, 1.0 / n) if bias is None or bias.sum() == 0 else bias / bias.sum()
    return power_iteration(p, teleport, damping, steps, tolerance)


#: Entries of documents whose shares are iterated together.
TOGETHER = 200_000


def damped_scores(found: list[tuple], biased: bool = False, damping=0.85, steps=50, tolerance=0.0) -> np.ndarray:
    """`sparse_scores`, damped and without a threshold, of several documents at once, one after the other: found has (row, term,
    x, n, share) of each. A step is a few array operations for all of them, and a document that has settled takes no
    more steps, so small documents cost what their entries cost and not a call each a step."""
    n = np.array([f[3] for f in found], dtype=np.int64)
    first = np.cumsum(n) - n
    terms = np.array([int(f[1].max(initial=-1)) + 1 for f in found], dtype=np.int64)
    row = np.concatenate([f[0] + k for f, k in zip(found, first)]).astype(np.int64)
    term = np.concatenate([f[1] + k for f, k in zip(found, np.cumsum(terms) - terms)]).astype(np.int64)
    x = np.concatenate([f[2] for f in found])
    doc = np.repeat(np.arange(len(found)), n)
    teleport = 1.0 / np.maximum(n, 1)[doc]
    if biased:
        share = np.concatenate([f[4] for f in found])
        sums = np.bincount(doc, share, minlength=len(found))[doc]
        teleport = np.where(sums == 0, teleport, share / np.where(sums == 0, 1.0, sums))
    rest = 1 - np.bincount(row, x * x, minlength=len(doc))
    times = lambda y: np.bincount(row, x * np.bincount(term, x * y[row])[term], minlength=len(y)) + rest * y
    total = times(np.ones(len(doc)))
    v = 1.0 / np.maximum(n, 1)[doc]
    scores, at, alive = np.zeros(len(doc)), np.arange(len(doc)), np.ones(len(found), dtype=bool)
    for _ in range(steps):
        lost = total == 0
        gone = np.bincount(doc, np.where(lost, v, 0.0), minlength=len(found))[doc]
        new = damping * (times(np.where(lost, 0.0, v / np.where(lost, 1.0, total))) + gone * teleport) + (1 - damping) * teleport
        still = ~(np.bincount(doc, np.abs(new - v), minlength=len(found)) < tolerance * n)
        v = new
        if not still[alive].all():
            ended = (alive & ~still)[doc]
            scores[at[ended]] = v[ended]
            alive &= still
            if not alive.any():
                return scores
            if 2 * alive[doc].sum() < len(doc):  # what has settled is taken out
                keep, of_entry = alive[doc], alive[doc][row]
                number = np.cumsum(keep) - 1
                row, x = number[row[of_entry]], x[of_entry]
                _, term = np.unique(term[of_entry], return_inverse=True)
                doc, teleport, rest, total, v, at = doc[keep], teleport[keep], rest[keep], total[keep], v[keep], at[keep]
    keep = alive[doc]
    scores[at[keep]] = v[keep]
    return scores


def _together(unit: DataFrame, sents: DataFrame, bias: DataFrame | None, options: dict) -> DataFrame:
    """(doc_id, sent_ix, score): `damped_scores` of documents, up to TOGETHER entries at a time."""
    ship(sents.sparkSession)
    key, biased = sents.schema["doc_id"].dataType.simpleString(), bias is not None

    def run(batches, read):
        for batch in batches:
            held, ids, size = [], [], 0

            def flush():
                score = damped_scores([f[1:] for f in held], biased, **options)
                names = batch.column(0).take(pa.array(np.repeat(ids, [len(f[0]) for f in held])))
                return pa.RecordBatch.from_arrays([names, pa.array(np.concatenate([f[0] for f in held]), type=pa.int32()), pa.array(score)], names=["doc_id", "sent_ix", "score"])

            for k, at, row, term, x, share in read(batch):
                held.append((at, row, term, x, len(at), share))
                ids.append(k)
                size += len(x) + len(at)
                if size > TOGETHER:
                    yield flush()
                    held, ids, size = [], [], 0
            if held:
                yield flush()

    return _mapped(unit, sents, bias, run, f"doc_id {key}, sent_ix int, score double")


def per_document(unit: DataFrame, sents: DataFrame, method: str = "damped", bias: DataFrame | None = None, **options) -> DataFrame:
    """(doc_id, sent_ix, score) with one kernel call for each document, or for many where no threshold makes pairs; bias: (doc_id,
    sent_ix, share)."""
    if method == "damped" and options.get("threshold") is None:
        return _together(unit, sents, bias, {k: v for k, v in options.items() if k != "threshold"})
    biased = bias is not None
    return _each_document(unit, sents, lambda row, term, x, n, share: [sparse_scores(row, term, x, n, method, share if biased else None, **options)], "score double", bias)


def per_document_edges(edges: DataFrame, sents: DataFrame, method: str = "damped", bias: DataFrame | None = None, **options) -> DataFrame:
    """As `per_document`, from edges (doc_id, i, j, sim), i <= j, of any metric; edges of a sentence to itself are given too."""
    ship(sents.sparkSession)
    rows = sents.select("doc_id", "sent_ix")
    rows = rows.join(bias, ["doc_id", "sent_ix"], "left") if bias is not None else rows.withColumn("share", F.lit(0.0))
    grouped = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sent_ix", F.coalesce("share", F.lit(0.0)).alias("share")))).alias("s"))
    grouped = grouped.join(edges.groupBy("doc_id").agg(F.collect_list(F.struct("i", "j", "sim")).alias("e")), "doc_id", "left")
    key = sents.schema["doc_id"].dataType.simpleString()
    biased = bias is not None

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                inner, found = batch.column(1)[k].values, batch.column(2)[k].values
                at = inner.field("sent_ix").to_numpy()
                m = np.zeros((len(at), len(at)))
                if found is not None:
                    i, j = (np.searchsorted(at, found.field(c).to_numpy()) for c in "ij")
                    m[i, j] = m[j, i] = found.field("sim").to_numpy()
                score = scores_of(m, method, inner.field("share").to_numpy() if biased else None, **options)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, 1).take(pa.array(np.zeros(len(at), dtype=np.int64))), inner.field("sent_ix"), pa.array(score)], names=["doc_id", "sent_ix", "score"]
                )

    return grouped.mapInArrow(run, f"doc_id {key}, sent_ix int, score double")


def bias_shares(tf: DataFrame, sents: DataFrame, bias_words: DataFrame) -> DataFrame:
    """(doc_id, sent_ix, share): counts of bias words over the sentence's words; a word listed twice counts twice.
    bias_words: (term) for all documents or (doc_id, term)."""
    keys = ["doc_id", "term"] if "doc_id" in bias_words.columns else ["term"]
    times = bias_words.groupBy(*keys).agg(F.count("*").alias("times"))
    hits = tf.join(F.broadcast(times) if keys == ["term"] else times, keys).groupBy("doc_id", "sent_ix").agg(F.sum(F.col("tf") * F.col("times")).alias("hits"))
    sizes = tf.groupBy("doc_id", "sent_ix").agg(F.sum("tf").alias("n"))
    return sents.select("doc_id", "sent_ix").join(sizes, ["doc_id", "sent_ix"], "left").join(hits, ["doc_id", "sent_ix"], "left").select(
        "doc_id", "sent_ix", F.coalesce(F.col("hits") / F.col("n"), F.lit(0.0)).alias("share")
    )


def bias_by_vectors(vectors: DataFrame, bias: DataFrame) -> DataFrame:
    """(doc_id, sent_ix, share): cosine of each sentence's vector with the mean of the bias vectors, none below 0.
    vectors (doc_id, sent_ix, embedding); bias (embedding), of which one row, the mean, is broadcast."""
    parts = bias.select(F.posexplode("embedding").alias("k", "e")).groupBy("k").agg(F.avg(F.col("e").cast("double")).alias("e"))
    mean = parts.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "e"))), lambda y: y["e"]).alias("b"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    v, b = F.col("embedding"), F.col("b")
    norm = F.sqrt(dot(v, v) * dot(b, b))
    share = F.when(norm > 0, F.greatest(dot(v, b) / norm, F.lit(0.0))).otherwise(0.0)
    return vectors.crossJoin(F.broadcast(mean)).select("doc_id", "sent_ix", share.alias("share"))
