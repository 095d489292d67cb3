"""Ranked lexical search over inverted treaps.

Documents are indexed where they lie: one pass counts, of each document, its terms and how often it holds each term of
the queries; the counts are written to the shared folder, and the corpus statistics are sums over them. No token and no
posting is shuffled. Each task then takes its documents in shards of a bounded number of documents and postings. In a
shard each term has a treap: a search tree by document, a heap by the term's impact, so that the impact at the top of
a subtree bounds all in it. A query goes through the treaps of its terms at once, from ranges of documents with the
highest bound on: a range has, for each term, the top node inside it; the sum of their weighted impacts bounds every score
in the range. A range is dropped when its bound lies below the score of the k-th best document so far (an equal one may
still hold a smaller id); else the document at the node that weighs most is scored by searching all treaps for it,
and the range is cut in two there. The k best of a task carry over to its next shards, and the tasks' lists,
at most k rows for a query and task, are merged by a window over queries. Nothing is approximate.

Impacts in heap order are rounded up to one of LEVELS steps of the term's greatest one, equal steps are ordered by a hash:
a treap of equal impacts stays shallow, and bounds stay bounds.

Queries come in blocks of at most some `block_terms` terms, whose vocabulary every task holds; documents are read once
for each block.

Defined results: null and empty texts have no term; a query without terms finds nothing; a null query id or document id
is not ranked (the document still counts in the statistics); repeated document rows are documents of their own;
rows of one query id each give a list of their own ranks, so a repeated query gives repeated rows; equal scores go by
ascending document id; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from corpusloom.runtime import settle, ship, table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)
#: Steps to which impacts are rounded up in heap order.
LEVELS = 64
#: Ranges of one query that are cut at a time.
RANGES = 256


@dataclass(frozen=True)
class Options:
    """k: documents for a query. shard_docs, shard_postings: the most a shard holds before its treaps are built (a document
    is never split). block_terms: about as many terms of queries are searched at a time."""

    k: int = 20
    shard_docs: int = 16_384
    shard_postings: int = 2_000_000
    block_terms: int = 100_000


def term_counts(text: str | None) -> Counter:
    return Counter(m.group() for m in TERM.finditer((text or "").translate(_FOLD)))


def _postings(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(doc_id, n, term, tf): of each document its number of terms, and numbers and counts of those in the vocabulary."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a block's terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            n, term, tf = [], [], []
            for text in batch.column(1):
                found = term_counts(text.as_py())
                n.append(sum(found.values()))
                some = sorted((known[t], c) for t, c in found.items() if t in known)
                term.append([t for t, _ in some])
                tf.append([c for _, c in some])
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(term, ints), pa.array(tf, ints)], names=["doc_id", "n", "term", "tf"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, n long, term array<int>, tf array<int>")


class Treaps:
    """The treaps of all terms of a shard. Nodes are postings in order of (term, document); the last node stands for none."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
        order = np.lexsort((doc, term))
        doc, term, impact = doc[order], term[order], impact[order]
        self.none = none = len(doc)
        self.doc = np.append(doc, -1).astype(np.int64)
        self.impact = np.append(impact, 0)
        firsts = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if none else np.zeros(0, dtype=np.int64)
        most = np.repeat(np.maximum.reduceat(impact, firsts) if none else impact, np.diff(np.append(firsts, none)))
        level = -(-impact * LEVELS // np.maximum(most, 1))
        self.bound = np.append(-(-level * most // LEVELS), 0)
        mixed = (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        heat = ((level.astype(np.int64) << 31) | mixed.astype(np.int64)).tolist()
        left, right = [none] * (none + 1), [none] * (none + 1)
        self.root: dict[int, int] = {}
        ends = np.append(firsts[1:], none).tolist()
        for first, end in zip(firsts.tolist(), ends, strict=True):
            path = [first]  # from the root along right children
            for p in range(first + 1, end):
                h, below = heat[p], none
                while path and heat[path[-1]] < h:
                    below = path.pop()
                left[p] = below
                if path:
                    right[path[-1]] = p
                path.append(p)
            self.root[int(term[first])] = path[0]
        self.left, self.right = np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)

    def top_in(self, nodes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each range (row) and term (column), the top node of the range below the given node."""
        nodes = nodes.copy()
        at = np.flatnonzero(nodes.ravel() != self.none)
        flat, row = nodes.reshape(-1), at // nodes.shape[1]
        while len(at):
            node = flat[at]
            here = self.doc[node]
            before, after = here < low[row], here > high[row]
            out = before | after
            at, row = at[out], row[out]
            node = np.where(before[out], self.right[node[out]], self.left[node[out]])
            flat[at] = node
            some = node != self.none
            at, row = at[some], row[some]
        return nodes

    def search(self, roots: np.ndarray, weights: np.ndarray, n_docs: int, best: tuple[np.ndarray, np.ndarray], ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, document ids) of the k best among `best` and this shard's documents, whose ids ascend with their numbers."""
        score, doc_id = best
        nodes, low, high = roots[None, :], np.zeros(1, dtype=np.int64), np.full(1, n_docs - 1)
        bound = (self.bound[nodes] * weights).sum(axis=1)
        while True:
            least = score[-1] if len(score) == k else 1
            able = bound >= least
            if not able.all():
                nodes, low, high, bound = nodes[able], low[able], high[able], bound[able]
            if not len(bound):
                return score, doc_id
            if len(bound) > RANGES:
                part = np.argpartition(-bound, RANGES)
                now, later = part[:RANGES], part[RANGES:]
            else:
                now, later = np.arange(len(bound)), np.zeros(0, dtype=np.int64)
            own, lo, hi = nodes[now], low[now], high[now]
            pivot = self.doc[own[np.arange(len(now)), (self.bound[own] * weights).argmax(axis=1)]]
            at = self.top_in(own, pivot, pivot)
            found = (self.impact[at] * weights).sum(axis=1)
            some = found >= least
            if some.any():
                score, doc_id = np.append(score, found[some]), np.append(doc_id, ids[pivot[some]])
                order = np.lexsort((doc_id, -score))[:k]
                score, doc_id = score[order], doc_id[order]
            lows, highs = np.concatenate([lo, pivot + 1]), np.concatenate([pivot - 1, hi])
            cut = self.top_in(np.concatenate([own, own]), lows, highs)
            nodes = np.concatenate([nodes[later], cut])
            low, high = np.concatenate([low[later], lows]), np.concatenate([high[later], highs])
            bound = np.concatenate([bound[later], (self.bound[cut] * weights).sum(axis=1)])


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    m = 100 - 25 + (25 * n * n_docs) // all_terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _shards(batches: Iterator[pa.RecordBatch], options: Options) -> Iterator[pa.Table]:
    held, docs, postings = [], 0, 0
    for batch in batches:
        step = max(1, options.shard_docs // 16)
        for part in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
            held.append(part)
            docs, postings = docs + part.num_rows, postings + len(part.column("term").flatten())
            if docs >= options.shard_docs or postings >= options.shard_postings:
                yield pa.Table.from_batches(held)
                held, docs, postings = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _search_block(docs: DataFrame, items: list, options: Options) -> DataFrame:
    """(number, doc_id, score): of each query, by its place in the list, at most k documents for each task."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for r in items for t in r["terms"]}))}
    found = settle(_postings(docs, vocabulary), "postings")
    n_docs, all_terms = found.filter("n > 0").agg(F.count("*"), F.sum("n")).first()
    df = {r[0]: r[1] for r in found.select(F.explode("term").alias("t")).groupBy("t").count().collect()}  # a block's terms at most
    queries = []
    for r in items:
        number = [vocabulary[t] for t in r["terms"]]
        queries.append((np.array(number), np.array([c * weight(n_docs or 0, df.get(t, 0)) for t, c in zip(number, r["counts"], strict=True)], dtype=np.int64)))
    sent = spark.sparkContext.broadcast(queries)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)) for _ in sent.value]
        for shard in _shards(batches, options):
            shard = shard.sort_by("doc_id").combine_chunks()
            ids, term = shard["doc_id"].to_numpy(), shard["term"].combine_chunks()
            sizes = np.asarray(term.value_lengths())
            doc = np.repeat(np.arange(len(ids)), sizes)
            tf, n = shard["tf"].combine_chunks().flatten().to_numpy().astype(np.int64), np.repeat(shard["n"].to_numpy(), sizes)
            treaps = Treaps(doc, term.flatten().to_numpy(), impacts(tf, n, n_docs, all_terms))
            for i, (terms, weights) in enumerate(sent.value):
                roots = np.array([treaps.root.get(int(t), treaps.none) for t in terms], dtype=np.int64)
                able = (roots != treaps.none) & (weights > 0)
                if able.any():
                    best[i] = treaps.search(roots[able], weights[able], len(ids), best[i], ids, options.k)
        number = np.repeat(np.arange(len(best), dtype=np.int32), [len(s) for s, _ in best])
        if len(number):
            score, doc_id = (np.concatenate([b[j] for b in best]) for j in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(doc_id), pa.array(score)], names=["number", "doc_id", "score"])

    return found.filter("doc_id IS NOT NULL AND size(term) > 0").mapInArrow(run, f"number int, doc_id {id_type}, score long")


def search(docs: DataFrame, items: DataFrame, options: Options = Options()) -> DataFrame:
    """docs (doc_id, text), items (item_id, text): item_id, rank, doc_id, score of the k best documents of each item."""
    spark = docs.sparkSession
    ship(spark)
    schemas = {"doc_id": docs.schema["doc_id"].dataType, "item_id": items.schema["item_id"].dataType}

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [term_counts(t.as_py()) for t in batch.column(1)]
            columns = [batch.column(0), pa.array([list(f) for f in found], pa.list_(pa.string())), pa.array([list(f.values()) for f in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "terms", "counts"])

    asked = items.select("item_id", "text").filter("item_id IS NOT NULL").mapInArrow(terms, f"item_id {schemas['item_id'].simpleString()}, terms array<string>, counts array<long>")
    asked = settle(asked.filter("size(terms) > 0"), "query-terms")
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-total // options.block_terms)
    out = spark.createDataFrame([], f"item_id {schemas['item_id'].simpleString()}, rank int, doc_id {schemas['doc_id'].simpleString()}, score long")
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()  # about block_terms terms
        if not rows:
            continue
        found = _search_block(docs, rows, options)
        order = Window.partitionBy("number").orderBy(F.desc("score"), "doc_id")
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= options.k)
        names = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(rows)], f"number int, item_id {schemas['item_id'].simpleString()}")
        out = out.unionByName(found.join(F.broadcast(names), "number").select("item_id", "rank", "doc_id", "score"))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = rf"regexp_extract_all(translate({{}}, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {_TERMS.format('text')} AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
q AS MATERIALIZED (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_TERMS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
tf AS MATERIALIZED (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term),
x AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms)) AS x FROM tf, s),
r AS (SELECT item_id, doc_id, sum(qtf * w * x)::BIGINT AS score FROM q JOIN w USING (term) JOIN x USING (term) GROUP BY ALL HAVING sum(qtf * w * x) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r
QUALIFY rank <= 20
"""
