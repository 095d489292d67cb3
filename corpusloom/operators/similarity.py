"""Sentence graphs: edges between sentences of one document, from an inverted index, so no zero pair is ever made."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.operators.centrality import each_pair, product_blocks
from corpusloom.runtime import ship

#: Rows of a block of vectors, and products of a cell that are held at a time.
BLOCK_ROWS, CELL = 8_192, 4_000_000
#: Components of word vectors up to which they are broadcast, a quarter of a GB.
BROADCAST_COMPONENTS = 64_000_000

METRICS = ("idf_mod_cosine", "common_words", "word2vec_sim", "bert_sim")


def _pairs(x: DataFrame) -> DataFrame:
    a, b = x.alias("a"), x.alias("b")
    return a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.sent_ix") < F.col("b.sent_ix")))


def cosine_edges(unit: DataFrame) -> DataFrame:
    """(doc_id, i, j, sim), i < j: idf-modified cosine of unit vectors."""
    keys = [F.col("a.doc_id").alias("doc_id"), F.col("a.sent_ix").alias("i"), F.col("b.sent_ix").alias("j")]
    return _pairs(unit).groupBy(*keys).agg(F.sum(F.col("a.x") * F.col("b.x")).alias("sim"))


def document_edges(unit: DataFrame, sents: DataFrame) -> DataFrame:
    """`cosine_edges`, each document by itself: its entries are shuffled, its pairs aren't. unit: unit vectors (.., x) or weights
    (.., w); sents: at least the sentences (doc_id, sent_ix) that have any."""

    def kernel(row, term, x, n):
        for low, block in product_blocks(row, term, x, n):
            i, j = np.nonzero(block)
            i, j = i[later := j > i + low], j[later]
            yield i + low, j, block[i, j]

    return each_pair(unit, sents, kernel, "sim")


def document_markov(unit: DataFrame, sents: DataFrame, threshold: float | None = None, digits: int = 9) -> DataFrame:
    """`markov` of all sentences' cosines and their edges of 1 to themselves, each document by itself. A row lies in
    one block, and so does its sum; above a threshold, cosines have so many digits."""
    if threshold is not None and not 0 <= threshold < 1:
        raise ValueError("the threshold is in [0, 1)")

    def kernel(row, term, x, n):
        for low, block in product_blocks(row, term, x, n):
            block[np.arange(len(block)), low + np.arange(len(block))] = 1.0
            if threshold is not None:
                block = (np.round(block, digits) > threshold).astype(float)
            total = block.sum(1)
            i, j = np.nonzero(block)
            yield i + low, j, block[i, j] / total[i]

    return each_pair(unit, sents, kernel, "p")


def common_word_edges(tf: DataFrame) -> DataFrame:
    """(doc_id, i, j, sim), i < j: counts of shared words over the logarithms of both lengths; 1 for two equal sentences
    of one word, 0 (no edge) for unequal ones."""

    def kernel(row, term, x, n):
        size = np.bincount(row, x, minlength=n)
        log = np.log10(np.where(size > 0, size, 1.0))
        one = np.ones(len(x))
        for (low, a), (_, b) in zip(product_blocks(row, term, x, n, one), product_blocks(row, term, one, n, x)):
            shared = a + b
            i, j = np.nonzero(shared)
            i, j = i[later := j > i + low], j[later]
            norm = log[i + low] + log[j]
            yield i + low, j, np.where(norm == 0, 1.0, shared[i, j] / np.where(norm == 0, 1.0, norm))

    # counts take the place of unit vectors: they aren't divided by a norm
    counts = tf.select("doc_id", "sent_ix", "term", F.col("tf").cast("double").alias("x"))
    return each_pair(counts, counts.select("doc_id", "sent_ix").limit(0), kernel, "sim")


def vector_edges(vectors: DataFrame, group: str, id_: str, vector: str, at_least: float) -> DataFrame:
    """(group, i, j, sim), i < j: cosine of given vectors within a group (word or sentence embeddings)."""
    ship(vectors.sparkSession)
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = vectors.select(F.col(group).alias("g"), F.col(id_).alias("id"), F.col(vector).alias("v"), norm.alias("norm")).filter("norm > 0 AND g IS NOT NULL AND id IS NOT NULL")
    # a group is dealt to blocks by id; each two of its blocks meet in a cell, and pairs leave it only above the threshold
    sizes = unit.groupBy("g").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")).filter("blocks > 1")  # few groups
    dealt = unit.join(F.broadcast(sizes), "g", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("g", "id", "v", "norm", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    names = [group, "i", "j", "sim"]
    kind = lambda c: unit.schema[c].dataType.simpleString()

    def cell(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        lists, own = rows.column("v").combine_chunks(), rows.column("own").to_numpy()
        p, q = rows.column("p")[0].as_py(), rows.column("q")[0].as_py()
        length, norm, ids = np.asarray(lists.value_lengths()), rows.column("norm").to_numpy(), rows.column("id").to_numpy()
        left, right = [], []
        for size in np.unique(length):
            a, b = (np.flatnonzero((length == size) & (own == k)) for k in (p, q))
            x, y = (lists.take(pa.array(k)).flatten().to_numpy().astype(float).reshape(len(k), size) for k in (a, b))
            step = max(1, CELL // max(len(b), 1))
            for low in range(0, len(a), step):
                some = a[low : low + step]
                sim = x[low : low + step] @ y.T / (norm[some][:, None] * norm[b])
                i, j = np.nonzero(~(sim < at_least))
                ordered = ids[some[i]] < ids[b[j]] if p == q else ids[some[i]] != ids[b[j]]
                i, j = i[ordered], j[ordered]
                left.append((some[i], b[j]))
                right.append(sim[i, j])
        i, j = (np.concatenate([pair[k] for pair in left]) for k in (0, 1))
        turned = ids[i] > ids[j]
        i, j = np.where(turned, j, i), np.where(turned, i, j)
        take = lambda c, k: rows.column(c).take(pa.array(k))
        return pa.table([take("g", i), take("id", i), take("id", j), pa.array(np.concatenate(right))], names=names)

    return dealt.groupBy("g", "p", "q").applyInArrow(cell, f"{group} {kind('g')}, i {kind('id')}, j {kind('id')}, sim double")


def both_ways(edges: DataFrame, sents: DataFrame) -> DataFrame:
    """(doc_id, i, j, sim) with both directions and each sentence's edge of 1 to itself."""
    back = edges.select("doc_id", F.col("j").alias("i"), F.col("i").alias("j"), "sim")
    own = sents.select("doc_id", F.col("sent_ix").alias("i"), F.col("sent_ix").alias("j"), F.lit(1.0).alias("sim"))
    return edges.select("doc_id", "i", "j", "sim").unionByName(back).unionByName(own)


def markov(matrix: DataFrame, threshold: float | None = None) -> DataFrame:
    """(doc_id, i, j, p): similarities over their row's sum, or, above a threshold, one over the row's degree."""
    if threshold is not None and not 0 <= threshold < 1:
        raise ValueError("the threshold is in [0, 1)")
    m = matrix if threshold is None else matrix.filter(F.col("sim") > threshold).withColumn("sim", F.lit(1.0))
    total = m.groupBy("doc_id", "i").agg(F.sum("sim").alias("total"))
    return m.join(total, ["doc_id", "i"]).select("doc_id", "i", "j", (F.col("sim") / F.when(F.col("total") == 0, 1.0).otherwise(F.col("total"))).alias("p"))


#: Components that are summed in one row of an aggregation.
COMPONENTS = 64


def sentence_vectors(weighted: DataFrame, vectors: DataFrame) -> DataFrame:
    """(doc_id, sent_ix, v): the sum of tf * idf * vector over a sentence's words; weighted (.., term, w), vectors (term,
    embedding), all of one size. A word's vector is one row for each COMPONENTS components, each a sum of its own, so
    aggregation stays map-side and words aren't multiplied by their vectors' size."""
    size = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    parts = max(1, -(-size // COMPONENTS))
    if vectors.count() * size <= BROADCAST_COMPONENTS:  # rows of a document are dealt out once, without vectors, and summed where they lie
        weighted, vectors = weighted.select("doc_id", "sent_ix", "term", "w").repartition("doc_id"), F.broadcast(vectors)
    x = weighted.join(vectors, "term").select("doc_id", "sent_ix", "w", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "embedding")
    component = lambda k: F.get("embedding", F.col("part") * COMPONENTS + k).cast("double")
    names = [f"s{k}" for k in range(min(size, COMPONENTS))]
    sums = x.groupBy("doc_id", "sent_ix", "part").agg(*[F.sum(F.col("w") * component(k)).alias(n) for k, n in enumerate(names)] or [F.count("*").alias("n")])
    own = F.array(*names) if names else F.array().cast("array<double>")
    if parts == 1:
        return sums.select("doc_id", "sent_ix", own.alias("v"))
    whole = sums.groupBy("doc_id", "sent_ix").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", own.alias("v")))), lambda y: y["v"])).alias("v"))
    return whole.select("doc_id", "sent_ix", F.slice("v", 1, size).alias("v"))


def word_vector_edges(weighted: DataFrame, vectors: DataFrame, at_least: float = 0.0) -> DataFrame:
    """(doc_id, i, j, sim): cosine of the sentences' weighted word vectors."""
    return vector_edges(sentence_vectors(weighted, vectors), "doc_id", "sent_ix", "v", at_least)


def pair_similarity(pairs: DataFrame, idf: DataFrame, default: float) -> DataFrame:
    """pairs (id, a, b: token arrays) -> (id, sim): idf-modified cosine of two sentences each."""
    tf = lambda c, n: pairs.select("id", F.explode(c).alias("term")).groupBy("id", "term").agg(F.count("*").alias(n))
    both = tf("a", "x").join(tf("b", "y"), ["id", "term"], "full").join(idf.select("term", "idf"), "term", "left")
    w = F.coalesce("idf", F.lit(float(default)))
    x, y = F.coalesce("x", F.lit(0)) * w, F.coalesce("y", F.lit(0)) * w
    sums = both.groupBy("id").agg(F.sum(x * y).alias("o"), F.sum(x * x).alias("p"), F.sum(y * y).alias("q"))
    return pairs.select("id").join(sums, "id", "left").select("id", F.when((F.col("o") > 0), F.col("o") / F.sqrt(F.col("p") * F.col("q"))).otherwise(0.0).alias("sim"))
