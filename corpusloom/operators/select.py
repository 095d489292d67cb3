"""Rank, top-k, fraction, random choice, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Default sizes of the summarizers.
DEFAULT_SIZES = {"textrank": 4, "lexrank": 8, "lexrank_single_file": 0.5, "biased_lexrank": 9, "random_sentence": 6}


def rank_sentences(scores: DataFrame, digits: int = 6) -> DataFrame:
    """Add rn, the rank by rounded score; of ties the later sentence comes first."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), F.desc("sent_ix"))
    return scores.withColumn("score", F.round("score", digits)).withColumn("rn", F.row_number().over(w))


def summaries(ranked: DataFrame, sents: DataFrame, size: int | float | None = None) -> DataFrame:
    """(doc_id, summary). An integer takes the best so many in rank order; a fraction keeps the document's order and
    leaves an empty string in each other place; None takes all in rank order."""
    if size is not None and (isinstance(size, bool) or not isinstance(size, (int, float))):
        raise TypeError("size is an integer, a fraction or None")
    rows = ranked.join(sents, ["doc_id", "sent_ix"])
    if isinstance(size, float):
        n = F.count("*").over(Window.partitionBy("doc_id"))
        rows = rows.withColumn("sent", F.when(F.col("rn") <= F.floor(n * F.lit(size)), F.col("sent")).otherwise(""))
        order = "sent_ix"
    else:
        rows = rows.filter(F.col("rn") <= size) if size is not None else rows
        order = "rn"
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("sent").alias("s"))))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["s"]), " ").alias("summary"))


def summary_of(scores: Column, sents: Column, size: int | float | None = None, digits: int = 6) -> Column:
    """`summaries` of `rank_sentences` in one row, of the lists of a document's scores and sentences; null where there is none."""
    if size is not None and (isinstance(size, bool) or not isinstance(size, (int, float))):
        raise TypeError("size is an integer, a fraction or None")
    ranked = F.sort_array(F.transform(scores, lambda s, i: F.struct(F.round(s, digits).alias("s"), i.alias("i"))), asc=False)
    at = F.transform(ranked, lambda x: x["i"])
    if isinstance(size, float):
        kept = F.slice(at, F.lit(1), F.floor(F.size(at) * F.lit(size)).cast("int"))
        return F.array_join(F.transform(sents, lambda s, i: F.when(F.array_contains(kept, i), s).otherwise("")), " ")
    at = F.slice(at, 1, max(size, 0)) if size is not None else at
    return F.array_join(F.transform(at, lambda i: F.get(sents, i)), " ")


def arithmetic_hash(*columns: Column, seed: int = 1) -> Column:
    """A hash by plain arithmetic, the same in any engine."""
    h = F.lit(seed).cast("long")
    for c in columns:
        h = (h * 7919 + c.cast("long") * 104729 + 12553) % 1000003
    return h


def random_sentences(sents: DataFrame, k: int = 6, seed: int = 1) -> DataFrame:
    """k sentences per document without replacement, in the order of the draw: (doc_id, sent_ix, sent, rn)."""
    w = Window.partitionBy("doc_id").orderBy("_h", "sent_ix")
    drawn = sents.withColumn("_h", arithmetic_hash(F.col("doc_id"), F.col("sent_ix"), seed=seed)).withColumn("rn", F.row_number().over(w))
    return drawn.filter(F.col("rn") <= k).drop("_h")


def seeded_split(rows: DataFrame, shares: list[float], seed: int = 1, key: str = "doc_id") -> DataFrame:
    """Add part (0, 1, ...): lengths are round(N * share), the last part takes the rest; shares of 1 or more are percent.

    Ranks are taken by range-sorted blocks of the hash, so no window holds all rows."""
    shares = [s / 100 if max(shares) >= 1 else s for s in shares]
    if len(shares) not in (2, 3) or abs(sum(shares) - 1) > 1e-9:
        raise ValueError("two or three shares that sum to 1")
    rows = rows.withColumn("_h", arithmetic_hash(F.col(key), seed=seed))
    # cumulative counts over the hash's 1,000,003 values cut to 4,096 blocks: a bounded window
    rows = rows.withColumn("_b", F.floor(F.col("_h") / 245).cast("int"))
    counts = rows.groupBy("_b").agg(F.count("*").alias("c"))
    before = counts.withColumn("before", F.sum("c").over(Window.orderBy("_b")) - F.col("c")).drop("c")
    total = counts.agg(F.sum("c").alias("total"))
    ranked = rows.join(F.broadcast(before), "_b").crossJoin(F.broadcast(total))
    ranked = ranked.withColumn("_r", F.col("before") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)))
    part, edge = F.lit(len(shares) - 1), F.lit(0)
    cuts = []
    for s in shares[:-1]:
        edge = edge + F.bround(F.col("total") * F.lit(s)).cast("long")
        cuts.append(edge)
    for k in range(len(cuts) - 1, -1, -1):
        part = F.when(F.col("_r") <= cuts[k], F.lit(k)).otherwise(part)
    return ranked.withColumn("part", part).drop("_h", "_b", "_r", "before", "total")
