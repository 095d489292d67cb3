"""Near-duplicates among the next rows of a category, by a fuzzy ratio of a slice of both texts."""

from __future__ import annotations

import math
from collections import Counter
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.runtime import settle, ship


def fuzzy_ratio(a: str, b: str, compat: bool = False) -> int:
    """0 to 100, twice the matching characters over both lengths. compat: of texts of 200 characters and more, characters
    that make up over a hundredth of the second one start no match (the standard library's default), as in scores that
    were made that way; such scores are lower, often by far, for long texts that differ in few places."""
    return round(100 * SequenceMatcher(None, a, b, autojunk=compat).ratio()) if a or b else 0


def ratio_bound(a: Column, b: Column) -> Column:
    """At least the fuzzy ratio, whatever the order of characters: twice what both hold of each character over both lengths.
    Without characters in common there is no match, so pairs below a threshold needn't be matched."""
    letters = F.array_union(F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, "")))
    times = lambda text, c: F.char_length(text) - F.char_length(F.replace(text, c, F.lit("")))
    shared = F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0), lambda s, c: s + F.least(times(a, c), times(b, c)))
    return 200.0 * shared / F.greatest(F.char_length(a) + F.char_length(b), F.lit(1))


def candidates(rows: DataFrame, category: str, order: str, text: str = "text", reach: int = 9, skip_last: bool = False) -> DataFrame:
    """(category, ix, jx, a, b): each row with the next `reach` rows of its category; ix counts from 0.

    Rows are numbered per category; each row is copied to its nine offsets and meets its neighbours in an equi-join on
    (category, place), so a hot category spreads over its places."""
    from pyspark.sql import Window

    w = Window.partitionBy(category).orderBy(order)
    d = rows.select(F.col(category).alias("category"), F.col(text).alias("t"), (F.row_number().over(w) - 1).alias("ix"))
    left = d.select("category", "ix", F.col("t").alias("a"), F.explode(F.sequence(F.col("ix") + 1, F.col("ix") + reach)).alias("jx"))
    out = left.join(d.select("category", F.col("ix").alias("jx"), F.col("t").alias("b")), ["category", "jx"])
    if skip_last:
        n = d.groupBy("category").agg(F.max("ix").alias("last"))
        out = out.join(n, "category").filter("jx < last").drop("last")
    return out.select("category", "ix", "jx", "a", "b")


#: Rows of a category that are compared in one place; the first `reach` rows of a block are copied to the one before.
BLOCK = 512


def _placed(rows: DataFrame, category: str, order: str) -> DataFrame:
    """(category, ix, last, n, half): rows numbered from 0 in their category, by the place in a range-partitioned sort and the sizes of the
    partitions before, so no category is sorted in one task. last: the number of the category's last row."""
    from pyspark.sql import Window

    d = rows.filter(F.col(category).isNotNull()).select(F.col(category).alias("category"), F.col(order).alias("o"), "n", "half")
    d = d.repartitionByRange("category", "o").sortWithinPartitions("category", "o")
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    d = settle(d.select("category", "n", "half", F.spark_partition_id().alias("part"), at.alias("at")), "placed")
    # one row for each category of each partition, which is a range: about as many as partitions and categories
    sizes = settle(d.groupBy("category", "part").agg(F.min("at").alias("low"), F.count("*").alias("m")), "place-sizes")
    w = Window.partitionBy("category")
    shift = F.sum("m").over(w.orderBy("part")) - F.col("m") - F.col("low")
    sizes = sizes.select("category", "part", shift.alias("shift"), (F.sum("m").over(w) - 1).alias("last"))
    return d.join(F.broadcast(sizes), ["category", "part"]).select("category", (F.col("at") + F.col("shift")).cast("int").alias("ix"), F.col("last").cast("int").alias("last"), "n", "half")


def _common(x: str, y: str) -> int:
    """The length of the longest common subsequence; a row of its table is one integer, as in `rouge.plain_hits`."""
    at: dict = {}
    for j, c in enumerate(y):
        at[c] = at.get(c, 0) | 1 << j
    full = (1 << len(y)) - 1
    row = full
    for c in x:
        if m := at.get(c):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(y) - row.bit_count()


def may_reach(x: str, y: str, wanted: float) -> bool:
    """False if the matching characters of texts of one length are surely less than wanted. Matches are in order on both sides, so
    they are a common subsequence; one that leaves out d characters matches places at most d apart, which a part of the
    texts often rules out."""
    if x == y:
        return len(x) >= wanted
    there = Counter(y)
    if sum(min(m, there[c]) for c, m in Counter(x).items()) < wanted:
        return False
    d = math.floor(len(x) - wanted)
    k = 5 * d + 5
    if k + d < len(x) and k - _common(x[:k], y[: k + d]) > d:
        return False
    return _common(x, y) >= wanted


def near_duplicates(rows: DataFrame, category: str, order: str, text: str = "text", above: int = 92, skip_last: bool = False, compat: bool = False, reach: int = 9) -> DataFrame:
    """(category, ix, jx, ratio) of the neighbours above the threshold; the earlier row is the one to remove. compat: see
    `fuzzy_ratio`. Pairs whose common characters or common subsequence alone rule the threshold out are dropped before any matching.

    Compared is the part of both texts from 40 to 50 % of the shorter one's length, which lies in a text's first half: only
    that half and the length are shuffled, by blocks of neighbours, and pairs are made where a block lies."""
    ship(rows.sparkSession)
    n = F.char_length(text)
    placed = _placed(rows.select(category, order, n.alias("n"), F.substring(F.col(text), F.lit(1), F.ceil(n / 2).cast("int") + 1).alias("half")), category, order)
    own, size = F.floor(F.col("ix") / max(BLOCK, reach)).cast("int"), max(BLOCK, reach)
    early = (F.col("ix") % size < reach) & (F.col("ix") >= size)
    dealt = placed.withColumn("block", F.explode(F.when(early, F.array(own, own - 1)).otherwise(F.array(own))))
    kind = placed.schema["category"].dataType.simpleString()

    def run(batches):
        at, before = None, []
        for batch in batches:
            category, block, ix, last = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            where, left, right, ratio = [], [], [], []
            for k, (name, n, half) in enumerate(zip(category.to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                if at != (name, block[k]):
                    at, before = (name, block[k]), []
                before = [b for b in before if ix[k] - b[0] <= reach]
                for i, m, other in before if n is not None and not (skip_last and ix[k] == last[k]) else ():
                    short = min(m, n)
                    x, y = (s[round(short * 0.4) : round(short * 0.5)] for s in (other, half))
                    if may_reach(x, y, len(x) * (above + 0.5) / 100 - 1e-6) and (r := fuzzy_ratio(x, y, compat)) > above:
                        where.append(k)
                        left.append(i)
                        right.append(ix[k])
                        ratio.append(r)
                if n is not None and ix[k] // size == block[k]:
                    before.append((ix[k], n, half))
            yield pa.RecordBatch.from_arrays([category.take(pa.array(where, type=pa.int64())), *[pa.array(c, type=pa.int32()) for c in (left, right, ratio)]], names=["category", "ix", "jx", "ratio"])

    dealt = dealt.select("category", "block", "ix", "last", "n", "half").repartition("category", "block").sortWithinPartitions("category", "block", "ix")
    return dealt.mapInArrow(run, f"category {kind}, ix int, jx int, ratio int")


def remove_near_duplicates(rows: DataFrame, category: str, order: str, text: str = "text", above: int = 92, skip_last: bool = False, compat: bool = False) -> DataFrame:
    """The rows without those that one of their next neighbours is alike to; a row of the category's end stays."""
    from pyspark.sql import Window

    own = "_ix" if "_ix" not in rows.columns else "_ix_" + "_".join(rows.columns)
    numbered = rows.withColumn(own, F.row_number().over(Window.partitionBy(category).orderBy(order)) - 1)
    gone = near_duplicates(rows, category, order, text, above, skip_last, compat).select(F.col("category").alias("_c"), F.col("ix").alias("_i")).distinct()
    return numbered.join(gone, (F.col(category).eqNullSafe(F.col("_c"))) & (F.col(own) == F.col("_i")), "left_anti").drop(own)


def kept_shares(rows: DataFrame, category: str, order: str, text: str = "text", above: int = 92, skip_last: bool = False) -> DataFrame:
    """(category, n, removed, kept_share to four digits)."""
    counts = rows.groupBy(F.col(category).alias("category")).agg(F.count("*").alias("n"))
    gone = near_duplicates(rows, category, order, text, above, skip_last).select("category", "ix").distinct().groupBy("category").agg(F.count("*").alias("removed"))
    removed = F.coalesce("removed", F.lit(0)).cast("long")
    return counts.join(gone, "category", "left").select("category", "n", removed.alias("removed"), F.round((F.col("n") - removed) / F.col("n"), 4).alias("kept_share"))
