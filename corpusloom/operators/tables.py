"""Filters, deduplication by key and grouped statistics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions import text as T

EMPTY_DOCUMENT = "Document is empty!"


def drop_nulls(rows: DataFrame, columns: Iterable[str]) -> DataFrame:
    return rows.na.drop(subset=list(columns))


def drop_sentinel(rows: DataFrame, column: str = "text", sentinel: str = EMPTY_DOCUMENT) -> DataFrame:
    return rows.filter(~F.col(column).eqNullSafe(F.lit(sentinel)))


def exclude_categories(rows: DataFrame, column: str, names: Iterable[str]) -> DataFrame:
    """Drop rows of these categories, spelled with underscores or spaces; rows without a category stay."""
    for name in names:
        for spelled in {name.replace(" ", "_"), name.replace("_", " ")}:
            rows = rows.filter(~F.col(column).eqNullSafe(F.lit(spelled)))
    return rows


def subset(rows: DataFrame, k: int, column: str = "subset") -> DataFrame:
    if column not in rows.columns:
        raise ValueError(f"there is no column {column}")
    return rows.filter(F.col(column) == k)


def valid_items(rows: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Rows with a value in every one of the columns."""
    return rows.na.drop(subset=list(columns))


def keep_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in the given order; by map-side aggregation, so a hot key costs no window."""
    others = [c for c in rows.columns if c != key]
    first = rows.groupBy(key).agg(F.min_by(F.struct(*others), F.col(order)).alias("_r"))
    return first.select(*[F.col(c) if c == key else F.col(f"_r.{c}") for c in rows.columns])


def duplicate_counts(rows: DataFrame, key: str) -> DataFrame:
    """One row: original, duplicate and deduplicated counts."""
    per_key = rows.groupBy(key).agg(F.count("*").alias("c"))
    return per_key.agg(F.sum("c").alias("original"), F.sum(F.col("c") - 1).alias("duplicates"), F.count("*").alias("deduplicated"))


def category_frequency(rows: DataFrame, column: str) -> DataFrame:
    """(category, n, share): share of all rows, those without a category counted in the total."""
    total = rows.agg(F.count("*").alias("total"))
    counts = rows.filter(F.col(column).isNotNull()).groupBy(F.translate(F.col(column), "_", " ").alias("category")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(total)).select("category", "n", (F.col("n") / F.col("total")).alias("share"))


def frequency_stats(frequencies: DataFrame) -> DataFrame:
    return frequencies.agg(F.count("*").alias("categories"), F.avg("share").alias("mean_share"), F.stddev_samp("share").alias("std_share"))


def texts_per_category(rows: DataFrame, column: str, order: str, text: str = "text") -> DataFrame:
    """(category, texts) in row order."""
    return rows.groupBy(F.col(column).alias("category")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]).alias("texts")
    )


def length_columns(text: Column) -> dict[str, Column]:
    """chars, tokens, sentences, tokens per sentence and characters per token of a text."""
    tokens, sents = T.words(text), T.sentences(text)
    n = F.size(tokens)
    return {
        "chars": F.char_length(text),
        "tokens": n,
        "sentences": F.size(sents),
        "tokens_per_sentence": n / F.nullif(F.size(sents), F.lit(0)),
        "chars_per_token": F.char_length(F.array_join(tokens, "")) / F.nullif(n, F.lit(0)),
    }


def length_stats(rows: DataFrame, column: str = "text") -> DataFrame:
    """One row: mean and sample deviation of each length."""
    d = rows.select(*[c.alias(n) for n, c in length_columns(F.col(column)).items()])
    return d.agg(*[f(n).alias(f"{p}_{n}") for n in d.columns for p, f in (("mean", F.avg), ("std", F.stddev_samp))])


def novel_words(pairs: DataFrame, summary: str, text: str) -> DataFrame:
    """Add novel: the summary's distinct words that the text lacks, sorted."""
    return pairs.withColumn("novel", F.array_sort(F.array_except(T.words(F.col(summary)), T.words(F.col(text)))))


def sort_by_year(rows: DataFrame, date: str, tie: str, skip: int = 250) -> DataFrame:
    """Sort by the third part of dd/mm/yyyy as text and drop the first `skip` rows; none is dropped from `skip` rows or fewer.

    Only the `skip` first rows are found (a bounded top list) and taken away; the rest is range-sorted."""
    year = F.element_at(F.split(F.col(date), "/"), 3)
    first = rows.orderBy(year, tie).limit(skip).select(tie)
    size = rows.agg((F.count("*") > skip).alias("_over"))
    drop = first.crossJoin(F.broadcast(size)).filter("_over").select(tie)
    return rows.join(F.broadcast(drop), tie, "left_anti").orderBy(year, tie)


def duplicate_links(links: DataFrame, seen: DataFrame | None = None, column: str = "url") -> DataFrame:
    """Links that occur twice, or that were seen before."""
    twice = links.groupBy(column).agg(F.count("*").alias("n")).filter("n > 1").select(column)
    return twice if seen is None else twice.union(links.join(seen, column, "left_semi").select(column)).distinct()


def union_stopwords(first: DataFrame, second: DataFrame, column: str = "word") -> DataFrame:
    """The words of both lists once; those of the first with plain accents."""
    return first.select(T.fold_greek(F.col(column)).alias(column)).union(second.select(column)).distinct()


def histogram_2d(rows: DataFrame, x: str, y: str, x_range: tuple[float, float], y_range: tuple[float, float], bins: int = 50) -> DataFrame:
    """(x_bin, y_bin, n) of the rows inside both ranges, the upper ends included: the data of a density plot."""
    def at(c: str, lo: float, hi: float) -> Column:
        return F.least(F.floor((F.col(c) - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")

    inside = F.col(x).between(*x_range) & F.col(y).between(*y_range)
    return rows.filter(inside).groupBy(at(x, *x_range).alias("x_bin"), at(y, *y_range).alias("y_bin")).agg(F.count("*").alias("n"))


def zip_equal(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Zip parallel arrays to rows; arrays of unequal length are an error."""
    same = F.lit(True)
    for c in columns[1:]:
        same &= F.size(c) == F.size(columns[0])
    checked = F.when(same, F.arrays_zip(*columns)).otherwise(F.raise_error(F.lit("lists of unequal length")))
    return rows.select(*[c for c in rows.columns if c not in columns], F.explode(checked).alias("_z")).select("*", "_z.*").drop("_z")


def cluster_vocabulary(rows: DataFrame, column: str, tokens: str, n: int = 1) -> DataFrame:
    """(category, gram): the distinct n-grams of each category, as rows, so no category's vocabulary is one value."""
    return rows.select(F.col(column).alias("category"), F.explode(T.ngrams(F.col(tokens), n)).alias("gram")).distinct()
