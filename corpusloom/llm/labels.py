"""Which rows a classifier may learn from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept for testing: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample_ids(rows: DataFrame, limit: int) -> list:
    """At most `limit` distinct ids, the first by a hash, so the sample doesn't depend on partitions or order."""
    ids = rows.select("doc_id").filter("doc_id is not null").distinct()
    return [r[0] for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()]


def chosen(docs: DataFrame, ids: list) -> DataFrame:
    """The documents with these ids (a bounded list), found without a shuffle of texts."""
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(i,) for i in ids], docs.select("doc_id").schema)
    return docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id", "left_semi")
