"""The frontier of a crawl as a stream: pages come in, the links that nobody has asked for yet go out as requests.

Each micro-batch of pages becomes links in absolute form, summed up by link before anything is compared (a link that a
third of all pages names is one row then), less those that earlier batches asked for or that name a page that has come. The rest is
written as the batch's requests, in a folder named by the batch's number: the stream's checkpoint gives a batch that
was cut short the same number and the same pages again, and history is read below that number only, so the batch is written
over with the same rows and every link is asked for once, whatever dies in between.

History is the requests and pages written so far. A batch of few links is sent to the tasks that scan history, which is
not shuffled then; more than BROADCAST_LINKS are joined by shuffling both. `compact` puts the folders of many batches in one.

Defined results: null pages, pages without address and links that lead nowhere (mail, scripts, broken addresses) give no request; fragments
don't count; a page that comes twice is one page; a link to a page of the same or an earlier batch isn't asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.functions import urls
from corpusloom.operators import page_tree, pages

PAGE = "page_id long, url string, html string"
REQUEST = "link string, first_page long, n_pages long"
#: Links of a batch that are sent to all tasks, some 100 MB at most.
BROADCAST_LINKS = 500_000


def links_of(batch: DataFrame) -> DataFrame:
    """(link, page_id): every different absolute link of each page."""
    found = batch.select("page_id", "url", F.explode(F.array_distinct(pages.links(F.col("html")))).alias("href"))
    return found.select(urls.resolve(F.col("url"), page_tree.unescape(F.col("href"))).alias("link"), "page_id").filter("link IS NOT NULL").distinct()


def visited(batch: DataFrame) -> DataFrame:
    return batch.select(urls.without_fragment(F.col("url")).alias("link")).filter("link IS NOT NULL").distinct()


def _history(spark: SparkSession, store: str, below: int) -> DataFrame:
    """(link) of all that was asked for or has come in batches before a number."""
    out = None
    for kind in ("requests", "visited"):
        if batches := [b for b in _batches(spark, f"{store}/{kind}") if b < below]:
            rows = spark.read.schema("link string").parquet(*[f"{store}/{kind}/batch={b}" for b in batches])
            out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], "link string") if out is None else out


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of batches that are written, whole or not."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n[6:]) for n in names if n.startswith("batch=") and n[6:].isdigit())


def take_batch(batch: DataFrame, number: int, store: str) -> None:
    """Write the requests and the pages of one micro-batch."""
    spark = batch.sparkSession
    history = _history(spark, store, number)
    visited(batch).write.mode("overwrite").parquet(f"{store}/visited/batch={number}")
    came = spark.read.schema("link string").parquet(f"{store}/visited/batch={number}")
    links = links_of(batch).groupBy("link").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n_pages"))
    fresh = f"{store}/fresh/batch={number}"
    links.join(came, "link", "left_anti").write.mode("overwrite").parquet(fresh)
    links = spark.read.schema(REQUEST).parquet(fresh)
    if links.count() <= BROADCAST_LINKS:
        known = history.join(F.broadcast(links.select("link")), "link", "left_semi").distinct()
    else:
        known = history
    links.join(known, "link", "left_anti").write.mode("overwrite").parquet(f"{store}/requests/batch={number}")


def start(stream: DataFrame, store: str, checkpoint: str, available_now: bool = True):
    """Start the frontier over a stream of pages (PAGE); `store` is a folder that driver and executors share."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: take_batch(batch, number, store))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def requests(spark: SparkSession, store: str) -> DataFrame:
    """(link, first_page, n_pages, batch) of all batches so far."""
    parts = [spark.read.schema(REQUEST).parquet(f"{store}/requests/batch={b}").withColumn("batch", F.lit(b).cast("long")) for b in _batches(spark, f"{store}/requests")]
    out = spark.createDataFrame([], REQUEST + ", batch long")
    for part in parts:
        out = out.unionByName(part)
    return out


def compact(spark: SparkSession, store: str, below: int) -> None:
    """Put what came in batches before a number in the first of their folders, so that history is few large files. Only for
    a stream that stands still and whose batches up to that number are done; requests keep their own folders."""
    numbers = [b for b in _batches(spark, f"{store}/visited") if b < below]
    if len(numbers) < 2:
        return
    paths = [f"{store}/visited/batch={b}" for b in numbers]
    aside = f"{store}/compacting"
    spark.read.schema("link string").parquet(*paths).distinct().write.mode("overwrite").parquet(aside)
    # written in full before any folder goes: links that are there twice for a while do no harm
    spark.read.schema("link string").parquet(aside).write.mode("append").parquet(paths[-1])
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(store).getFileSystem(spark._jsc.hadoopConfiguration())
    for old in [*paths[:-1], aside]:
        fs.delete(path(old), True)
