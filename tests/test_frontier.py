import pytest
from pyspark.sql import functions as F

from corpusloom.functions import urls
from corpusloom.streaming import frontier as C

BASE = "http://h.example/a/b/page.html?x=1#top"
#: Links and their absolute form on BASE.
LINKS = {
    "http://other.example/q": "http://other.example/q",
    "HTTPS://other.example": "HTTPS://other.example",
    "//cdn.example/x": "http://cdn.example/x",
    "/root#f": "http://h.example/root",
    "next.html": "http://h.example/a/b/next.html",
    "./n": "http://h.example/a/b/n",
    "../n": "http://h.example/a/n",
    "../../../n/./m/..": "http://h.example/n/",
    "?y=2": "http://h.example/a/b/page.html?y=2",
    "#part": "http://h.example/a/b/page.html?x=1",
    " /s ": "http://h.example/s",
    "mailto:a@b": None,
    "javascript:void(0)": None,
}


def test_resolve(spark):
    rows = spark.createDataFrame([(BASE, k) for k in LINKS] + [("http://h.example", "x"), ("nothing", "/x"), (None, "/x"), (BASE, None)], "b string, l string")
    got = [r[0] for r in rows.select(urls.resolve(F.col("b"), F.col("l"))).collect()]
    assert got == [*LINKS.values(), "http://h.example/x", None, None, None]


def page(k, url, *links):
    return (k, url, " ".join(f"<a href='{x}'>" for x in links))


PARTS = [
    [page(1, "http://h/1", "/2", "/3", "/3", "/1"), page(2, "http://h/2#x", "/4", "mailto:x"), page(3, None, "/9"), (4, "http://h/4b", None)],
    [page(5, "http://h/3", "/2", "/4", "/5"), page(6, "http://h/6", "/5", "/7&amp;a=1")],
    [page(7, "http://h/9", "/7&a=1", "/8", "/6"), page(8, "http://h/8", "/8")],
]
WANT = {("http://h/3", 1, 1, 0), ("http://h/4", 2, 1, 0), ("http://h/5", 5, 2, 1), ("http://h/7&a=1", 6, 1, 1)}


def run(spark, tmp_path, part, k):
    spark.createDataFrame(part, C.PAGE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(C.PAGE).parquet(f"{tmp_path}/in")
    C.start(stream, f"{tmp_path}/store", f"{tmp_path}/check").awaitTermination(120)
    return {tuple(r) for r in C.requests(spark, f"{tmp_path}/store").select("link", "first_page", "n_pages", "batch").collect()}


@pytest.mark.parametrize("most", [0, C.BROADCAST_LINKS], ids=["shuffled", "sent"])
def test_three_batches(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(C, "BROADCAST_LINKS", most)
    for k, part in enumerate(PARTS):
        got = run(spark, tmp_path, part, k)
        assert got == {w for w in WANT if w[3] <= k}


def test_restart_after_a_failure(spark, tmp_path, monkeypatch):
    """A batch that dies after its requests are written comes again with its number and gives the same rows, once."""
    run(spark, tmp_path, PARTS[0], 0)
    whole = C.take_batch

    def dies(batch, number, store):
        whole(batch, number, store)
        raise RuntimeError("lost")

    monkeypatch.setattr(C, "take_batch", dies)
    with pytest.raises(Exception, match="lost"):
        run(spark, tmp_path, PARTS[1], 1)
    monkeypatch.setattr(C, "take_batch", whole)
    C.start(spark.readStream.schema(C.PAGE).parquet(f"{tmp_path}/in"), f"{tmp_path}/store", f"{tmp_path}/check").awaitTermination(120)
    assert {tuple(r) for r in C.requests(spark, f"{tmp_path}/store").collect()} == {w for w in WANT if w[3] <= 1}
    C.compact(spark, f"{tmp_path}/store", 2)
    assert run(spark, tmp_path, PARTS[2], 2) == WANT


def test_no_pages(spark, tmp_path):
    assert run(spark, tmp_path, [], 0) == set()
