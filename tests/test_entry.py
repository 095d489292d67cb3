import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["dedup_by_key", "cut_after_marker", "lexrank_topk", "rouge_2", "seeded_split", "page_text"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "orders", "labels"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(map(str, df.select(cols).toPandas().itertuples(index=False, name=None)))
    want = con.execute(entry.oracle_sql()[name]).df()
    assert got == sorted(map(str, want[cols].itertuples(index=False, name=None)))
