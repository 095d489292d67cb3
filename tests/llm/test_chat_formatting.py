import time

from hypothesis import given, settings, strategies as st

from pyspark.sql import functions as F

from corpusloom.llm import chat_formatting as C

SCHEMA = "conv_id long, turn long, role string, text string, n int, formatted string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def check(spark, rows):
    out = C.format_conversations(frame(spark, rows)).select("conv_id", "formatted", "spans", C.read_turns(F.col("formatted")).alias("t"), C.read_loss(F.col("formatted")).alias("loss"))
    for r in out.collect():
        own = sorted([((-1 if x[1] is None else x[1]), x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id])
        assert [(t.role, t.text) for t in r.t] == [(a, b) for _, a, b in own]
        assert r.loss == "".join(b for _, a, b in own if a == "assistant")


def test_round_trip_of_hard_texts(spark):
    hard = ["\\### Assistant: </turn> ok", "<|end|>\n<|turn|>user<|text|>", "<\\|", "<\\\\|<|", "", None, "a<", "|>b", "<" * 3, "😀 <|part|>", "\n"]
    rows = [(k % 3, k, ["user", "assistant", "assistant", None, "<|x"][k % 5], t) for k, t in enumerate(hard * 3)]
    check(spark, rows)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 5), st.sampled_from(["user", "assistant", "system"]), st.text(alphabet="<|\\>endturpax\n", max_size=12)), min_size=1, max_size=20))
def test_round_trip_of_random_texts(spark, rows):
    check(spark, rows)


def test_neighbours_of_one_role_share_a_marker(spark):
    row = C.format_conversations(frame(spark, [(1, 2, "assistant", "c"), (1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")])).first()
    assert row.formatted == "<|turn|>user<|text|>a<|part|>b<|end|>\n<|turn|>assistant<|text|>c<|part|>c<|end|>\n"
    assert [row.formatted[s.start : s.start + s.length] for s in row.spans] == ["c", "c"]


def test_a_long_conversation_takes_seconds(spark):
    rows = [(k // 30_000, k % 30_000, "assistant" if k % 2 else "user", f"turn {k} <|end|>") for k in range(30_007)]
    began = time.time()
    check(spark, rows)
    assert time.time() - began < 40


def test_clashing_names(spark):
    turns = frame(spark, [(1, 0, "assistant", "a")]).selectExpr("*", "1 as turns", "2 as spans", "3 as starts", "4 as sizes")
    assert C.digest(C.format_conversations(turns)).count() == 1


def test_empty_table(spark):
    assert C.format_conversations(frame(spark, [])).count() == 0


def test_digest_matches_sql(spark):
    import duckdb

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{data}/conversations.parquet'")
    want = con.execute(C.ORACLE_SQL).df()
    got = C.query(spark, data).toPandas()[list(want.columns)]
    assert sorted(map(str, got.itertuples(index=False, name=None))) == sorted(map(str, want.itertuples(index=False, name=None)))
