import json

from corpusloom.sources import readers, writers


def test_case_dirs_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(0, "κείμενο", "s0"), (2, "t2", "s2")], "row_ix int, text string, summary string")
    writers.write_case_dirs(rows, str(tmp_path))
    assert json.load(open(tmp_path / "caselaw/1.json", encoding="utf-8")) == {"text": "κείμενο"}
    got = {(r.ix, r.text, r.summary) for r in readers.read_case_dirs(spark, str(tmp_path)).collect()}
    assert got == {(1, "κείμενο", "s0"), (3, "t2", "s2")}


def test_column_json(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"text": {"0": "a", "1": "b"}, "summary": {"0": "x", "1": "y"}}))
    got = readers.read_column_json(spark, str(tmp_path / "t.json"), ["text", "summary"])
    assert sorted(map(tuple, got.collect())) == [(0, "a", "x"), (1, "b", "y")]


def test_csv_with_line_breaks(spark, tmp_path):
    rows = spark.createDataFrame([('a "q"\nb', "s")], "text string, summary string")
    writers.write_table(rows, str(tmp_path / "c"), single=True)
    assert tuple(readers.read_csv(spark, str(tmp_path / "c"), "text string, summary string").first()) == ('a "q"\nb', "s")


def test_pairing_reports_gaps(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "ix int, text string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "ix int, text string")
    pairs, missing = readers.pair_by_index(a, b)
    assert [tuple(r) for r in pairs.collect()] == [(2, "y", "z")] and tuple(missing.first()) == (1, 1)
