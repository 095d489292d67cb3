import json
import os

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import named_files as N, readers


def seen(folder):
    """What readers see: tasks that die with their job may leave a staging folder."""
    return [f for f in os.listdir(folder) if not f.startswith("_staging")]


def summaries(spark, n=25):
    rows = [(k, f"summary {k}\nγραμμή", f"t{k}", None if k == 3 else f"ref {k}", "more") for k in range(n)]
    return spark.createDataFrame(rows, "ix int, summary string, metadata string, reference_summary string, extra string").repartition(4)


def test_round_trip(spark, tmp_path):
    folder = str(tmp_path / "out")
    N.write_summaries(summaries(spark), folder)
    assert sorted(os.listdir(folder)) == sorted([f"{k}.json" for k in range(25)] + [N.DONE]) and N.is_whole(folder)
    assert json.load(open(f"{folder}/3.json")) == {"summary": "summary 3\nγραμμή", "metadata": "t3", "reference_summary": None}
    got = readers.read_summaries(spark, folder).orderBy("ix").collect()
    assert [tuple(r) for r in got if r.ix is not None] == [(k, f"summary {k}\nγραμμή") for k in range(25)]
    N.write_summaries(summaries(spark, 2), folder, kind="txt")
    assert open(f"{folder}/1.txt", encoding="utf-8").read() == "summary 1 γραμμή" and os.path.exists(f"{folder}/24.json")


def test_case_folders(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"text {k}", f"s {k}", "a,b") for k in range(3)], "row_ix int, text string, summary string, case_tags string")
    N.write_case_dirs(rows, str(tmp_path))
    assert json.load(open(tmp_path / "summary" / "2.json")) == {"summary": "s 1", "case_tags": "a,b"}
    assert sorted(tuple(r) for r in readers.read_case_dirs(spark, str(tmp_path)).filter("ix IS NOT NULL").collect()) == [(k + 1, f"text {k}", f"s {k}") for k in range(3)]


@pytest.mark.parametrize("bad", ["a/b", None, "", "0.x"], ids=["slash", "null", "empty", "repeated"])
def test_a_failed_job_leaves_nothing(spark, tmp_path, bad):
    folder = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"{k}.x", "v") for k in range(20)] + [(bad, "w")], "n string, v string").repartition(4)
    with pytest.raises(Exception):
        N.write_named(rows, folder, "n", "v")
    assert seen(folder) == [] and not N.is_whole(folder)


def test_a_lost_attempt_leaves_no_half_file(spark, tmp_path):
    """The first attempt of each task dies in the middle of its files; what is there at the end is whole."""
    folder, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    os.makedirs(marks)

    @F.udf("string")
    def dies_once(k):
        mark = f"{marks}/{k}"
        if k % 10 == 7 and not os.path.exists(mark):
            open(mark, "w").close()
            raise RuntimeError("lost")
        return f"value {k}"

    rows = spark.range(40).select(F.concat("id", F.lit(".t")).alias("n"), dies_once("id").alias("v"))
    for _ in range(5):
        try:
            N.write_named(rows, folder, "n", "v")
            break
        except Exception:
            assert seen(folder) == []
    assert len(os.listdir(marks)) == 4
    assert {f: open(f"{folder}/{f}").read() for f in seen(folder) if f != N.DONE} == {f"{k}.t": f"value {k}" for k in range(40)}
