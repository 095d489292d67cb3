"""Writers. Names of single files are only kept where a caller needs one file per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom.sources import named_files


#: White space at a value's ends belongs to it; a null is nothing and an empty text a pair of quotes.
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "nullValue": "", "emptyValue": '""'}


def write_table(rows: DataFrame, path: str, kind: str = "csv", single: bool = False) -> None:
    rows = rows.coalesce(1) if single else rows
    w = rows.write.mode("overwrite")
    w.options(**CSV).csv(path) if kind == "csv" else w.json(path)


def write_summaries(rows: DataFrame, path: str, kind: str = "json") -> None:
    """rows (summary, metadata, reference_summary): JSON records, or the summaries alone as text."""
    value = F.to_json(F.struct(*rows.columns)) if kind == "json" else F.regexp_replace("summary", "\n", " ")
    rows.select(value.alias("value")).write.mode("overwrite").text(path)


def write_file_per_row(rows: DataFrame, folder: str, index: str) -> None:
    """{index + 1}.json for each row, whole or not at all: see `named_files`."""
    named_files.write_records(rows.withColumn(index, F.col(index) + 1), folder, index)


def write_case_dirs(rows: DataFrame, path: str, index: str = "row_ix") -> None:
    """caselaw/ holds the text, summary/ everything else."""
    named_files.write_case_dirs(rows, path, index)


def write_idf(idf: DataFrame, default: DataFrame, path: str) -> None:
    idf.write.mode("overwrite").parquet(f"{path}/terms")
    default.write.mode("overwrite").parquet(f"{path}/default")
