"""One named file for each row, whole or not at all.

A file's name comes from its row, which Spark's own writers can't give. Tasks write to a staging folder, each attempt to a
part of its own; the table of what successful attempts wrote is settled, and only files in that table are moved to their place,
by tasks again. A move is one rename, so a file is there in full or isn't; a task that is lost is run again, and a move that has
been made is left alone. A mark `_SUCCESS` says that all are there. A job that fails before the moves leaves no file in its
place; a staging folder that tasks wrote to while the job died may stay, under a name that readers skip.

Files go through pyarrow's file systems (file, hdfs, s3, gs), so the folder can be on any storage that all executors
reach; on a cluster a local folder would be each machine's own."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from corpusloom.runtime import drop, settle, ship

DONE = "_SUCCESS"


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def write_named(rows: DataFrame, folder: str, name: str, value: str) -> None:
    """Write the text of column `value` to the file that column `name` names, one for each row of a table (name, value). Null values
    are empty files; a null or repeated name, or one with a slash, is an error before any file is in its place. Files
    of that name that are there are replaced, others stay."""
    ship(rows.sparkSession)
    storage, base = _opened(folder)
    staging = f"{base}/_staging-{uuid.uuid4().hex}"

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = _opened(folder)[0], f"{staging}/{uuid.uuid4().hex}"
        own.create_dir(part, recursive=True)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for file, text in zip(names, batch.column(1).to_pylist(), strict=True):
                with own.open_output_stream(f"{part}/{file}") as out:
                    out.write((text or "").encode())
            yield pa.RecordBatch.from_pydict({"part": [part] * len(names), "name": names})

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _opened(folder)[0]
        for batch in batches:
            for part, file in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own.get_file_info(f"{part}/{file}").type != fs.FileType.NotFound:  # else an attempt before has moved it
                    own.move(f"{part}/{file}", f"{base}/{file}")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    storage.create_dir(base, recursive=True)
    try:
        fine = F.col("name").isNotNull() & (F.col("name") != "") & ~F.contains(F.coalesce("name", F.lit("")), F.lit("/"))
        checked = F.when(fine, F.col("name")).otherwise(F.raise_error(F.concat(F.lit("not a file name: "), F.coalesce("name", F.lit("null")))))
        named = rows.select(F.col(name).cast("string").alias("name"), F.col(value).cast("string").alias("value")).select(checked.alias("name"), "value")
        staged = settle(named.mapInArrow(stage, "part string, name string"), "staged-files")
        if again := staged.groupBy("name").count().filter("count > 1").limit(1).collect():
            raise ValueError(f"several rows for {again[0]['name']}")
        if storage.get_file_info(f"{base}/{DONE}").type != fs.FileType.NotFound:
            storage.delete_file(f"{base}/{DONE}")
        staged.mapInArrow(move, "n long").agg(F.sum("n")).collect()
        with storage.open_output_stream(f"{base}/{DONE}"):
            pass
        drop(staged)
    finally:
        if storage.get_file_info(staging).type != fs.FileType.NotFound:
            storage.delete_dir(staging)


def is_whole(folder: str) -> bool:
    storage, base = _opened(folder)
    return storage.get_file_info(f"{base}/{DONE}").type != fs.FileType.NotFound


def write_records(rows: DataFrame, folder: str, index: str, kind: str = "json", text: str = "summary") -> None:
    """{index}.json with all other columns as one record, or {index}.txt with the column `text` on one line."""
    columns = [c for c in rows.columns if c != index]
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})
    body = record if kind == "json" else F.regexp_replace(F.col(text), "\n", " ")
    write_named(rows.select(F.concat(F.col(index).cast("string"), F.lit(f".{kind}")).alias("name"), body.alias("value")), folder, "name", "value")


def write_summaries(rows: DataFrame, folder: str, index: str = "ix", kind: str = "json") -> None:
    """One file for each row (index, summary, metadata, reference_summary)."""
    write_records(rows.select(index, "summary", *[c for c in ("metadata", "reference_summary") if c in rows.columns]), folder, index, kind)


def write_case_dirs(rows: DataFrame, folder: str, index: str = "row_ix") -> None:
    """caselaw/{index + 1}.json holds the text, summary/{index + 1}.json everything else."""
    counted = rows.withColumn(index, F.col(index) + 1)
    write_records(counted.select(index, "text"), f"{folder}/caselaw", index)
    write_records(counted.drop("text"), f"{folder}/summary", index)
