"""Readers with explicit schemas. Nothing is inferred, and order columns come from data, not from file order."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from corpusloom.functions import text as X

CORPUS = "row_ix long, text string, summary string, case_category string, case_tags string, url string, subset int, date string, case_num string"
#: Columns by kind of dataset, besides optional url and case_tags.
COLUMNS = {"AreiosPagos": ["summary", "text", "case_category"], "STE": ["case_num", "date", "metadata_url", "summary", "text"]}


def read_csv(spark: SparkSession, path: str, schema: str = CORPUS, limit: int | None = None, keep_empty: bool = False) -> DataFrame:
    """keep_empty: a pair of quotes is an empty text, not null as a value that isn't there."""
    options = {"header": True, "multiLine": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    if keep_empty:
        options |= {"nullValue": "", "emptyValue": f"empty-{uuid.uuid4().hex}"}  # no file holds this text
    rows = spark.read.schema(schema).options(**options).csv(path)
    if keep_empty:
        rows = rows.withColumns({f.name: F.when(F.col(f"`{f.name}`") == options["emptyValue"], "").otherwise(F.col(f"`{f.name}`")) for f in rows.schema if isinstance(f.dataType, T.StringType)})
    if not limit:
        return rows
    # the first rows by file and place in it, whatever task comes first
    place = rows.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    return place.orderBy("_path", "_block", "_row").limit(limit).drop("_path", "_block", "_row")


def read_json_lines(spark: SparkSession, path: str, schema: str = CORPUS) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_column_json(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A table kept as one JSON object per column: (row_ix, columns), values as text."""
    kind = T.StructType([T.StructField(c, T.MapType(T.StringType(), T.StringType())) for c in columns])
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("v"))
    keys = whole.select("v", F.explode(F.map_keys(F.col(f"v.{columns[0]}"))).alias("k"))
    return keys.select(F.col("k").cast("long").alias("row_ix"), *[F.element_at(F.col(f"v.{c}"), F.col("k")).alias(c) for c in columns])


def read_record_dir(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """One JSON record a file; ix is the number in the file's name."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("ix", X.file_index(F.col("_metadata.file_name")))
    return rows.orderBy("ix").limit(limit) if limit else rows


def read_case_dirs(spark: SparkSession, path: str) -> DataFrame:
    """caselaw/{i}.json with summary/{i}.json, paired by their number: (ix, text, summary)."""
    texts = read_record_dir(spark, f"{path}/caselaw", "text string")
    return texts.join(read_record_dir(spark, f"{path}/summary", "summary string"), "ix").select("ix", "text", "summary")


def read_summaries(spark: SparkSession, path: str, column: str = "summary") -> DataFrame:
    """(ix, text) from the given column of summary files."""
    return read_record_dir(spark, path, f"`{column}` string").select("ix", F.col(column).alias("text"))


def pair_by_index(generated: DataFrame, reference: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ix, generated, reference) and, as one row, how many of either side have no partner."""
    a, b = generated.select("ix", F.col("text").alias("generated")), reference.select("ix", F.col("text").alias("reference"))
    missing = a.join(b, "ix", "full").agg(F.count_if(F.col("reference").isNull()).alias("no_reference"), F.count_if(F.col("generated").isNull()).alias("no_generated"))
    return a.join(b, "ix"), missing


def pair_observed(generated: DataFrame, reference: DataFrame, name: str = "pairs") -> tuple[DataFrame, Observation]:
    """As `pair_by_index`, with the counts taken in passing: `observation.get` has pairs, no_reference and no_generated
    once an action has run over the pairs. One join and no second pass."""
    a, b = generated.select("ix", F.col("text").alias("generated"), F.lit(True).alias("_a")), reference.select("ix", F.col("text").alias("reference"), F.lit(True).alias("_b"))
    seen, left, right = Observation(name), F.col("_a").isNull(), F.col("_b").isNull()
    both = a.join(b, "ix", "full").observe(seen, F.count_if(~left & ~right).alias("pairs"), F.count_if(right).alias("no_reference"), F.count_if(left).alias("no_generated"))
    return both.filter(~left & ~right).select("ix", "generated", "reference"), seen


def read_stopwords(spark: SparkSession, path: str, language: str) -> DataFrame:
    words = spark.read.text(path).select(F.lit(language).alias("lang"), F.trim(X.clean_text(F.col("value"))).alias("word"))
    return words.filter("word <> ''").distinct()


def read_exceptions(spark: SparkSession, path: str) -> DataFrame:
    """(word, stem) from key|stem lines; a repeated key is an error."""
    rows = spark.read.schema("word string, stem string").option("sep", "|").csv(path)
    counted = rows.groupBy("word").agg(F.count("*").alias("n"), F.first("stem").alias("stem"))
    return counted.select("word", F.when(F.col("n") == 1, F.col("stem")).otherwise(F.raise_error(F.concat(F.lit("repeated key "), F.col("word")))).alias("stem"))


def read_idf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The term table and the default for unseen words."""
    return spark.read.schema("term string, df long, idf double").parquet(f"{path}/terms"), spark.read.schema("idf_default double").parquet(f"{path}/default")


def require(rows: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in rows.columns]:
        raise ValueError(f"missing columns: {missing}")
    return rows
