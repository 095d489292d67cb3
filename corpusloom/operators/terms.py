"""Sentences as rows, term frequencies, document frequencies and IDF."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions import text as T
from corpusloom.runtime import ship


def sentence_rows(docs: DataFrame, abbreviations: bool = False) -> DataFrame:
    """(doc_id, sent_ix from 0, sent); with `abbreviations` their full stops don't end a sentence."""
    cut = T.whole_sentences if abbreviations else T.sentences
    return docs.select("doc_id", F.posexplode(cut(F.col("text"))).alias("sent_ix", "sent"))


def term_frequency(sents: DataFrame, tokens: Column | None = None, stopwords: Iterable[str] = ()) -> DataFrame:
    """(doc_id, sent_ix, term, tf) for each word of each sentence."""
    words = T.words(F.col("sent")) if tokens is None else tokens
    stop = list(stopwords)
    if stop:
        words = F.filter(words, lambda w: ~w.isin(stop))
    # a sentence is one row: its sorted words are counted in place, by where a new word begins, so nothing is shuffled
    rows = sents.select("doc_id", "sent_ix", F.array_sort(words).alias("w")).filter(F.size("w") > 0)
    begins = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (i == 0) | (F.get("w", i) != F.get("w", i - 1)))
    rows = rows.withColumn("b", begins).withColumn("e", F.concat(F.slice("b", F.lit(2), F.size("b") - 1), F.array(F.size("w"))))
    rows = rows.select("doc_id", "sent_ix", "w", F.explode(F.arrays_zip("b", "e")).alias("x"))
    return rows.select("doc_id", "sent_ix", F.get("w", F.col("x.b")).alias("term"), (F.col("x.e") - F.col("x.b")).cast("long").alias("tf"))


def document_terms(docs: DataFrame, stopwords: Iterable[str] = (), abbreviations: bool = False) -> DataFrame:
    """(doc_id, sent_ix, term, tf, seen) of each document's sentences: a row without term and tf for each sentence, and one for
    each of its words. seen is 2 in a document's first row with a word, 1 where a word is met first in it, else 0, so that
    document frequencies are counts of rows. Documents are counted in batches where they lie; nothing is shuffled."""
    ship(docs.sparkSession)
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            n_sents = np.asarray(lists.value_lengths().fill_null(0))
            of = np.repeat(np.arange(len(lists)), n_sents)  # each sentence's document
            place = np.arange(len(of)) - np.repeat(np.cumsum(n_sents) - n_sents, n_sents)
            sents = lists.flatten()
            words = sents.flatten().dictionary_encode()
            size = max(len(words.dictionary), 1)
            code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            found, tf = np.unique(np.repeat(np.arange(len(of)), np.asarray(sents.value_lengths().fill_null(0))) * size + code, return_counts=True)
            sent, term = np.divmod(found, size)
            seen = np.zeros(len(found), dtype=np.int32)
            seen[np.unique(of[sent] * size + term, return_index=True)[1]] = 1
            seen[np.unique(of[sent], return_index=True)[1]] = 2
            bare = np.zeros(len(of), dtype=np.int64)
            whole = np.concatenate([bare.astype(bool) | True, np.zeros(len(found), dtype=bool)])
            row = np.concatenate([np.arange(len(of)), sent])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(of[row])),
                    pa.array(place[row], type=pa.int32()),
                    words.dictionary.take(pa.array(np.concatenate([bare, term]), mask=whole)).cast(pa.string()),
                    pa.array(np.concatenate([bare, tf]), mask=whole),
                    pa.array(np.concatenate([bare.astype(np.int32), seen])),
                ],
                names=["doc_id", "sent_ix", "term", "tf", "seen"],
            )

    rows = docs.select("doc_id", sentence_words(F.col("text"), stopwords, abbreviations).alias("w"))
    return rows.mapInArrow(run, f"doc_id {key}, sent_ix int, term string, tf long, seen int")


def words_of(sents: Column, stopwords: Iterable[str] = ()) -> Column:
    """The words of each of a list of sentences, as lists."""
    stop = list(stopwords)
    return F.transform(sents, (lambda s: F.filter(T.words(s), lambda w: ~w.isin(stop))) if stop else T.words)


def sentence_words(text: Column, stopwords: Iterable[str] = (), abbreviations: bool = False) -> Column:
    """`words_of` a text's sentences."""
    return words_of((T.whole_sentences if abbreviations else T.sentences)(text), stopwords)


def idf_of_terms(found: DataFrame) -> DataFrame:
    """(term, df, idf) of `document_terms`, equal to `idf_table`: only partial counts are shuffled."""
    n = found.agg(F.count_if(F.col("seen") == 2).alias("n"))
    counts = found.filter("seen > 0").groupBy("term").agg(F.count("*").alias("df"))
    return counts.crossJoin(F.broadcast(n)).select("term", "df", F.log(F.col("n") / F.col("df")).alias("idf"))


def idf_of_documents(docs: DataFrame, stopwords: Iterable[str] = ()) -> DataFrame:
    """(term, df, idf) straight from (doc_id, text), equal to `idf_table` of their sentences. Each document gives its
    distinct words once, and an empty word that counts documents with any; only partial counts are shuffled."""
    stop = list(stopwords)
    words = F.array_distinct(T.words(F.col("text")))
    if stop:
        words = F.filter(words, lambda w: ~w.isin(stop))
    rows = docs.select(words.alias("w")).filter(F.size("w") > 0).select(F.explode(F.concat("w", F.array(F.lit("")))).alias("term"))
    counts = rows.groupBy("term").agg(F.count("*").alias("df"))
    n = counts.filter("term = ''").select(F.col("df").alias("n"))
    return counts.filter("term <> ''").join(F.broadcast(n)).select("term", "df", F.log(F.col("n") / F.col("df")).alias("idf"))


def document_frequency(tf: DataFrame) -> DataFrame:
    """(term, df): documents that have the term."""
    return tf.select("doc_id", "term").distinct().groupBy("term").agg(F.count("*").alias("df"))


def idf_table(tf: DataFrame) -> DataFrame:
    """(term, df, idf): ln(N / df); N counts documents with at least one word."""
    n = tf.agg(F.countDistinct("doc_id").alias("n"))
    return document_frequency(tf).crossJoin(F.broadcast(n)).select("term", "df", F.log(F.col("n") / F.col("df")).alias("idf"))


def default_idf(tf: DataFrame, unseen_as_new: bool = True) -> DataFrame:
    """One row: the IDF of a word that no document has."""
    n = tf.agg(F.countDistinct("doc_id").alias("n"))
    return n.select((F.log(F.col("n") + 1) if unseen_as_new else F.lit(0.0)).alias("idf_default"))


def with_idf(tf: DataFrame, idf: DataFrame, default: float | None = None) -> DataFrame:
    """(doc_id, sent_ix, term, tf, w = tf * idf), unseen words by the default."""
    weight = F.col("idf") if default is None else F.coalesce("idf", F.lit(float(default)))
    return tf.join(idf.select("term", "idf"), "term", "inner" if default is None else "left").select("doc_id", "sent_ix", "term", "tf", (F.col("tf") * weight).alias("w"))


def unit_vectors(weighted: DataFrame) -> DataFrame:
    """(doc_id, sent_ix, term, x): weights divided by the sentence's norm; zero weights go.

    Rows are dealt out by document once; the sums by sentence here, and by term of a document later, need no further
    exchange, as rows of a document are together already."""
    some = weighted.filter("w > 0").repartition("doc_id")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id", "sent_ix")))
    return some.select("doc_id", "sent_ix", "term", (F.col("w") / norm).alias("x"))
