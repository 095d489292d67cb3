"""Whole programs: summarize, evaluate, preprocess, describe."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType

from corpusloom.functions import text as T
from corpusloom.operators import centrality, rouge, select, similarity, stem, tables, terms
from corpusloom.runtime import settle, ship


#: About 100 MB of terms and weights at most.
BROADCAST_TERMS = 1_000_000


#: Damped scores are iterated until a step changes a share by less than this on average.
CONVERGED = {"steps": 1_000, "tolerance": 1e-12}


@dataclass(frozen=True)
class SummaryOptions:
    method: str = "lexrank"  # lexrank, lexrank_undamped, biased_lexrank, random_sentence
    size: int | float | None = None
    similarity: str = "idf_mod_cosine"
    stopwords: tuple[str, ...] = ()
    bias_words: tuple[str, ...] | None = None  # None: each row's own tags
    threshold: float | None = None
    limit_fraction: float | None = None
    seed: int = 1
    #: Full stops of known abbreviations and of initials don't end a sentence.
    abbreviations: bool = True


def weights(docs: DataFrame, stopwords: tuple[str, ...] = (), idf: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sentence rows, term frequencies, unit vectors)."""
    sents, tf, weighted = _weighted(docs, stopwords, idf)
    return sents, tf, terms.unit_vectors(weighted)


def _weighted(docs: DataFrame, stopwords: tuple[str, ...], idf: DataFrame | None, abbreviations: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sentence rows, term frequencies, weights)."""
    _, tf, weighted = keyed_weights(docs, stopwords, idf, abbreviations)
    return terms.sentence_rows(docs, abbreviations), tf, weighted


def keyed_weights(docs: DataFrame, stopwords: tuple[str, ...] = (), idf: DataFrame | None = None, abbreviations: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sentence keys, term frequencies, weights). Texts are tokenised once: the term table, with the keys of all sentences, is
    written to the shared folder and read by all that follows. The IDF table is broadcast up to BROADCAST_TERMS terms and else
    joined by term."""
    found = settle(terms.document_terms(docs, stopwords, abbreviations), "term-table")
    tf = found.filter("term IS NOT NULL").select("doc_id", "sent_ix", "term", "tf")
    idf = settle(terms.idf_of_terms(found), "idf-table") if idf is None else idf
    idf = F.broadcast(idf) if idf.count() <= BROADCAST_TERMS else idf
    return found.filter("term IS NULL").select("doc_id", "sent_ix"), tf, terms.with_idf(tf, idf)


#: Terms of more than one document whose hashes and IDF are broadcast to kernels, 16 bytes each.
PLACED_TERMS = 8_000_000


def placed(docs: DataFrame, stopwords: tuple[str, ...] = (), abbreviations: bool = False) -> centrality.Placed | None:
    """Documents whose weights are made where they lie, with a broadcast IDF table of the terms that more than one of them has; None
    where those are more than PLACED_TERMS, or ids are null or repeated, so that rows have to be brought together by id."""
    if docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").limit(1).count():
        return None
    idf = settle(terms.idf_of_documents(docs, stopwords), "idf-table")
    shared = idf.filter("df > 1")
    if shared.count() > PLACED_TERMS:
        return None
    ship(docs.sparkSession)
    once = idf.filter("df = 1").select("idf").first()  # equal for all of them

    def number(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(centrality.hashed(batch.column(0))), batch.column(1)], names=["t", "idf"])

    found = shared.select("term", "idf").mapInArrow(number, "t long, idf double").toArrow()
    t, weight = (found.column(c).to_numpy() for c in ("t", "idf"))
    order = np.argsort(t)
    held = docs.sparkSession.sparkContext.broadcast((t[order], weight[order], once[0] if once else 0.0))
    return centrality.Placed(docs.select("doc_id", terms.sentence_words(F.col("text"), stopwords, abbreviations).alias("w")), held)


def document_weights(docs: DataFrame) -> tuple[DataFrame | centrality.Placed, DataFrame]:
    """(weights, sentence keys) for kernels of whole documents: placed where that can be, else a table of entries."""
    if (found := placed(docs)) is not None:
        return found, found.rows
    sents, _, weighted = keyed_weights(docs)
    return weighted, sents


def _edges(metric: str, tf: DataFrame, weighted: DataFrame, vectors: DataFrame | None) -> DataFrame:
    """(doc_id, i, j, sim), i <= j, of a metric other than idf cosine; negative cosines stay."""
    if metric == "common_words":
        n = F.sum("tf")
        own = tf.groupBy("doc_id", "sent_ix").agg(F.when(n == 1, F.lit(1.0)).otherwise(n / F.log10(n)).alias("sim"))
        edges = similarity.common_word_edges(tf)
    else:
        v = similarity.sentence_vectors(weighted, vectors) if metric == "word2vec_sim" else vectors.select("doc_id", "sent_ix", F.col("embedding").alias("v"))
        v = settle(v, "sentence-vectors")
        own = v.filter(F.exists("v", lambda x: x != 0)).select("doc_id", "sent_ix", F.lit(1.0).alias("sim"))
        edges = similarity.vector_edges(v, "doc_id", "sent_ix", "v", -2.0)  # below any cosine
    return edges.unionByName(own.select("doc_id", F.col("sent_ix").alias("i"), F.col("sent_ix").alias("j"), "sim"))


def _summaries_in_place(docs: DataFrame, found: centrality.Placed, options: SummaryOptions, size: int | float | None) -> DataFrame:
    """`summarize` by plain centrality in each document's own row: neither sentences nor texts are shuffled."""
    how = {"method": "damped", **CONVERGED} if options.method == "lexrank" else {"method": "undamped"}
    cut = T.whole_sentences if options.abbreviations else T.sentences
    rows = docs.select("doc_id", "text", cut(F.col("text")).alias("sents"))
    words = terms.words_of(F.col("sents"), options.stopwords)
    rows = rows.select("doc_id", "text", "sents", centrality.placed_scores(found, words, threshold=options.threshold, **how).alias("scores"))
    chosen = select.summary_of(F.col("scores"), F.col("sents"), size)
    out = rows.select("doc_id", "text", F.coalesce(chosen, F.lit("")).alias("summary"))
    if options.limit_fraction is None:
        return out.select("doc_id", "summary")
    return out.select("doc_id", T.first_tokens(F.col("summary"), T.token_budget(F.col("text"), options.limit_fraction)).alias("summary"))


def summarize(
    docs: DataFrame, options: SummaryOptions = SummaryOptions(), idf: DataFrame | None = None, vectors: DataFrame | None = None, bias_vectors: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """(doc_id, summary) of docs (doc_id, text, and tags for a bias by tags). vectors: (term, embedding) for word2vec_sim,
    (doc_id, sent_ix, embedding) for bert_sim. bias_vectors: for biased_lexrank, vectors of sentences (doc_id, sent_ix, embedding)
    and those (embedding) that sentences are drawn to, in place of words."""
    if options.similarity not in similarity.METRICS:
        raise ValueError(f"similarity is one of {similarity.METRICS}")
    if options.similarity in ("word2vec_sim", "bert_sim") and vectors is None and options.method != "random_sentence":
        raise ValueError(f"{options.similarity} needs a table of vectors")
    if options.threshold is not None and not 0 <= options.threshold < 1:
        raise ValueError("the threshold is in [0, 1)")
    size = options.size if options.size is not None else select.DEFAULT_SIZES.get(options.method.replace("_undamped", ""))
    if idf is None and options.similarity == "idf_mod_cosine" and options.method in ("lexrank", "lexrank_undamped"):
        if (found := placed(docs, options.stopwords, options.abbreviations)) is not None:
            return _summaries_in_place(docs, found, options, size)
    if options.method == "random_sentence":
        sents = terms.sentence_rows(docs, options.abbreviations)
        ranked = select.random_sentences(sents, int(size), options.seed).select("doc_id", "sent_ix", F.lit(0.0).alias("score"), "rn")
    else:
        sents = terms.sentence_rows(docs, options.abbreviations)
        keys, tf, weighted = keyed_weights(docs, options.stopwords, idf, options.abbreviations)
        cosine = options.similarity == "idf_mod_cosine"
        graph = weighted if cosine else _edges(options.similarity, tf, weighted, vectors)
        score = centrality.per_document if cosine else centrality.per_document_edges
        if options.method == "lexrank_undamped":
            plain = cosine and options.threshold is None
            scores = centrality.undamped(graph, keys) if plain else score(graph, keys, "undamped", threshold=options.threshold)
        elif options.method == "biased_lexrank" and bias_vectors is not None:
            scores = score(graph, keys, bias=centrality.bias_by_vectors(*bias_vectors), threshold=options.threshold, **CONVERGED)
        elif options.method == "biased_lexrank":
            if options.bias_words is None:
                words = docs.select("doc_id", F.explode(F.split(F.lower("tags"), ",")).alias("term"))
            else:
                words = docs.sparkSession.createDataFrame([(w,) for w in options.bias_words], "term string")
            scores = score(graph, keys, bias=centrality.bias_shares(tf, keys, words), threshold=options.threshold, **CONVERGED)
        elif options.method == "lexrank":
            scores = score(graph, keys, threshold=options.threshold, **CONVERGED)
        else:
            raise ValueError(f"unknown method {options.method}")
        ranked = select.rank_sentences(scores)
    out = select.summaries(ranked, sents, size)
    # a document without sentences has an empty summary
    out = docs.select("doc_id").join(out, "doc_id", "left").select("doc_id", F.coalesce("summary", F.lit("")).alias("summary"))
    if options.limit_fraction is not None:
        out = out.join(docs.select("doc_id", "text"), "doc_id")
        out = out.select("doc_id", T.first_tokens(F.col("summary"), T.token_budget(F.col("text"), options.limit_fraction)).alias("summary"))
    return out


def evaluate(
    pairs: DataFrame, generated: Column, reference: Column, options: rouge.Options = rouge.Options(), lcs: bool = True, mode: str = "individual", metrics: tuple[str, ...] | None = None, token_budget: int | None = None
) -> DataFrame:
    """(pair_id, ref_id, metric, p, r, f) for pairs (pair_id, ...); a reference may be a text or an array of texts.
    mode: individual (a row for each reference), average or best (one for each pair). metrics: rouge-1, ..., rouge-l, rouge-w;
    None: all up to max_n, and the last two if lcs. Texts are cut to the token budget (by sentences, the crossing one cut), to the byte limit (in characters, by sentences), then to the
    word limit, then stemmed."""
    if mode not in ("individual", "average", "best"):
        raise ValueError(f"mode is individual, average or best, not {mode!r}")
    metrics = metrics or (*[f"rouge-{n}" for n in range(1, options.max_n + 1)], *(("rouge-l", "rouge-w") if lcs else ()))
    base = pairs.select("pair_id", generated.alias("g"), reference.alias("r"))
    if isinstance(base.schema["r"].dataType, ArrayType):
        base = base.select("pair_id", "g", F.posexplode("r").alias("ref_id", "r"))
    else:
        base = base.withColumn("ref_id", F.lit(0))

    def cut(c: str) -> Column:
        if not options.byte_limit and not token_budget:
            return F.col(c)
        sents = rouge.truncate_tokens(T.sentences(F.col(c)), token_budget) if token_budget else T.sentences(F.col(c))
        return F.array_join(rouge.truncate_chars(sents, options.byte_limit) if options.byte_limit else sents, ".\n")

    base = base.select("pair_id", "ref_id", cut("g").alias("g"), cut("r").alias("r"))
    parts = []
    if counts := [int(m[6:]) for m in metrics if m[6:].isdigit()]:
        tokens = base.select("pair_id", "ref_id", rouge.score_tokens(F.col("g"), options).alias("hyp"), rouge.score_tokens(F.col("r"), options).alias("ref"))
        tokens = stem.stem_columns(tokens, ["hyp", "ref"]) if options.stemming else tokens
        parts.append(rouge.rouge_ns(tokens, tuple(counts), options))
    if weighted := [m == "rouge-w" for m in metrics if not m[6:].isdigit()]:
        sents = base.select("pair_id", "ref_id", *[rouge.sentence_tokens(F.col(c), options).alias(n) for c, n in (("g", "hyp_sents"), ("r", "ref_sents"))])
        sents = stem.stem_columns(sents, ["hyp_sents", "ref_sents"], nested=True) if options.stemming else sents
        parts += [rouge.rouge_lcs(sents, w, options) for w in weighted]
    scored = reduce(DataFrame.unionByName, [p.select("pair_id", "ref_id", "metric", *[F.col(c).cast("double").alias(c) for c in ("overlap", "evaluated", "reference")], "p", "r", "f") for p in parts])
    if mode == "individual":
        return scored.select("pair_id", "ref_id", "metric", "p", "r", "f")
    out = rouge.average(scored, options).withColumn("ref_id", F.lit(None).cast("int")) if mode == "average" else rouge.best(scored)
    return out.select("pair_id", "ref_id", "metric", "p", "r", "f")


#: Start markers, end markers and noise by kind of corpus.
CLEANING = {
    "AreiosPagos": (T.SUPREME_COURT_STARTS, T.SUPREME_COURT_ENDS, None),
    "STE": (T.STATE_COUNCIL_STARTS, T.STATE_COUNCIL_ENDS, T.STATE_COUNCIL_NOISE),
}


def preprocess(rows: DataFrame, kind: str, starts=(), ends=(), noise: str | None = None, newlines: bool = False, skip: int = 250) -> DataFrame:
    """Clean a raw corpus: kind AreiosPagos needs text and summary, STE needs text and sorts by year. Without markers and
    noise the kind's own ones are taken."""
    if not starts and not ends and noise is None:
        starts, ends, noise = CLEANING.get(kind, ((), (), None))
    if kind == "AreiosPagos":
        rows = tables.drop_nulls(rows, ["text", "summary"])
    elif kind == "STE":
        rows = tables.drop_sentinel(tables.drop_nulls(rows, ["text"]))
    else:
        raise ValueError("kind is AreiosPagos or STE")
    rows = rows.withColumn("text", T.clean_raw(F.col("text"), starts, ends, noise, newlines))
    return tables.sort_by_year(rows, "date", "row_ix", skip) if kind == "STE" else rows


def model_input(rows: DataFrame, k: int, marker: str | None = None, excluded: tuple[str, ...] = (), prefix: bool = False, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """The rows of one subset as a sequence model wants them: clean, section first, white space, categories, prefix."""
    rows = tables.subset(tables.drop_nulls(rows, ["text", "summary"]), k)
    text = T.move_section_first(F.col("text"), marker) if marker else F.col("text")
    rows = tables.exclude_categories(rows.withColumn("text", T.collapse_whitespace(text)), "case_category", excluded)
    if prefix:
        rows = rows.withColumn("text", T.category_prefix(F.coalesce("case_tags", "case_category"), F.col("text")))
    return rows.withColumn("text", T.remove_stopwords(F.col("text"), stopwords)) if stopwords else rows
