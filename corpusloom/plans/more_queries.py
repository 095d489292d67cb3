"""Further named queries and their SQL: helpers of cleaning, cutting, scoring, reading and writing over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import meteor, pages, rouge, tables
from corpusloom.plans.queries import _PAIRS, _gram_sql, _pairs, _prf_sql, _rounded, docs, query
from corpusloom.runtime import scratch, table
from corpusloom.sources import named_files, readers, writers


@query("SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[ \\t-\\r]+', ' ', 'g'), '[^\\p{L}\\p{N}\\- ]', '', 'g') AS text FROM documents")
def clean_letters(spark, d):
    return docs(spark, d).select("doc_id", T.clean_text(F.col("text")).alias("text"))


@query(
    "SELECT doc_id, regexp_replace(text, '([.,;:¡!¿?…⋯&‹›«»\"“”\\[\\]()⟨⟩}{/|\\\\])', ' \\1 ', 'g') AS text, replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;'), chr(10), '<br/>') AS escaped, "
    "array_to_string(string_split(text, ' ')[:20], ' ') AS first_subwords, lang IN ('[SEP]', '[MASK]', '[CLS]', '[UNK]', '[PAD]') AS special, doc_id || '/' || n_chars AS label, n_chars::INTEGER AS parsed FROM documents"
)
def text_helpers(spark, d):
    return docs(spark, d).select(
        "doc_id",
        T.separate_punctuation(F.col("text")).alias("text"),
        T.escape_html(F.col("text")).alias("escaped"),
        T.first_subwords(F.split("text", " ", -1), 20, keep_special=True).alias("first_subwords"),
        T.is_special_token(F.col("lang")).alias("special"),
        pages.year_label(F.col("doc_id").cast("string"), F.col("n_chars").cast("string")).alias("label"),
        T.parse_count(F.concat(F.lit("("), F.col("n_chars").cast("string"), F.lit(")"))).alias("parsed"),
    )


@query(
    "WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, l, list_position(list_transform(l, lambda x: contains(x, 'en')), true) AS k FROM a) "
    "SELECT doc_id, CASE WHEN k > 0 THEN l[k + CASE WHEN contains(l[k], 'es') THEN 2 ELSE 1 END] END AS court FROM b"
)
def court_lines(spark, d):
    lines = F.split("text", "\n", -1)
    return docs(spark, d).filter("text IS NOT NULL").select("doc_id", pages.court_type(lines, "en", "es").alias("court"))


@query(
    "WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS a, string_split(text, '. ') AS b FROM documents WHERE text IS NOT NULL), "
    "t AS (SELECT doc_id, array_to_string(CASE WHEN len(a) >= len(b) THEN a ELSE b END, chr(10)) AS t FROM a) "
    "SELECT doc_id, CASE WHEN contains(t, ' de ') THEN array_to_string(string_split(t, ' de ')[2:], chr(10)) ELSE t END AS body, starts_with(t, 'The') OR starts_with(t, 'Die') AS is_summary FROM t"
)
def body_fallback(spark, d):
    a, b = F.split("text", "\n", -1), F.split("text", r"\. ", -1)
    rows = docs(spark, d).filter("text IS NOT NULL").select("doc_id", pages.body_or_fallback(a, b, " de ").alias("body"), F.array_join(F.when(F.size(a) >= F.size(b), a).otherwise(b), "\n").alias("t"))
    return rows.select("doc_id", "body", pages.starts_with_summary(F.col("t"), ("The", "Die")).alias("is_summary"))


_SUPREME = "'αρχή  ' || CASE WHEN doc_id % 2 = 0 THEN 'ΣΚΕΦΘΗΚΕ ΣΥΜΦΩΝΑ ΜΕ ΤΟΝ ΝΟΜΟ' ELSE 'Σκέφθηκε σύμφωνα με το νόμο' END || ' ' || text || CASE WHEN doc_id % 3 = 0 THEN 'ΚΡΙΘΗΚΕ, αποφασίσθηκε' ELSE '' END || ' τέλος'"


@query(
    f"WITH p AS (SELECT doc_id, {_SUPREME} AS t FROM documents), s AS (SELECT doc_id, trim(regexp_replace(t, '^αρχή  (ΣΚΕΦΘΗΚΕ ΣΥΜΦΩΝΑ ΜΕ ΤΟΝ ΝΟΜΟ|Σκέφθηκε σύμφωνα με το νόμο)', ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM p), "
    "e AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN trim(replace(t, 'ΚΡΙΘΗΚΕ, αποφασίσθηκε τέλος', ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) ELSE t END AS t FROM s) "
    "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, ' +', ' ', 'g'), '\\n+', chr(10), 'g'), '\\t+', chr(9), 'g') AS text FROM e"
)
def clean_supreme(spark, d):
    start = F.when(F.col("doc_id") % 2 == 0, F.lit(T.SUPREME_COURT_STARTS[1])).otherwise(F.lit(T.SUPREME_COURT_STARTS[3]))
    end = F.when(F.col("doc_id") % 3 == 0, F.lit(T.SUPREME_COURT_ENDS[1])).otherwise(F.lit(""))
    raw = F.concat(F.lit("αρχή  "), start, F.lit(" "), F.col("text"), end, F.lit(" τέλος"))
    return docs(spark, d).select("doc_id", T.clean_supreme_court(raw).alias("text"))


_SENTENCES = "SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\\n]+'), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS s FROM documents WHERE text IS NOT NULL"


@query(
    f"WITH s AS ({_SENTENCES}), w AS (SELECT doc_id, unnest(list_transform(s, lambda x, i: {{'i': i - 1, 't': regexp_extract_all(lower(x), '[\\p{{L}}]+')}})) AS x FROM s), "
    "r AS (SELECT doc_id, x.i AS sent_ix, x.t AS t, 50 - coalesce(sum(len(x.t)) OVER (PARTITION BY doc_id ORDER BY x.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM w) "
    "SELECT doc_id, sent_ix::INTEGER AS sent_ix, array_to_string(t[:least(len(t), room)::INTEGER], ' ') AS tokens FROM r WHERE room > 0"
)
def sentence_budget(spark, d):
    rows = docs(spark, d).filter("text IS NOT NULL").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sent_ix", "s"))
    cut = rouge.truncate_sentences(rows.select("doc_id", "sent_ix", T.words(F.col("s")).alias("tokens")), 50)
    return cut.select("doc_id", "sent_ix", F.array_join("tokens", " ").alias("tokens"))


@query(
    f"WITH s AS ({_SENTENCES}), c AS (SELECT doc_id, s, list_transform(range(0, len(s)), lambda i: 300 - coalesce(list_sum(list_transform(s[:i], lambda x: length(x))), 0)) AS room FROM s) "
    "SELECT doc_id, array_to_string(list_filter(list_transform(range(1, len(s) + 1), lambda i: CASE WHEN room[i] > 0 THEN s[i][:room[i]::INTEGER] END), lambda x: x IS NOT NULL), '|') AS cut FROM c"
)
def byte_budget(spark, d):
    return docs(spark, d).filter("text IS NOT NULL").select("doc_id", F.array_join(rouge.truncate_chars(T.sentences(F.col("text")), 300), "|").alias("cut"))


@query(f"WITH {_PAIRS.replace('pairs AS', 'whole AS', 1)}, pairs AS MATERIALIZED (SELECT pair_id, ref_id, hyp[:100] AS hyp, ref[:100] AS ref FROM whole), {_gram_sql(2)} " + _prf_sql("c2", "pair_id, ref_id"))
def rouge_2_words(spark, d):
    cut = _pairs(spark, d).withColumns({c: F.slice(c, 1, rouge.Options().word_limit) for c in ("hyp", "ref")})
    return _rounded(rouge.rouge_n(cut, 2), ["pair_id", "ref_id"])


@query(
    "SELECT doc_id, u.w AS word, u.n AS letters FROM (SELECT doc_id, unnest(list_transform(string_split(text, ' '), lambda x: {'w': x, 'n': length(x)::INTEGER})) AS u FROM documents WHERE text IS NOT NULL)"
)
def zipped_lists(spark, d):
    rows = docs(spark, d).filter("text IS NOT NULL").select("doc_id", F.split("text", " ", -1).alias("word"))
    return tables.zip_equal(rows.withColumn("letters", F.transform("word", lambda w: F.char_length(w))), ["word", "letters"])


@query("SELECT client_id, name, email FROM clients WHERE name IS NOT NULL AND email IS NOT NULL AND city IS NOT NULL")
def valid_clients(spark, d):
    return tables.valid_items(table(spark, d, "clients"), ["name", "email", "city"]).select("client_id", "name", "email")


@query("SELECT least(floor((n_chars - 0.0) / 5000.0 * 50), 49)::INTEGER AS x_bin, least(floor((length(text) - length(replace(text, ' ', ''))) / 1000.0 * 50), 49)::INTEGER AS y_bin, count(*) AS n FROM documents WHERE n_chars BETWEEN 0 AND 5000 AND length(text) - length(replace(text, ' ', '')) BETWEEN 0 AND 1000 GROUP BY ALL")
def length_histogram(spark, d):
    blanks = F.char_length("text") - F.char_length(F.replace(F.col("text"), F.lit(" "), F.lit("")))
    return tables.histogram_2d(docs(spark, d).select("n_chars", blanks.alias("blanks")), "n_chars", "blanks", (0.0, 5000.0), (0.0, 1000.0))


@query("SELECT doc_id AS row_ix, text, lang AS case_category FROM documents")
def csv_round_trip(spark, d):
    """Written as CSV with line feeds and quotes inside, and read with a schema."""
    path = f"{scratch(spark)}/csv-{uuid.uuid4().hex}"
    rows = docs(spark, d).select(F.col("doc_id").alias("row_ix"), "text", F.col("lang").alias("case_category"))
    writers.write_table(rows, path)
    return readers.read_csv(spark, path, "row_ix long, text string, case_category string", keep_empty=True)


@query("SELECT item_id + 1 AS ix, text, 'about ' || left(text, 40) AS summary FROM benchmark WHERE item_id >= 0")
def case_folders(spark, d):
    """Every item as a pair of named files, read again and paired by their numbers."""
    folder = f"{scratch(spark)}/cases-{uuid.uuid4().hex}"
    rows = table(spark, d, "benchmark").select("item_id", "text", F.concat(F.lit("about "), F.left("text", F.lit(40))).alias("summary"))
    named_files.write_case_dirs(rows, folder, "item_id")
    return readers.read_case_dirs(spark, folder).filter("ix IS NOT NULL").select(F.col("ix").cast("long").alias("ix"), "text", "summary")


@query("SELECT a.item_id AS ix, a.text AS generated, b.text AS reference FROM benchmark a JOIN documents b ON a.item_id = b.doc_id WHERE a.item_id % 5 <> 0")
def index_pairs(spark, d):
    made = table(spark, d, "benchmark").filter("item_id % 5 <> 0").select(F.col("item_id").alias("ix"), "text")
    return readers.pair_observed(made, docs(spark, d).select(F.col("doc_id").alias("ix"), "text"))[0]


@query(
    f"WITH {_PAIRS}, {_gram_sql(1)}, s AS ({_prf_sql('c1', 'pair_id, ref_id', 12)}) SELECT pair_id, ref_id, chr(9) || 'rouge-1:' || chr(9) || printf('P: %5.2f', 100 * p) || chr(9) || printf('R: %5.2f', 100 * r) || chr(9) || printf('F1: %5.2f', 100 * f) AS line FROM s"
)
def result_lines(spark, d):
    scored = rouge.rouge_n(_pairs(spark, d), 1)
    return rouge.result_line(scored.withColumns({c: F.round(c, 12) for c in "prf"})).select("pair_id", "ref_id", "line")


#: Words of a run that an item and a document must share to be compared.
RUN = 8


def _runs(words):
    at = F.sequence(F.lit(1), F.size(words) - RUN + 1)
    return F.when(F.size(words) >= RUN, F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(words, i, RUN), " "))))


_WORDS = "regexp_extract_all(lower(text), '[\\p{L}]+')"


@query(
    f"WITH i AS MATERIALIZED (SELECT item_id, {_WORDS} AS hyp FROM benchmark), d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS ref FROM documents), "
    f"a AS (SELECT DISTINCT item_id, array_to_string(hyp[k:k + {RUN - 1}], ' ') AS g FROM (SELECT item_id, hyp, unnest(range(1, len(hyp) - {RUN - 2})) AS k FROM i)), "
    f"b AS (SELECT doc_id, array_to_string(ref[k:k + {RUN - 1}], ' ') AS g FROM (SELECT doc_id, ref, unnest(range(1, len(ref) - {RUN - 2})) AS k FROM d)), "
    "pairs AS MATERIALIZED (SELECT item_id AS pair_id, doc_id AS ref_id, hyp, ref FROM (SELECT DISTINCT item_id, doc_id FROM a JOIN b USING (g)) JOIN i USING (item_id) JOIN d USING (doc_id)), "
    f"{_gram_sql(1)} {_prf_sql('c1', 'pair_id, ref_id')}"
)
def benchmark_overlap(spark, d):
    """Items of the benchmark against the documents that share a run of words with them: how much of an item a document holds."""
    words = T.words(F.col("text"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("pair_id"), words.alias("hyp"))
    texts = docs(spark, d).select(F.col("doc_id").alias("ref_id"), words.alias("ref"))
    asked = items.select("pair_id", F.explode(_runs("hyp")).alias("run"))
    held = texts.select("ref_id", F.explode(_runs("ref")).alias("run"))
    pairs = held.join(asked, "run").select("pair_id", "ref_id").distinct()
    return _rounded(rouge.rouge_n(pairs.join(items, "pair_id").join(texts, "ref_id"), 1), ["pair_id", "ref_id"])


_OCCURRENCE = "SELECT pair_id, ref_id, p, w, row_number() OVER (PARTITION BY pair_id, ref_id, w ORDER BY p DESC) AS k FROM (SELECT pair_id, ref_id, unnest(range(1, len({c}) + 1)) AS p, unnest({c}) AS w FROM pairs)"


@query(
    f"WITH {_PAIRS}, h AS ({_OCCURRENCE.format(c='hyp')}), g AS ({_OCCURRENCE.format(c='ref')}), "
    "m AS (SELECT pair_id, ref_id, h.p AS i, g.p AS j FROM h JOIN g USING (pair_id, ref_id, w, k)), "
    "s AS (SELECT *, CASE WHEN lag(i) OVER o = i - 1 AND lag(j) OVER o = j - 1 THEN 0 ELSE 1 END AS fresh FROM m WINDOW o AS (PARTITION BY pair_id, ref_id ORDER BY i)), "
    "n AS (SELECT pair_id, ref_id, count(*) AS m, sum(fresh) AS c FROM s GROUP BY ALL), "
    "x AS (SELECT pair_id, ref_id, coalesce(m, 0)::BIGINT AS matches, coalesce(c, 0)::BIGINT AS chunks, m::DOUBLE / len(hyp) AS p, m::DOUBLE / len(ref) AS r FROM pairs LEFT JOIN n USING (pair_id, ref_id)) "
    "SELECT pair_id, ref_id, matches, chunks, round(CASE WHEN matches > 0 THEN p * r / (0.9 * p + (1 - 0.9) * r) * (1 - 0.5 * pow(chunks / matches, 3)) ELSE 0 END, 6) AS score FROM x"
)
def meteor_exact(spark, d):
    scored = meteor.meteor(_pairs(spark, d), meteor.Options(stemmed=False))
    return scored.select("pair_id", "ref_id", "matches", "chunks", F.round("score", 6).alias("score"))


@query()
def meteor_stemmed(spark, d):
    return meteor.meteor(_pairs(spark, d)).select("pair_id", "ref_id", "matches", "chunks", F.round("score", 6).alias("score"))
