"""Quality rules by distribution divergence, in DataFrame expressions only.

A document is rejected when its base counts fail (too few words, too many repeated windows) or when its histogram of
character classes and of common words lie too far, by Jensen-Shannon distance, from every language reference: the
first distance plus half the second may be at most max_distance + slack / sqrt(words), as chance alone moves a short
text's histogram. Below a minimum of characters or words a text is not judged by distance.

References are sums of histograms by language over all documents that pass the base rules, in which one document weighs
as `bound_chars` characters and `bound_words` words at most. They can be saved, loaded and passed in, so that a document's
verdict needn't depend on the batch it came with; without given ones they are made of the input itself. Common words are
known for four languages; a document that names another language is judged by its character classes alone.

Texts are read once: the counts of each document are written to the shared folder, and references and verdicts are made
from those.

Defined results: null and empty texts have zero counts and fail the base rule; rows are judged one by one, so ties,
repeated rows and repeated ids keep one result each; an empty table gives an empty result; without any reference
(no document in a known language) only the base rule decides; a null language, or a table without the column, is judged
by both histograms. Extra columns of the input, whatever their names, are ignored by `score` and kept by `keep`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.names import free_prefix
from corpusloom.runtime import settle, table

#: Frequent short words of four languages, ten each.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "was", "for", "with"],
    "fr": ["de", "la", "le", "et", "les", "des", "un", "une", "dans", "pour"],
    "de": ["der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "ist"],
    "es": ["que", "el", "en", "los", "se", "del", "las", "por", "con", "para"],
}
#: Character classes besides lower-case letters and white space, as patterns.
CHAR_CLASSES = {
    "upper": r"[\p{Lu}\p{Lt}]+",
    "digit": r"[0-9]+",
    "stop": r"[.,;:?'\"()\-]+",
    "bang": r"[!]+",
    "symbol": r"[#*$%&|<>]+",
}
WHITE = " \t\n\x0b\x0c\r"
CODES = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


@dataclass(frozen=True)
class Options:
    """min_chars, min_words: guards below which distances aren't judged. max_distance, slack: see the module."""

    min_chars: int = 60
    min_words: int = 20
    max_distance: float = 0.25
    slack: float = 0.4
    bound_chars: int = 2_000
    bound_words: int = 400
    base_words: int = 10
    base_repeat_percent: int = 20


def vocabulary() -> list[str]:
    return list(dict.fromkeys(w for ws in COMMON_WORDS.values() for w in ws))


def _gone(text: Column, pattern: str) -> Column:
    """Characters of the text that the pattern takes away."""
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def with_counts(docs: DataFrame, prefix: str = "_q_") -> DataFrame:
    """Add the base counts and both histograms to whole documents; columns begin with the prefix."""
    p = prefix
    c = lambda name: F.col(p + name)
    vocab = vocabulary()
    forms = vocab + [w.capitalize() for w in vocab]
    code = F.map_from_arrays(F.array(*map(F.lit, forms)), F.array(*[F.lit(CODES[vocab.index(w.lower())]) for w in forms]))
    d = docs.withColumn(p + "text", F.coalesce(F.col("text"), F.lit("")))
    d = d.withColumn(p + "core", F.trim(c("text"), F.lit(WHITE)))
    d = d.withColumn(p + "words", F.when(c("core") == "", F.array().cast("array<string>")).otherwise(F.split(c("core"), r"[ \t-\r]+")))
    d = d.withColumns(
        {
            p + "n_words": F.size(c("words")).cast("long"),
            p + "word_chars": F.char_length(F.array_join(c("words"), "")).cast("long"),
            p + "rest": F.regexp_replace(c("text"), r"[\p{Ll} \t-\r]+", ""),
            p + "lines": F.filter(F.split(c("text"), "\n", -1), lambda x: x.rlike(r"[^ \t-\r]")),
            p + "hashes": F.transform(c("words"), lambda x: F.xxhash64(x)),
            p + "codes": F.array_join(F.transform(F.filter(c("words"), lambda x: x.isin(forms)), lambda x: F.element_at(code, x)), ""),
        }
    )
    window = F.transform(
        F.sequence(F.lit(0), F.size(c("words")) - 5),
        lambda i: F.xxhash64(*[F.get(c("hashes"), i + k) for k in range(5)]),
    )
    d = d.withColumns(
        {
            p + "windows": F.when(c("n_words") >= 5, window).otherwise(F.array().cast("array<bigint>")),
            p + "n_dup_lines": (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long"),
            **{p + name: _gone(c("rest"), pattern).cast("long") for name, pattern in CHAR_CLASSES.items()},
        }
    )
    d = d.withColumn(
        p + "sorted",
        F.when(
            F.size(F.array_distinct(c("windows"))) < F.size(c("windows")),
            F.sort_array(F.transform(c("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    same = lambda x, j: F.coalesce(F.get(c("sorted"), j)["h"] == x["h"], F.lit(False))
    d = d.withColumn(
        p + "again",
        F.sort_array(F.transform(F.filter(c("sorted"), lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])),
    )
    steps = F.zip_with(
        F.slice(c("again"), F.lit(1), F.size(c("again")) - 1),
        F.slice(c("again"), F.lit(2), F.size(c("again")) - 1),
        lambda a, b: F.least(F.lit(5), b - a),
    )
    other = F.char_length(c("rest")) - sum((c(n) for n in CHAR_CLASSES), F.lit(0).cast("long"))
    white = F.char_length(c("text")) - c("word_chars")
    lower = c("word_chars") - F.char_length(c("rest"))
    counts = [F.char_length(c("codes")) - F.char_length(F.replace(c("codes"), F.lit(CODES[k]))) for k in range(len(vocab))]
    d = d.withColumns(
        {
            p + "n_symbols": c("symbol"),
            p + "n_repeat_words": F.when(c("again").isNull(), F.lit(0)).otherwise(F.aggregate(steps, F.lit(5), lambda s, x: s + x)).cast("long"),
            p + "chars": F.array(*[x.cast("long") for x in [lower, white, *[c(n) for n in CHAR_CLASSES], other]]),
            p + "common": F.array(*[x.cast("long") for x in [*counts, c("n_words") - F.char_length(c("codes"))]]),
        }
    )
    return d.drop(*[p + x for x in ("text", "core", "words", "rest", "lines", "hashes", "codes", "windows", "sorted", "again", *CHAR_CLASSES)])


def counted(docs: DataFrame, options: Options = Options(), prefix: str = "_q_") -> DataFrame:
    """`with_counts` and whether the base rules reject the document."""
    d, c = with_counts(docs, prefix), lambda name: F.col(prefix + name)
    failed = (c("n_words") < options.base_words) | (100 * c("n_repeat_words") > options.base_repeat_percent * c("n_words"))
    return d.withColumn(prefix + "base_failed", failed)


def references(counts: DataFrame, options: Options = Options(), prefix: str = "_q_", lang: str = "lang") -> DataFrame:
    """(lang, chars, common): sums of both histograms of counted documents, one row for each known language."""
    n_chars, n_words = len(CHAR_CLASSES) + 3, len(vocabulary()) + 1
    some = counts.filter(F.col(lang).isin(*COMMON_WORDS) & ~F.col(prefix + "base_failed"))

    def sums(name: str, n: int, bound: int) -> list[Column]:
        total = F.aggregate(F.col(prefix + name), F.lit(0).cast("long"), lambda s, x: s + x)
        weight = F.least(total, F.lit(bound)) / F.greatest(total, F.lit(1))
        return [F.sum(F.col(prefix + name)[k] * weight).alias(f"{name}{k}") for k in range(n)]

    rows = some.groupBy(F.col(lang).alias("lang")).agg(*sums("chars", n_chars, options.bound_chars), *sums("common", n_words, options.bound_words))
    return rows.select("lang", F.array(*[f"chars{k}" for k in range(n_chars)]).alias("chars"), F.array(*[f"common{k}" for k in range(n_words)]).alias("common"))


def save_references(refs: DataFrame, path: str) -> None:
    refs.write.mode("overwrite").parquet(path)


def load_references(spark, path: str) -> DataFrame:
    return spark.read.schema("lang string, chars array<double>, common array<double>").parquet(path)


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
    return F.transform(counts, lambda x: x / F.greatest(total, F.lit(1)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of shares."""
    term = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    parts = F.zip_with(p, q, lambda a, b: term(a, b) + term(b, a))
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def _nearest(shares: Column, refs: list[list[float]]) -> Column:
    """The least distance to the references that have any count."""
    found = []
    for ref in refs:
        if total := sum(ref):
            found.append(js_distance(shares, F.array(*[F.lit(x / total) for x in ref])))
    return F.least(*found) if len(found) > 1 else found[0] if found else F.lit(None).cast("double")


def judge(counts: DataFrame, refs: DataFrame, options: Options = Options(), prefix: str = "_q_", lang: str = "lang") -> DataFrame:
    """Add distances and verdict to counted documents; of the references there is one row for each known language."""
    c = lambda name: F.col(prefix + name)
    known = refs.orderBy("lang").limit(len(COMMON_WORDS)).collect()
    d = counts.withColumns({prefix + "char_shares": _shares(c("chars")), prefix + "word_shares": _shares(c("common"))})
    d = d.withColumns(
        {
            prefix + "char_distance": _nearest(c("char_shares"), [r["chars"] for r in known]),
            prefix + "word_distance": _nearest(c("word_shares"), [r["common"] for r in known]),
        }
    )
    n_chars = F.aggregate(c("chars"), F.lit(0).cast("long"), lambda s, x: s + x)
    by_words = F.coalesce(F.col(lang).isin(*COMMON_WORDS), F.lit(True))
    distance = F.coalesce(c("char_distance"), F.lit(0.0)) + F.when(by_words, F.coalesce(c("word_distance"), F.lit(0.0)) / 2).otherwise(0.0)
    allowed = options.max_distance + options.slack / F.sqrt(F.greatest(c("n_words"), F.lit(1)))
    far = (distance > allowed) & (n_chars >= options.min_chars) & (c("n_words") >= options.min_words)
    return d.withColumn(prefix + "kept", ~c("base_failed") & ~far)


def _lang(docs: DataFrame) -> Column:
    return F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")


def score(docs: DataFrame, options: Options = Options(), refs: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, the counts, both distances, base_failed and kept."""
    counts = counted(docs.select("doc_id", "text", _lang(docs).alias("lang")), options).drop("text")
    if refs is None:
        counts = settle(counts, "quality-counts")
        refs = references(counts, options)
    d = judge(counts, refs, options)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance", "base_failed", "kept")
    return d.select("doc_id", *[F.col("_q_" + n).alias(n) for n in names])


def keep(docs: DataFrame, options: Options = Options(), refs: DataFrame | None = None) -> DataFrame:
    """The documents that are kept, with the columns that came in."""
    columns, prefix = docs.columns, free_prefix(docs.columns)
    lang = prefix + "lang"
    # settled even with given references: a filter moved below the projection would repeat its expressions
    counts = settle(counted(docs.withColumn(lang, _lang(docs)), options, prefix), "quality-counted")
    refs = references(counts, options, prefix, lang) if refs is None else refs
    return judge(counts.filter(~F.col(prefix + "base_failed")), refs, options, prefix, lang).filter(F.col(prefix + "kept")).select(*[F.col(f"`{c}`") for c in columns])


def query(spark, sf_dir: str) -> DataFrame:
    d = score(table(spark, sf_dir, "documents"))
    return d.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def _oracle() -> str:
    options, vocab = Options(), vocabulary()
    gone = lambda p: f"length(rest) - length(regexp_replace(rest, '{p}', '', 'g'))"
    classes = ", ".join(gone(p.replace("'", "''")) for p in CHAR_CLASSES.values())
    words = "[" + ", ".join(f"'{w}'" for w in vocab) + "]"
    capitals = "[" + ", ".join(f"'{w.capitalize()}'" for w in vocab) + "]"
    langs = ", ".join(f"'{x}'" for x in COMMON_WORDS)
    term = "CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"

    def distance(name: str, n: int) -> str:
        both = " + ".join(term.format(a=a, b=b) for a, b in ((f"d.{name}[i] / greatest(d.{name}_n, 1)", f"r.{name}[i] / r.{name}_n"), (f"r.{name}[i] / r.{name}_n", f"d.{name}[i] / greatest(d.{name}_n, 1)")))
        return f"min(sqrt(greatest(list_sum(list_transform(range(1, {n + 1}), lambda i: {both})) / 2, 0)))"

    n_chars, n_words = len(CHAR_CLASSES) + 3, len(vocab) + 1
    weight = lambda c: f"least(list_sum({c}), {options.bound_chars if c == 'chars' else options.bound_words}) / greatest(list_sum({c}), 1)"
    sums = ", ".join(f"[{', '.join(f'sum({c}[{k}] * {weight(c)})' for k in range(1, n + 1))}] AS {c}" for c, n in (("chars", n_chars), ("common", n_words)))
    return rf"""
WITH a AS (SELECT doc_id, lang, coalesce(text, '') AS t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS c FROM documents),
b AS MATERIALIZED (
  SELECT doc_id, lang, t, CASE WHEN trim(t, c) = '' THEN [] ELSE regexp_split_to_array(trim(t, c), '[ \t-\r]+') END AS w,
    regexp_replace(t, '[\p{{Ll}} \t-\r]+', '', 'g') AS rest, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines FROM a),
win AS (SELECT doc_id, k, array_to_string(w[k:k + 4], ' ') AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM b WHERE len(w) >= 5)),
again AS (SELECT doc_id, unnest(range(k, k + 5)) AS p FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, h) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM again GROUP BY 1),
f AS (SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, ({gone(CHAR_CLASSES['symbol'])})::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, length(t) AS n_t, length(rest) AS n_rest, [{classes}] AS cls,
    list_transform(range(1, {n_words}), lambda k: len(list_filter(w, lambda x: x = {words}[k] OR x = {capitals}[k]))) AS hits FROM b),
g AS MATERIALIZED (SELECT doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    list_concat([word_chars - n_rest, n_t - word_chars], list_concat(cls, [n_rest - list_sum(cls)]))::DOUBLE[] AS chars,
    list_concat(hits, [n_words - list_sum(hits)])::DOUBLE[] AS common FROM f LEFT JOIN rep USING (doc_id)),
d AS (SELECT *, list_sum(chars) AS chars_n, list_sum(common) AS common_n, n_words < {options.base_words} OR 100 * n_repeat_words > {options.base_repeat_percent} * n_words AS base_failed FROM g),
r AS (SELECT *, list_sum(chars) AS chars_n, list_sum(common) AS common_n FROM (SELECT lang, {sums} FROM d WHERE lang IN ({langs}) AND NOT base_failed GROUP BY lang)),
m AS (SELECT d.doc_id, {distance('chars', n_chars)} AS cd, {distance('common', n_words)} AS wd FROM d, r GROUP BY d.doc_id),
j AS (SELECT d.*, cd, wd, CASE WHEN lang NOT IN ({langs}) THEN 0 ELSE wd END AS judged FROM d JOIN m USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, round(cd, 6) AS char_distance, round(wd, 6) AS word_distance, base_failed,
  NOT base_failed AND NOT (cd + judged / 2 > {options.max_distance} + {options.slack} / sqrt(greatest(n_words, 1)) AND chars_n >= {options.min_chars} AND n_words >= {options.min_words}) AS kept
FROM j
"""


ORACLE_SQL = _oracle()
