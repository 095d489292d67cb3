"""Learned sentence boundaries: abbreviations, collocations and sentence starters from the counts of a corpus.

The statistics are those of Kiss and Strunk, "Unsupervised multilingual sentence boundary detection" (2006). A word is an abbreviation when
its full stop belongs to it more often than chance has it, by a log-likelihood ratio, weighted for short words, inner
full stops and against occurrences without one. Words that follow a sure sentence end more often than chance are
starters; an abbreviation, initial or number with the word that follows it more often than chance is a collocation.

All counts are sums by word over all documents, pre-aggregated before they are shuffled. A model has every entry that
reaches its least score; entries are words and pairs of words, a small part of the vocabulary, and are broadcast. Sentences are
cut where a text lies: only tokens that may end one are looked at, and equal ones with equal followers once a worker.

Defined results: null texts have no sentence, null or blank ones an empty list; equal scores go by the word; an empty
corpus gives an empty model, with which every full stop ends a sentence."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from unicodedata import category

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.runtime import settle, ship

TOKEN = r"[^ \t-\r]+"
SPACED = r"[ \t-\r]*[^ \t-\r]+"
_OPEN, _CLOSE = r"""^[("'«“\[¿¡]+""", r"""[)"'»”\],;:]+$"""


@dataclass(frozen=True)
class Options:
    """The least scores of the paper. smooth: the chance of a full stop behind an abbreviation."""

    abbreviation: float = 0.3
    collocation: float = 7.88
    starter: float = 30.0
    smooth: float = 0.99


@dataclass(frozen=True)
class Model:
    abbreviations: list[str] = field(default_factory=list)
    starters: list[str] = field(default_factory=list)
    #: Pairs of words, parted by a blank.
    collocations: list[str] = field(default_factory=list)


def core(token: Column) -> Column:
    """A token without signs around it; its full stop stays."""
    return F.regexp_replace(F.regexp_replace(token, _OPEN, ""), _CLOSE, "")


def has_stop(token: Column) -> Column:
    return _stopped(core(token))


def _stopped(bare: Column) -> Column:
    return bare.rlike(r"[^.]\.$")


def form(token: Column) -> Column:
    """What is counted: the lower-cased token without signs around it and without its full stop; numbers are one word."""
    return _form(core(token))


def _form(bare: Column) -> Column:
    word = F.regexp_replace(F.lower(bare), r"[.!?]+$", "")
    return F.when(word.rlike(r"^[0-9]+([.,][0-9]+)*$"), "##").otherwise(word)


def token_pairs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, stop, ends, next): every token's form, whether it has a full stop, whether ! or ? ends it, and the next form."""
    tokens = F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0))
    rows = docs.select(tokens.alias("t")).filter(F.size("t") > 0)
    rows = rows.select(F.inline(F.arrays_zip(F.col("t").alias("a"), F.slice("t", F.lit(2), F.size("t")).alias("b"))))
    return rows.select(form(F.col("a")).alias("word"), has_stop(F.col("a")).alias("stop"), core(F.col("a")).rlike("[!?]$").alias("ends"), form(F.col("b")).alias("next"))


#: Without such an end a token has no full stop and isn't ended by ! or ?.
_SIGNED = r"""[.!?][)"'»”\],;:]*$"""
_WHITE = " \t\n\v\f\r"
#: Where Java's $ stands: at the end, or before a last line terminator that isn't white space of tokens.
_LAST = "(?=[\u0085\u2028\u2029]?\\Z)"
_ONLY_OPEN, _ONLY_CLOSE = re.compile(_OPEN), re.compile(_CLOSE[:-1] + _LAST)
_MARKS, _NUMBER = re.compile("[.!?]+" + _LAST), re.compile(f"[0-9]+([.,][0-9]+)*{_LAST}")
_SURE, _DOTS, _STOP, _INITIAL = (re.compile(x + _LAST) for x in ("[!?]", r"\.\.", r"[^.]\.", r"(?s:.)\."))
#: What a token ends in that may end a sentence, where all white space is blanks; and the token after it.
_CANDIDATE, _NEXT = re.compile(_SIGNED.replace("[)", "[\u0085\u2028\u2029)")[:-1] + "(?= |\\Z)"), re.compile(" *([^ ]+)")
#: Different tokens and pairs that a task counts before it gives counts back.
_HELD = 300_000


def _bared(token: str) -> str:
    """`core` of one token."""
    return _ONLY_CLOSE.sub("", _ONLY_OPEN.sub("", token))


def _formed(bare: str) -> str:
    """`form` of a token without signs around it."""
    word = _MARKS.sub("", bare.lower())
    return "##" if _NUMBER.match(word) else word


def _blanked(text: str) -> str:
    for c in _WHITE[1:]:
        text = text.replace(c, " ")
    return text


def _signed(plain: str) -> Iterator[tuple[int, str, str | None]]:
    """(end, token, the next one) of each token that may have a full stop or be ended by ! or ?."""
    for m in _CANDIDATE.finditer(plain):
        after = _NEXT.match(plain, m.end())
        yield m.end(), plain[plain.rfind(" ", 0, m.start()) + 1 : m.end()], after and after[1]


def _count_rows(tokens: Counter, pairs: Counter) -> pa.RecordBatch:
    """Rows of `_counts`; all tokens of pairs are among the tokens, and each is looked at once."""
    words: dict[str, list[int]] = {}
    known = {}
    for token, c in tokens.items():
        bare = _bared(token)
        word, stop = _formed(bare), bool(_STOP.search(bare))
        known[token] = word, stop, bare
        held = words.setdefault(word, [0, 0])
        held[0] += c
        held[1] += c if stop else 0
    found: Counter = Counter()
    for (token, after), c in pairs.items():
        word, stop, bare = known[token]
        ends = not stop and bool(_SURE.search(bare))
        if stop or ends:
            found[word, None if after is None else known[after][0], stop, ends] += c
    none = [None] * len(words)
    columns = [[*words, *(k[0] for k in found)], *(none + [k[i] for k in found] for i in (1, 2, 3)), [w[0] for w in words.values()] + list(found.values()), [w[1] for w in words.values()] + [0] * len(found)]
    kinds = [pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["word", "next", "stop", "ends", "c", "stops"])


def _counts(docs: DataFrame, text: str) -> DataFrame:
    """(word, next, stop, ends, c, stops): `token_counts`, as rows with null stop, and `signed_pairs`, from one pass over the texts."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, pairs = Counter(), Counter()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                if x is None:
                    continue
                plain = _blanked(x)
                tokens.update(plain.split(" "))
                pairs.update((token, after) for _, token, after in _signed(plain))
                if len(tokens) + len(pairs) > _HELD:
                    tokens.pop("", None)
                    yield _count_rows(tokens, pairs)
                    tokens, pairs = Counter(), Counter()
        tokens.pop("", None)
        yield _count_rows(tokens, pairs)

    rows = docs.select(F.col(text)).mapInArrow(run, "word string, next string, stop boolean, ends boolean, c long, stops long")
    return rows.groupBy("word", "next", "stop", "ends").agg(F.sum("c").alias("c"), F.sum("stops").alias("stops"))


def signed_pairs(docs: DataFrame, text: str = "text") -> DataFrame:
    """`token_pairs` of the tokens with a full stop or ended by ! or ?, counted (c). Other tokens never leave their document."""
    return _pair_rows(_counts(docs, text))


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """`word_counts` of all tokens. Equal tokens are counted before they are looked at, so each is cut to its form once a task."""
    return _word_rows(_counts(docs, text))


def _pair_rows(counted: DataFrame) -> DataFrame:
    return counted.filter("stop IS NOT NULL").select("word", "stop", "ends", "next", "c")


def _word_rows(counted: DataFrame) -> DataFrame:
    return counted.filter("stop IS NULL").select("word", F.col("c").alias("n"), "stops")


def _log(x: Column) -> Column:
    return F.ln(F.greatest(x, F.lit(1e-300)))


def ratio(a: Column, b: Column, both: Column, n: Column) -> Column:
    """-2 log-likelihood ratio that b follows a by chance, of their counts, against any other rate."""
    like = lambda k, m, p: k * _log(p) + (m - k) * _log(1 - p)
    p, p1, p2 = b / n, both / a, (b - both) / F.greatest(n - a, F.lit(1))
    return -2 * (like(both, a, p) + like(b - both, n - a, p) - like(both, a, p1) - like(b - both, n - a, p2))


def word_counts(pairs: DataFrame) -> DataFrame:
    """(word, n, stops): occurrences, and those with a full stop."""
    return pairs.groupBy("word").agg(F.count("*").alias("n"), F.count_if("stop").alias("stops"))


def abbreviation_scores(words: DataFrame, options: Options = Options()) -> DataFrame:
    """(word, n, stops, score) of the words with letters that a full stop has followed."""
    totals = words.agg(F.sum("n").alias("all_n"), F.sum("stops").alias("all_stops"))
    d = words.filter((F.col("stops") > 0) & F.col("word").rlike(r"\p{L}")).crossJoin(F.broadcast(totals))  # totals: one row
    n, k, p = F.col("n"), F.col("stops"), F.col("all_stops") / F.col("all_n")
    rest = n - k
    raw = -2 * (k * _log(p) + rest * _log(1 - p) - k * F.ln(F.lit(options.smooth)) - rest * F.ln(F.lit(1 - options.smooth)))
    letters = F.char_length(F.replace(F.col("word"), F.lit("."), F.lit("")))
    stops_inside = F.char_length("word") - letters
    return d.select("word", "n", "stops", (raw * F.exp(-letters) * (stops_inside + 1) * F.pow(letters.cast("double"), -rest)).alias("score"))


def _entries(scores: DataFrame, least: float, *columns: str) -> list[str]:
    """All that reach the least score, in order."""
    found = scores.filter(F.col("score") >= least).select(F.concat_ws(" ", *columns).alias("entry")).toArrow()
    return sorted(found.column("entry").to_pylist())


def learn(docs: DataFrame, options: Options = Options(), text: str = "text") -> Model:
    """A model from all documents."""
    found = settle(_counts(docs, text), "token-counts")
    counted, words = _pair_rows(found), _word_rows(found)
    short = settle(abbreviation_scores(words, options).filter(F.col("score") >= options.abbreviation).select("word", "score"), "abbreviations")
    total = words.agg(F.sum("n")).first()[0] or 0
    initial = F.col("word").rlike(r"^\p{L}$")
    kept = F.col("kept").isNotNull()
    counted = settle(counted.join(short.select("word", F.lit(True).alias("kept")), "word", "left"), "kept-pairs")
    sure = F.col("ends") | (F.col("stop") & ~kept & ~initial & (F.col("word") != "##"))
    letters = F.col("next").rlike(r"^\p{L}")
    after = counted.filter(sure & letters).groupBy(F.col("next").alias("word")).agg(F.sum("c").alias("both"))
    breaks = counted.filter(sure & F.col("next").isNotNull()).agg(F.sum("c")).first()[0] or 0
    n = F.lit(float(max(total, 1)))
    at = after.join(words.select("word", "n"), "word")
    often = F.col("both") / F.lit(float(max(breaks, 1))) > F.col("n") / n
    starters = at.filter(often).select("word", ratio(F.lit(float(max(breaks, 1))), F.col("n"), F.col("both"), n).alias("score"))
    starters = _entries(starters, options.starter, "word")
    firsts = counted.filter(F.col("stop") & (kept | initial | (F.col("word") == "##")) & letters).groupBy("word", "next").agg(F.sum("c").alias("both")).filter("both > 1")
    firsts = firsts.join(words.select("word", F.col("n").alias("a")), "word").join(words.select(F.col("word").alias("next"), F.col("n").alias("b")), "next")
    tied = firsts.filter(n / F.col("a") > F.col("b") / F.col("both")).select("word", "next", ratio(F.col("a"), F.col("b"), F.col("both"), n).alias("score"))
    return Model(_entries(short, options.abbreviation, "word"), starters, _entries(tied, options.collocation, "word", "next"))


def save(model: Model, spark, path: str) -> None:
    rows = [(kind, w) for kind in ("abbreviations", "starters", "collocations") for w in getattr(model, kind)]
    spark.createDataFrame(rows, "kind string, entry string").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark, path: str) -> Model:
    rows = spark.read.schema("kind string, entry string").parquet(path).collect()  # a model's entries fit the driver
    return Model(*[sorted(r.entry for r in rows if r.kind == kind) for kind in ("abbreviations", "starters", "collocations")])


#: Tokens that a worker remembers, before and behind the end of a sentence.
_KNOWN = 100_000


def cutter(abbreviations: Iterable[str], starters: Iterable[str], collocations: Iterable[str]) -> Callable[[str], list[str]]:
    """What cuts a text into sentences by a model, with the words of `core` and `form`."""
    abbreviations, starters, collocations = (frozenset(x) for x in (abbreviations, starters, collocations))
    heads: dict[str, tuple[str, str, bool]] = {}
    tails: dict[str, tuple[str, str]] = {}

    def head(token: str) -> tuple[str, str, bool]:
        """(sure, dots, stop or nothing; the word; whether it is an abbreviation or initial)."""
        bare = _bared(token)
        kind = "sure" if _SURE.search(bare) else "dots" if _DOTS.search(bare) else "stop" if _STOP.search(bare) else ""
        word = _formed(bare)
        if len(heads) >= _KNOWN:
            heads.clear()
        heads[token] = found = kind, word, word in abbreviations or bool(_INITIAL.match(bare) and category(bare[0]) == "Lu")
        return found

    def tail(token: str) -> tuple[str, str]:
        """(category of the first letter, the word)."""
        bare = _bared(token)
        if len(tails) >= _KNOWN:
            tails.clear()
        tails[token] = found = category(bare[0]) if bare else "", _formed(bare)
        return found

    def ends(token: str, after: str) -> bool:
        kind, word, short = heads.get(token) or head(token)
        if kind == "sure" or not kind:
            return kind == "sure"
        first, follower = tails.get(after) or tail(after)
        if kind == "dots":
            return first != "Ll"
        if f"{word} {follower}" in collocations:
            return False
        if short:
            return first == "Lu" and follower in starters
        return not (word == "##" and first == "Ll")

    def cut(text: str) -> list[str]:
        found, start = [], 0
        for end, token, after in _signed(_blanked(text)):
            if after is None:
                break
            if ends(token, after):
                found.append(text[start:end].lstrip(_WHITE))
                start = end
        if rest := text[start:].strip(_WHITE):
            found.append(rest)
        return found

    return cut


def split(docs: DataFrame, model: Model, text: str = "text", name: str = "sentences") -> DataFrame:
    """Add the sentences of each text, with their signs, without white space around them. The model is broadcast."""
    ship(docs.sparkSession)
    number, held = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast((model.abbreviations, model.starters, model.collocations))

    @F.arrow_udf("array<string>")
    def sentences(texts: pa.Array) -> pa.Array:
        if not (cut := _CUTTERS.get(number)):
            _CUTTERS.clear()
            cut = _CUTTERS[number] = cutter(*held.value)
        return pa.array([None if t is None else cut(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return docs.withColumn(name, sentences(F.col(text)))


#: The cutter of a worker's last model.
_CUTTERS: dict[str, Callable[[str], list[str]]] = {}
