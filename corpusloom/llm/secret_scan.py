"""Secret scans, in DataFrame expressions only: fixed patterns, and character Markov models of random and ordinary strings.

Base patterns give spans of three kinds. Besides, each run of letters, digits and `+/_-` of at least `min_chars` that is
not inside a base span is scored: two first-order Markov models over folded characters, one of random strings and one of
ordinary identifiers, give the log-likelihood ratio of the run; where it reaches `margin` the run is a span of kind `markov`.

The models are trained from labelled samples (token, random), each different token once. `samples` labels the strings of
the scanned texts themselves: values that base patterns found are random, all other runs of at least `sample_chars` are
ordinary; a few secrets among them hardly move the counts. The random model is half the samples' and half uniform, as
what is random in other texts may use other characters. Ratios are rounded to thousandths, so that sums don't depend on
the order of addition. Models can be kept and passed in, so that a document's spans needn't depend on its batch.

Texts are read once: the spans and runs of each document are written to the shared folder, and models and verdicts are
made from those. Only the transition counts (some 2,700 numbers) reach the driver.

Defined results: null and empty texts have no span; rows are judged one by one, so repeated rows and ids keep one result
each; very long texts and texts of many matches are scanned whole, in near-linear time; without samples every ratio is
zero and no span is added; spans that begin at one place go in the order of KINDS; an empty table gives an empty result;
other columns are ignored by `scan`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.arrays import running
from corpusloom.runtime import settle, table

KINDS = ["assign", "access", "hex", "markov"]
_WORDS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
#: The pattern of each base kind, the group that must have enough characters, and how many.
BASE = {
    "assign": (rf"""({_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
#: Folded characters of a run; the number of a character is its place here, from 1. 0 stands before the first and for signs
#: between parts of a run, which weigh nothing themselves.
CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
STATES = len(CHARACTERS) + 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Options:
    """min_chars: of a run that may become a span. sample_chars: of a run that is a sample of ordinary strings. margin: the
    least log-likelihood ratio of a span, in thousandths. uniform: its share of the random model. smooth: added to each
    count of the ordinary model."""

    min_chars: int = 16
    sample_chars: int = 10
    margin: int = 10_000
    uniform: float = 0.5
    smooth: float = 0.5

    @property
    def run(self) -> str:
        return rf"[A-Za-z0-9+/_-]{{{min(self.sample_chars, self.min_chars)},}}={{0,2}}"


def _with_matches(d: DataFrame, text: str, pattern: str, name: str) -> DataFrame:
    """Add an array (start, end, match) of the pattern's matches: what lies between them gives their places."""
    between, found = F.split(F.col(text), pattern, -1), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    pieces = F.zip_with(between, found, lambda a, m: F.struct(F.char_length(a).cast("long").alias("lead"), F.char_length(m).cast("long").alias("size"), m.alias("match")))
    d = d.withColumn(name, F.filter(pieces, lambda x: x["match"].isNotNull()))
    before = running(name, lambda x: x["lead"] + x["size"], lambda a, b: a + b, F.lit(0).cast("long"))
    d = d.withColumn(name + "_before", before)
    spans = F.zip_with(name, name + "_before", lambda x, at: F.struct((at + x["lead"]).alias("start"), (at + x["lead"] + x["size"]).alias("end"), x["match"].alias("match")))
    return d.withColumn(name, spans).drop(name + "_before")


def _found(docs: DataFrame, options: Options) -> DataFrame:
    """(doc_id, base, runs): base spans (start, kind, end, value) in order, and runs (start, end, match) outside of them."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for kind, (pattern, _, _) in BASE.items():
        d = _with_matches(d, "text", pattern, kind)
    d = _with_matches(d, "text", options.run, "runs").drop("text")

    def spans(k: int, kind: str) -> Column:
        pattern, group, least = BASE[kind]
        value = lambda x: F.regexp_extract(x["match"], pattern, group) if group else x["match"]
        rows = F.transform(kind, lambda x: F.struct(x["start"], F.lit(k).alias("kind"), x["end"], value(x).alias("value")))
        return F.filter(rows, lambda x: F.char_length(x["value"]) >= least)

    d = d.withColumn("base", F.array_sort(F.concat(*[spans(k, kind) for k, kind in enumerate(BASE)])))
    # a run lies inside a base span if one that begins no later ends no earlier: the greatest end so far tells
    of_base = F.transform("base", lambda x: F.struct(x["start"], F.lit(0).alias("run"), x["end"], F.lit("").alias("match")))
    of_runs = F.transform("runs", lambda x: F.struct(x["start"], F.lit(1).alias("run"), x["end"], x["match"]))
    d = d.withColumn("all", F.array_sort(F.concat(of_base, of_runs)))
    d = d.withColumn("covered", running("all", lambda x: F.when(x["run"] == 0, x["end"]).otherwise(F.lit(0).cast("long")), lambda a, b: F.greatest(a, b), F.lit(0).cast("long")))
    outside = F.filter(F.zip_with("all", "covered", lambda x, c: F.struct(x.alias("x"), c.alias("c"))), lambda z: (z["x"]["run"] == 1) & (z["x"]["end"] > z["c"]))
    return d.select("doc_id", "base", F.transform(outside, lambda z: F.struct(z["x"]["start"].alias("start"), z["x"]["end"].alias("end"), z["x"]["match"].alias("match"))).alias("runs"))


def _samples(found: DataFrame, options: Options) -> DataFrame:
    values = found.select(F.explode(F.transform("base", lambda x: x["value"])).alias("token"), F.lit(True).alias("random"))
    words = found.select(F.explode(F.transform("runs", lambda x: x["match"])).alias("token"), F.lit(False).alias("random"))
    return values.unionByName(words.filter(F.char_length("token") >= options.sample_chars))


def samples(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """(token, random): the labelled strings of documents (doc_id, text)."""
    return _samples(_found(docs, options), options)


def _steps(token: Column, value) -> Column:
    """`value` of each pair of the numbers of neighbouring characters, the first after 0."""
    numbers = F.transform(F.filter(F.split(F.translate(token, UPPER, LOWER), ""), lambda c: c != ""), lambda c: F.instr(F.lit(CHARACTERS), c))
    return F.filter(F.zip_with(F.concat(F.array(F.lit(0)), numbers), numbers, value), lambda x: x.isNotNull())


def train(labelled: DataFrame, options: Options = Options()) -> list[int]:
    """From (token, random) the log-likelihood ratios, in thousandths, of a character b after a: entry a * STATES + b."""
    pairs = labelled.select("token", "random").distinct().select("random", F.explode(_steps(F.col("token"), lambda a, b: a * STATES + b)).alias("step"))
    counts = {(r["random"], r["step"]): r["n"] for r in pairs.groupBy("random", "step").agg(F.count("*").alias("n")).collect()}
    out = [0] * STATES**2
    for a in range(STATES if counts else 0):
        row = {kind: [counts.get((kind, a * STATES + b), 0) for b in range(STATES)] for kind in (True, False)}
        total = {kind: sum(v[1:]) for kind, v in row.items()}
        for b in range(1, STATES):
            own = row[True][b] / total[True] if total[True] else 1 / (STATES - 1)
            random = (1 - options.uniform) * own + options.uniform / (STATES - 1)
            ordinary = (row[False][b] + options.smooth) / (total[False] + options.smooth * (STATES - 1))
            out[a * STATES + b] = math.floor(1000 * (math.log(random) - math.log(ordinary)) + 0.5)
    return out


def _written(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, options: Options = Options(), ratios: list[int] | None = None) -> DataFrame:
    """One row per document: doc_id, and spans (start, kind, end, value), kind being a place in KINDS."""
    found = _found(docs, options)
    if ratios is None:
        found = settle(found, "secret-spans")
        ratios = train(_samples(found, options), options)
    known = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<int>")
    score = lambda t: F.aggregate(_steps(t, lambda a, b: F.get(known, a * STATES + b)), F.lit(0), lambda s, x: s + x)
    able = F.filter("runs", lambda x: F.char_length(x["match"]) >= options.min_chars)
    added = F.transform(F.filter(able, lambda x: score(x["match"]) >= options.margin), lambda x: F.struct(x["start"], F.lit(KINDS.index("markov")).alias("kind"), x["end"], x["match"].alias("value")))
    return found.select("doc_id", F.array_sort(F.concat("base", added)).alias("spans"))


def query(spark, sf_dir: str) -> DataFrame:
    d = scan(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == KINDS.index(kind))).cast("long").alias("n_" + kind)
    base = F.filter("spans", lambda x: x["kind"] < len(BASE))
    return d.select("doc_id", *map(of, BASE), F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def _oracle() -> str:
    o = Options()
    patterns = {k: p for k, (p, _, _) in BASE.items()} | {"run": o.run}
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    order = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END"
    found = " UNION ALL ".join(
        f"SELECT doc_id, '{k}' AS kind, regexp_split_to_array(t, {quoted(p)}) AS a, regexp_extract_all(t, {quoted(p)}) AS m FROM d" for k, p in patterns.items()
    )
    value = f"CASE WHEN kind = 'assign' THEN regexp_extract(m, {quoted(BASE['assign'][0])}, 2) ELSE m END"
    long = "CASE kind " + " ".join(f"WHEN '{k}' THEN {n}" for k, (_, _, n) in BASE.items()) + " END"
    steps = f"""list_transform(range(1, length(token) + 1), lambda i: (CASE WHEN i = 1 THEN 0 ELSE instr('{CHARACTERS}', translate(token[i - 1], '{UPPER}', '{LOWER}')) END) * {STATES}
      + instr('{CHARACTERS}', translate(token[i], '{UPPER}', '{LOWER}')))"""
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
g AS (SELECT doc_id, kind, unnest(range(1, len(m) + 1)) AS i, a, m FROM f),
h AS (SELECT doc_id, kind, i, length(a[i]) AS lead, m[i] AS m FROM g),
p AS (SELECT doc_id, kind, m, sum(lead + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i)::BIGINT AS e FROM h),
q AS MATERIALIZED (SELECT doc_id, kind, e - length(m) AS s, e, {value} AS value FROM p),
base AS MATERIALIZED (SELECT * FROM q WHERE kind <> 'run' AND length(value) >= {long}),
runs AS MATERIALIZED (SELECT * FROM q WHERE kind = 'run' AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = q.doc_id AND b.s <= q.s AND b.e >= q.e)),
x AS (SELECT DISTINCT value AS token, true AS random FROM base UNION ALL SELECT DISTINCT value, false FROM runs WHERE length(value) >= {o.sample_chars}),
c AS MATERIALIZED (SELECT step, count(*) FILTER (random) AS r, count(*) FILTER (NOT random) AS o FROM (SELECT random, unnest({steps}) AS step FROM x) GROUP BY step),
n AS (SELECT step // {STATES} AS a, sum(r) AS r, sum(o) AS o FROM c WHERE step % {STATES} > 0 GROUP BY ALL),
z AS (SELECT i AS step, coalesce(c.r, 0) AS r, coalesce(c.o, 0) AS o, coalesce(n.r, 0) AS nr, coalesce(n.o, 0) AS no FROM range({STATES**2}) t(i) LEFT JOIN c ON c.step = i LEFT JOIN n ON n.a = i // {STATES}),
l AS (SELECT step, CASE WHEN step % {STATES} = 0 THEN 0 ELSE floor(1000 * (ln({1 - o.uniform} * (CASE WHEN nr > 0 THEN r::DOUBLE / nr ELSE 1::DOUBLE / {STATES - 1} END) + {o.uniform}::DOUBLE / {STATES - 1}) - ln((o + {o.smooth}::DOUBLE) / (no + {o.smooth * (STATES - 1)}::DOUBLE))) + 0.5)::BIGINT END AS llr FROM z),
y AS (SELECT token, sum(llr) AS score FROM (SELECT token, unnest({steps}) AS step FROM (SELECT DISTINCT value AS token FROM runs WHERE length(value) >= {o.min_chars})) JOIN l USING (step) GROUP BY token),
everything AS (SELECT * FROM base UNION ALL SELECT doc_id, 'markov', s, e, value FROM runs JOIN y ON y.token = value WHERE score >= {o.margin}),
w AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, {order}) FILTER (kind <> 'markov'), '') AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, {order}) AS spans FROM everything GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN w USING (doc_id)
"""


ORACLE_SQL = _oracle()
