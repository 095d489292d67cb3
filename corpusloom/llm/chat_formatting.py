"""Chat formatting in Spark expressions only: turns are sorted, neighbours of one role merged, texts escaped and joined.

Template of one merged turn: `<|turn|>` role `<|text|>` text [`<|part|>` text ...] `<|end|>` line feed. In roles and
texts, `<` followed by k backslashes and `|` gets one backslash more, so that no text can hold a marker; reading takes
one away. The parts of a merged turn stay apart, so the original turns can be read back.

The loss mask is a list of spans (start, length in code points of the formatted text), one for each text of a trained
role; markers are never under the mask.

Defined results: null roles and texts are empty; turns with equal numbers are ordered by role, then text; null turn
numbers come first; repeated rows are repeated turns; a null conv_id is one conversation of its own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.runtime import table

TURN, TEXT, PART, END = "<|turn|>", "<|text|>", "<|part|>", "<|end|>\n"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def format_conversations(turns: DataFrame, trained: str = TRAINED) -> DataFrame:
    """One row per conversation: conv_id, formatted, spans (array of start and length)."""
    sorted_turns = turns.groupBy("conv_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col("turn").alias("turn"),
                    F.coalesce(F.col("role"), F.lit("")).alias("role"),
                    F.coalesce(F.col("text"), F.lit("")).alias("text"),
                )
            )
        ).alias("turns")
    )
    t = F.col("turns")
    d = sorted_turns.withColumn("n", F.size(t))
    d = d.withColumn("texts", F.transform(t, lambda x: escape(x["text"])))
    changed = lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"])
    d = d.withColumn("firsts", F.filter(F.sequence(F.lit(0), F.col("n") - 1), changed))
    ends = F.concat(F.slice(F.col("firsts"), 2, F.size("firsts")), F.array(F.col("n")))
    d = d.withColumn("groups", F.arrays_zip(F.col("firsts").alias("a"), ends.alias("b")))
    d = d.withColumn(
        "merged",
        F.transform(
            F.col("groups"),
            lambda g: F.struct(
                F.get(t, g["a"])["role"].alias("role"),
                F.slice(F.col("texts"), g["a"] + 1, g["b"] - g["a"]).alias("parts"),
            ),
        ),
    )
    block = lambda m: F.concat(F.lit(TURN), escape(m["role"]), F.lit(TEXT), F.array_join(m["parts"], PART), F.lit(END))
    d = d.withColumn("formatted", F.array_join(F.transform(F.col("merged"), block), ""))
    # a turn's text begins after all that precedes it: its own marker, and the texts and markers of the turns before
    lead = lambda i: F.when(
        changed(i),
        F.lit(len(TURN) + len(TEXT)) + F.char_length(escape(F.get(t, i)["role"])) + F.when(i > 0, F.lit(len(END))).otherwise(F.lit(0)),
    ).otherwise(F.lit(len(PART)))
    d = d.withColumn(
        "sizes",
        F.transform(
            t,
            lambda x, i: F.struct(
                lead(i).cast("long").alias("lead"), F.char_length(F.get(F.col("texts"), i)).cast("long").alias("len"), (x["role"] == trained).alias("on")
            ),
        ),
    )
    d = d.withColumn("starts", prefix_sums("sizes", lambda x: x["lead"] + x["len"]))
    spans = F.zip_with("sizes", "starts", lambda x, at: F.struct((at + x["lead"]).alias("start"), x["len"].alias("length"), x["on"].alias("on")))
    d = d.withColumn("all_spans", spans)
    trained_spans = F.transform(F.filter("all_spans", lambda x: x["on"]), lambda x: F.struct(x["start"], x["length"]))
    return d.select("conv_id", "formatted", trained_spans.alias("spans"))


def _runs(array: str) -> tuple[Column, Column]:
    """(size of a run, numbers of the runs): an array of n entries is cut in about sqrt(n) runs, so that work within a
    run that is quadratic, and work that is done for each run over all, both stay below n to the power 1.5."""
    size = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(array))).cast("int"))
    return size, F.sequence(F.lit(0), F.ceil(F.size(array) / size).cast("int") - 1)


def prefix_sums(array: str, value) -> Column:
    """For each entry of an array column, the sum of the values of the entries before it."""
    size, numbers = _runs(array)
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")

    def sums(entries: Column, first: Column, add) -> Column:
        start = F.struct(first.alias("at"), none.alias("out"))
        step = lambda s, x: F.struct((s["at"] + add(x)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(entries, start, step, lambda s: s["out"])

    run = lambda k: F.slice(F.col(array), k * size + 1, size)
    totals = F.transform(numbers, lambda k: F.aggregate(run(k), zero, lambda s, x: s + value(x)))
    first_of = sums(totals, zero, lambda x: x)
    found = F.transform(F.arrays_zip(numbers.alias("k"), first_of.alias("first")), lambda r: sums(run(r["k"]), r["first"], value))
    return F.when(F.size(array) > 0, F.flatten(found)).otherwise(none)


def read_turns(formatted: Column) -> Column:
    """The original turns, as an array of (role, text), read from a formatted conversation."""
    blocks = F.filter(F.split(formatted, r"<\|turn\|>", -1), lambda b: b != "")

    def parts(b: Column) -> Column:
        halves = F.split(F.substring(b, F.lit(1), F.char_length(b) - len(END)), r"<\|text\|>", -1)
        role = unescape(F.get(halves, 0))
        return F.transform(F.split(F.get(halves, 1), r"<\|part\|>", -1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, parts))


def read_loss(formatted: Column, spans: str = "spans") -> Column:
    """All text under the loss mask, unescaped. The text is cut by runs of spans first, so that a span is looked for in
    its run's part alone."""
    size, numbers = _runs(spans)
    texts = lambda run, part, at: F.transform(
        run, lambda s: unescape(F.substring(part, (s["start"] - at + 1).cast("int"), s["length"].cast("int")))
    )

    def of_run(k: Column) -> Column:
        run = F.slice(F.col(spans), k * size + 1, size)
        first, last = F.get(run, F.lit(0))["start"], F.element_at(run, -1)
        part = F.substring(formatted, (first + 1).cast("int"), (last["start"] + last["length"] - first).cast("int"))
        # an array of one part names it, so that it is cut once for all spans of the run
        return F.array_join(F.flatten(F.transform(F.array(F.struct(part.alias("part"), run.alias("run"))), lambda p: texts(p["run"], p["part"], first))), "")

    return F.when(F.size(spans) > 0, F.array_join(F.transform(numbers, of_run), "")).otherwise("")


def digest(formatted: DataFrame) -> DataFrame:
    d = formatted.withColumns({"turns": read_turns(F.col("formatted")), "loss": read_loss(F.col("formatted"))})
    lines = F.array_join(F.transform(F.col("turns"), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return d.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


PROBE = "\\### Assistant: </turn> ok"


def query(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").cast("long").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(PROBE).alias("text"),
    )
    return digest(format_conversations(turns.unionByName(probe)))


ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) v(conv_id, turn, role, text)
), placed AS (
  SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS esc, regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g') AS esc_role,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(esc) + CASE WHEN before IS NULL OR before <> role THEN 24 + length(esc_role) ELSE 8 END) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""
