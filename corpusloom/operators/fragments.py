"""Extractive fragments: greedy longest shared runs of a summary and its text; coverage, density, compression."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions import spans as S
from corpusloom.runtime import ship


def fragment_tokens(text: Column, tokenize: bool = True, case: bool = False) -> Column:
    """Tokens to match: words, or what white space parts; lower-cased unless case counts."""
    text = text if case else F.lower(text)
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]" if tokenize else r"\S+"), F.lit(0))


def greedy_fragments(summary: list[str], text: list[str]) -> list[tuple[int, int, int]]:
    """(place in summary, place in text, length), left to right; the first of the longest runs wins. In the text, a try
    jumps past the run it found. Start places come from an index of the text's tokens."""
    at: dict[str, list[int]] = {}
    for k, w in enumerate(text):
        at.setdefault(w, []).append(k)
    found, a = [], 0
    while a < len(summary):
        size, place, after = 0, -1, 0
        for b in at.get(summary[a], ()):
            if b < after:
                continue
            n = 1
            while a + n < len(summary) and b + n < len(text) and summary[a + n] == text[b + n]:
                n += 1
            after = b + n
            if n > size:
                size, place = n, b
        if size:
            found.append((a, place, size))
        a += max(size, 1)
    return found


def with_fragments(pairs: DataFrame, summary: str = "summary_tokens", text: str = "text_tokens") -> DataFrame:
    """Add fragments: array of (summary, text, length)."""
    ship(pairs.sparkSession)

    @F.pandas_udf("array<struct<summary:int,text:int,length:int>>")
    def run(s: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([[{"summary": a, "text": b, "length": n} for a, b, n in greedy_fragments(list(x), list(y))] for x, y in zip(s, t)])

    return pairs.withColumn("fragments", run(summary, text))


def coverage(fragments: Column, base: Column) -> Column:
    return F.coalesce(F.aggregate(fragments, F.lit(0), lambda s, x: s + x["length"]) / F.nullif(F.size(base), F.lit(0)), F.lit(0.0))


def density(fragments: Column, base: Column) -> Column:
    return F.coalesce(F.aggregate(fragments, F.lit(0), lambda s, x: s + x["length"] * x["length"]) / F.nullif(F.size(base), F.lit(0)), F.lit(0.0))


def compression(text: Column, summary: Column, text_to_summary: bool = True) -> Column:
    a, b = (text, summary) if text_to_summary else (summary, text)
    return F.coalesce(F.size(a) / F.nullif(F.size(b), F.lit(0)), F.lit(0.0))


def fragment_stats(pairs: DataFrame, summary: str = "summary_tokens", text: str = "text_tokens") -> DataFrame:
    f = F.col("fragments")
    return with_fragments(pairs, summary, text).withColumns(
        {"coverage": coverage(f, F.col(summary)), "density": density(f, F.col(summary)), "compression": compression(F.col(text), F.col(summary))}
    )


def overlaps(fragments: Column, tokens: Column, min_length: int = 0, side: str = "summary") -> Column:
    """The shared runs longer than min_length, as token arrays."""
    return F.transform(F.filter(fragments, lambda m: m["length"] > min_length), lambda m: F.slice(tokens, m[side] + 1, m["length"]))


def annotate(pairs: DataFrame, min_length: int = 1, colours: int = 20, summary: str = "summary_tokens") -> DataFrame:
    """Add annotated: the summary with its fragments in numbered, coloured spans."""
    ship(pairs.sparkSession)

    @F.pandas_udf("string")
    def run(tokens: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for words, matches in zip(tokens, found):
            parts, at = [], 0
            for k, m in enumerate(matches):
                parts += [html.escape(w) for w in words[at : m["summary"]]]
                at = m["summary"] + m["length"]
                inner = " ".join(html.escape(w) for w in words[m["summary"] : at])
                parts.append(inner if m["length"] < min_length else f'<span class="f{k % colours}" data-ref="{m["summary"]}-{m["text"]}">{inner}</span>')
            out.append(" ".join([*parts, *[html.escape(w) for w in words[at:]]]))
        return pd.Series(out)

    return pairs.withColumn("annotated", run(summary, "fragments"))


def annotate_texts(
    pairs: DataFrame, summary: str = "summary", text: str = "text", min_length: int = 0, truncation: int | None = None, novel: bool = False, case: bool = False, colours: int = 20
) -> DataFrame:
    """Add summary_html and text_html: both texts, escaped and with their own spacing, with the shared runs of at least
    min_length tokens in numbered, coloured spans on both sides. truncation: tokens of the text that are shown; runs are cut
    there. novel: words of the summary that the text lacks stand in em. Without the marks, and unescaped, the texts are the
    input (the text up to its last shown token). Null texts count as empty.

    A token that the text has is always in some run, if of one token, so novel words are those between runs."""
    names = ("_pieces_s", "_pieces_t", "_tokens_s", "_tokens_t", "fragments", "_runs_s", "_runs_t", "_all_s")
    if taken := [c for c in (*names, "summary_html", "text_html") if c in pairs.columns]:
        raise ValueError(f"columns {taken} would clash")
    whole = {"s": F.coalesce(F.col(summary), F.lit("")), "t": F.coalesce(F.col(text), F.lit(""))}
    d = pairs.withColumns({"_pieces_s": S.pieces(whole["s"]), "_pieces_t": S.pieces(whole["t"])})
    d = d.withColumns({"_tokens_s": S.tokens(F.col("_pieces_s"), case), "_tokens_t": S.tokens(F.col("_pieces_t"), case)})
    d = with_fragments(d, "_tokens_s", "_tokens_t")
    shown = F.size("_pieces_t") if truncation is None else F.least(F.size("_pieces_t"), F.lit(truncation))
    # shorter runs keep their number, so that both sides agree, and lose their length
    marked = F.transform("fragments", lambda m: F.struct(m["summary"].alias("summary"), m["text"].alias("text"), F.when(m["length"] >= min_length, m["length"]).otherwise(0).alias("length")))
    d = d.withColumns({"_runs_s": S.runs(marked, "summary", F.size("_pieces_s")), "_runs_t": S.runs(marked, "text", shown), "_all_s": S.runs(F.col("fragments"), "summary", F.size("_pieces_s"))})

    def html_of(found: str, runs: str, end: Column, plain) -> Column:
        """Runs in spans, what lies between them by `plain` (first, end)."""
        part = lambda a, b: F.slice(F.col(found), a + 1, F.greatest(b - a, F.lit(0)))

        def span(r: Column) -> Column:
            colour = (r["ref"] % colours).cast("string")
            head = part(r["first"], r["first"] + 1)
            space = F.array_join(F.transform(head, lambda p: S.T.escape_html(p["space"])), "")
            rest = F.concat(F.array_join(F.transform(head, lambda p: S.T.escape_html(p["token"])), ""), S.joined(part(r["first"] + 1, r["first"] + r["size"])))
            return F.concat(space, F.lit('<span class="f'), colour, F.lit('" data-ref="'), r["ref"].cast("string"), F.lit('">'), rest, F.lit("</span>"))

        from_ = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["first"] + r["size"]))
        to = F.concat(F.transform(runs, lambda r: r["first"]), F.array(end))
        between = F.zip_with(from_, to, plain)
        after = F.concat(F.transform(runs, span), F.array(F.lit("")))
        return F.array_join(F.zip_with(between, after, lambda x, y: F.concat(x, y)), "")

    plain = lambda found: lambda a, b: S.joined(F.slice(F.col(found), a + 1, F.greatest(b - a, F.lit(0))))
    d = d.withColumn("text_html", F.concat(html_of("_pieces_t", "_runs_t", shown, plain("_pieces_t")), F.when(shown == F.size("_pieces_t"), S.T.escape_html(S.last_space(whole["t"]))).otherwise("")))
    if novel:
        # novel words get their marks in the pieces' place: a piece is novel where no run of any length covers it
        from_ = F.concat(F.array(F.lit(0)), F.transform("_all_s", lambda r: r["first"] + r["size"]))
        to = F.concat(F.transform("_all_s", lambda r: r["first"]), F.array(F.size("_pieces_s")))
        flag = lambda p, is_novel: F.struct(p.alias("p"), F.lit(is_novel).alias("novel"))
        gaps = F.zip_with(from_, to, lambda a, b: F.transform(F.slice(F.col("_pieces_s"), a + 1, b - a), lambda _, i: flag(a + i, True)))
        runs = F.transform("_all_s", lambda r: F.transform(F.sequence(r["first"], r["first"] + r["size"] - 1), lambda p: flag(p, False)))
        flags = F.concat(F.flatten(gaps), F.flatten(runs))
        d = d.withColumn("_novel", F.transform(F.array_sort(flags), lambda x: x["novel"]))
        d = d.withColumn("_pieces_s", F.zip_with("_pieces_s", "_novel", lambda p, n: F.struct(p["space"].alias("space"), p["token"].alias("token"), n.alias("novel"))))
        words = lambda a, b: F.array_join(
            F.transform(
                F.slice(F.col("_pieces_s"), a + 1, F.greatest(b - a, F.lit(0))),
                lambda p: F.concat(S.T.escape_html(p["space"]), F.when(p["novel"], F.concat(F.lit("<em>"), S.T.escape_html(p["token"]), F.lit("</em>"))).otherwise(S.T.escape_html(p["token"]))),
            ),
            "",
        )
    else:
        words = plain("_pieces_s")
    d = d.withColumn("summary_html", F.concat(html_of("_pieces_s", "_runs_s", F.size("_pieces_s"), words), S.T.escape_html(S.last_space(whole["s"]))))
    return d.select(*pairs.columns, "summary_html", "text_html")
