"""Tokens with the white space before them, so that a text can be put together again exactly as it stood."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpusloom.functions import text as T

#: A word or a sign, with the white space before it. Between them and the end no character is left out.
PIECE = r"[\s\x0b\x85  \xa0]*(?:[\p{L}\p{N}]+|[^\p{L}\p{N}\s\x0b\x85  \xa0])"
_SPACE = r"^[\s\x0b\x85  \xa0]*"


def pieces(text: Column) -> Column:
    """Array of (space, token)."""
    found = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    return F.transform(found, lambda p: F.struct(F.regexp_extract(p, _SPACE, 0).alias("space"), F.regexp_replace(p, _SPACE, "").alias("token")))


def last_space(text: Column) -> Column:
    """The white space behind the last token; the whole text where there is none."""
    return F.regexp_extract(text, r"[\s\x0b\x85  \xa0]*$", 0)


def tokens(found: Column, case: bool = False) -> Column:
    return F.transform(found, lambda p: p["token"] if case else F.lower(p["token"]))


def joined(found: Column, mark=None) -> Column:
    """Pieces as escaped text; `mark` may put signs around the escaped token."""
    inner = lambda p: T.escape_html(p["token"])
    return F.array_join(F.transform(found, lambda p: F.concat(T.escape_html(p["space"]), mark(inner(p)) if mark else inner(p))), "")


def runs(matches: Column, side: str, limit: Column) -> Column:
    """Sorted, separate runs (first, size, ref) of the tokens that matches (side, length) cover below a limit; of two matches on
    one token the earlier match keeps it."""
    numbered = F.transform(matches, lambda m, k: F.struct(m[side].alias("first"), m["length"].alias("length"), k.alias("k")))
    places = F.flatten(
        F.transform(
            F.filter(numbered, lambda m: (m["first"] < limit) & (m["length"] > 0)),
            lambda m: F.transform(F.sequence(m["first"], F.least(m["first"] + m["length"], limit) - 1), lambda p: F.struct(p.alias("p"), m["k"].alias("k"))),
        )
    )
    # an array of one array names it, so that it is sorted once
    once = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    own = once(F.array_sort(places), lambda a: F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1)["p"] != x["p"])))

    def cut(a: Column) -> Column:
        begins = lambda x, i: (i == 0) | (F.get(a, i - 1)["p"] + 1 != x["p"]) | (F.get(a, i - 1)["k"] != x["k"])
        firsts = F.filter(F.transform(a, lambda x, i: F.when(begins(x, i), i)), lambda i: i.isNotNull())
        ends = F.concat(F.slice(firsts, F.lit(2), F.size(firsts)), F.array(F.size(a)))
        return F.transform(F.filter(F.arrays_zip(firsts.alias("a"), ends.alias("b")), lambda r: r["a"].isNotNull()), lambda r: F.struct(F.get(a, r["a"])["p"].alias("first"), (r["b"] - r["a"]).alias("size"), F.get(a, r["a"])["k"].alias("ref")))

    return once(own, cut)
