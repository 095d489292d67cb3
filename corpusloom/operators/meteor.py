"""Alignment scores of token lists: words are paired in stages (equal words, then equal stems), pairs that go on from one
another on both sides make a chunk, and many chunks lower the score.

A stage pairs the last free occurrence of a word on one side with the last free one on the other, then the last but one,
and so on; so each stage pairs as many words as it can, and no two pairs of one word cross. Crossings of different words
are not minimised. There is no stage of synonyms.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.operators import stem
from corpusloom.operators.rouge import _lists
from corpusloom.runtime import ship


@dataclass(frozen=True)
class Options:
    #: Weight of precision against recall; 1: precision alone, 0: recall alone.
    alpha: float = 0.9
    #: The penalty is gamma * (chunks / matches) ** beta.
    beta: float = 3.0
    gamma: float = 0.5
    stemmed: bool = True


def _from_the_end(number: np.ndarray) -> np.ndarray:
    """How many equal numbers come after each."""
    back = number[::-1]
    order = np.argsort(back, kind="stable")
    in_order = back[order]
    start = np.concatenate([[True], in_order[1:] != in_order[:-1]]) if len(order) else np.zeros(0, dtype=bool)
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.arange(len(order)) - np.flatnonzero(start)[np.cumsum(start) - 1] if len(order) else 0
    return out[::-1]


def align(stages: list[tuple[pa.Array, pa.Array]]) -> tuple[np.ndarray, np.ndarray]:
    """(matches, chunks) of each pair of lists. The stages hold the same tokens in forms that get ever coarser."""
    hyp_row, ref_row = (_lists(c)[0] for c in stages[0])
    linked = np.full(len(hyp_row), -1, dtype=np.int64)
    free = np.ones(len(ref_row), dtype=bool)
    for hyp, ref in stages:
        a, b = np.flatnonzero(linked < 0), np.flatnonzero(free)
        words = pa.concat_arrays([_lists(c)[1].cast(pa.string()) for c in (hyp, ref)]).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.concatenate([hyp_row[a], ref_row[b]])
        word = np.concatenate([words[: len(hyp_row)][a], words[len(hyp_row) :][b]])
        number = np.unique(row * (words.max(initial=0) + 1) + word, return_inverse=True)[1]
        sides = number[: len(a)], number[len(a) :]
        key = [n * (len(number) + 1) + _from_the_end(n) for n in sides]
        _, i, j = np.intersect1d(*key, assume_unique=True, return_indices=True)
        linked[a[i]] = b[j]
        free[b[j]] = False
    # numbers run on over rows, but the last word of a row's list and the first of the next are of different rows
    on = linked >= 0
    follows = np.zeros(len(on), dtype=bool)
    follows[1:] = on[1:] & on[:-1] & (linked[1:] == linked[:-1] + 1) & (hyp_row[1:] == hyp_row[:-1])
    count = lambda flags: np.bincount(hyp_row[flags], minlength=len(stages[0][0]))
    return count(on), count(on & ~follows)


def score(p: Column, r: Column, matches: Column, chunks: Column, options: Options = Options()) -> Column:
    mean = p * r / (options.alpha * p + (1 - options.alpha) * r)
    return F.when(matches > 0, mean * (1 - options.gamma * F.pow(chunks / matches, F.lit(options.beta)))).otherwise(0.0)


def meteor(pairs: DataFrame, options: Options = Options()) -> DataFrame:
    """pairs (pair_id, ref_id, hyp: tokens, ref: tokens) -> (pair_id, ref_id, matches, chunks, p, r, score).

    Pairs are aligned in their rows, a batch at a time, without a shuffle; time is n log n in a pair's tokens. Null or
    empty lists match nothing and score 0; repeated rows are scored alike; other columns are left out."""
    ship(pairs.sparkSession)
    rows = pairs.select("pair_id", "ref_id", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("hyp", "ref")])
    names = ["hyp", "ref"]
    if options.stemmed:
        rows = stem.stem_columns(rows.withColumns({f"{c}_stem": F.col(c) for c in ("hyp", "ref")}), ["hyp_stem", "ref_stem"])
        names += ["hyp_stem", "ref_stem"]

    @F.arrow_udf("struct<matches: long, chunks: long>")
    def run(*columns: pa.Array) -> pa.Array:
        matches, chunks = align(list(zip(columns[::2], columns[1::2])))
        return pa.StructArray.from_arrays([pa.array(matches.astype(np.int64)), pa.array(chunks.astype(np.int64))], ["matches", "chunks"])

    out = rows.select("pair_id", "ref_id", run(*names).alias("a"), F.size("hyp").alias("h"), F.size("ref").alias("g"))
    share = lambda n: F.when(F.col(n) > 0, F.col("a.matches") / F.col(n)).otherwise(0.0)
    out = out.select("pair_id", "ref_id", "a.matches", "a.chunks", share("h").alias("p"), share("g").alias("r"))
    return out.withColumn("score", score(*(F.col(c) for c in ("p", "r", "matches", "chunks")), options))


def best(scored: DataFrame) -> DataFrame:
    """(pair_id, ref_id, score): the reference with the highest score, of equal ones the one of smallest ref_id."""
    top = F.max_by(F.struct("ref_id", "score"), F.struct("score", -F.col("ref_id"))).alias("b")
    return scored.groupBy("pair_id").agg(top).select("pair_id", "b.ref_id", "b.score")
