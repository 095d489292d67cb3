"""Folds over the entries of an array in Spark expressions, near-linear for long arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def running(array: str, value: Callable, merge: Callable, zero: Column) -> Column:
    """For each entry of an array column, `merge` of the values of the entries before it, from `zero`, its neutral element.

    The array is cut in about sqrt(n) runs, so that work within a run that is quadratic, and work that is done for each
    run over all, both stay below n to the power 1.5."""
    size = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(array))).cast("int"))
    numbers = F.sequence(F.lit(0), F.ceil(F.size(array) / size).cast("int") - 1)
    none = F.slice(F.array(zero), F.lit(1), F.lit(0))
    run = lambda k: F.slice(F.col(array), k * size + 1, size)

    def folds(entries: Column, first: Column, of: Callable) -> Column:
        start = F.struct(first.alias("at"), none.alias("out"))
        return F.aggregate(entries, start, lambda s, x: F.struct(merge(s["at"], of(x)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    totals = F.transform(numbers, lambda k: F.aggregate(run(k), zero, lambda s, x: merge(s, value(x))))
    pieces = F.arrays_zip(numbers.alias("k"), folds(totals, zero, lambda x: x).alias("first"))
    return F.when(F.size(array) > 0, F.flatten(F.transform(pieces, lambda r: folds(run(r["k"]), r["first"], value)))).otherwise(none)
