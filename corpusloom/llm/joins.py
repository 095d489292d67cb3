"""Joins of long lists with a table that has one row for each key, where a key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom.runtime import settle

#: Keys that hold more than this part of all rows are broadcast, so there are this many at most.
HOT_KEYS = 10_000


def hot_keys(sizes: DataFrame, *keys: str) -> DataFrame | None:
    """The keys that hold more than one in HOT_KEYS of all rows: sizes (keys, m); None if there is none."""
    total = sizes.agg(F.sum("m")).first()[0] or 0
    hot = settle(sizes.filter(F.col("m") > max(total / HOT_KEYS, 64)).select(*keys), "hot-keys")
    return None if hot.isEmpty() else hot


def by_key(rows: DataFrame, one_each: DataFrame, hot: DataFrame | None, *keys: str) -> DataFrame:
    """Rows joined with a table of one row for each key; hot keys are broadcast, the others shuffled."""
    on = list(keys)
    if hot is None:
        return rows.join(one_each, on)
    hot = F.broadcast(hot)
    few = F.broadcast(one_each.join(hot, on, "left_semi"))
    return rows.join(few, on).unionByName(rows.join(hot, on, "left_anti").join(one_each, on))
