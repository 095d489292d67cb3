"""Names for inner columns that no column of the input has."""

from __future__ import annotations

from collections.abc import Iterable


def free_prefix(columns: Iterable[str], wanted: str = "_q_") -> str:
    """`wanted`, made longer by underscores until no column begins with it (names are compared as Spark does, without case)."""
    taken = [c.lower() for c in columns]
    while any(c.startswith(wanted.lower()) for c in taken):
        wanted = "_" + wanted
    return wanted
