"""Addresses: absolute form of links, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "(?s)#.*$", "")


def _without_dots(path: Column) -> Column:
    """A path with its steps . and .. carried out; a step back at the top stays there."""
    steps = F.split(path, "/", -1)
    last = F.element_at(steps, -1)
    kept = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(x))),
    )
    whole = F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit("")))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.regexp_replace(whole, "^$", "/")).otherwise(path)


def resolve(base: Column, link: Column) -> Column:
    """The absolute address of a link on the page `base`, without fragment; null where either isn't an http(s) address."""
    link, base = F.trim(link, F.lit(" \t\r\n")), without_fragment(base)
    scheme = F.regexp_extract(base, r"(?i)^(https?):", 1)
    origin = F.regexp_extract(base, r"(?i)^https?://[^/?#]*", 0)
    page = F.regexp_extract(base, r"^[^?#]*", 0)
    folder = F.when(page == origin, F.concat(origin, F.lit("/"))).otherwise(F.regexp_extract(page, r"^.*/", 0))
    whole = (
        F.when(link.rlike("(?i)^https?://"), link)
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(page, link))
        .when((link == "") | link.startswith("#"), base)
        .otherwise(F.concat(folder, link))
    )
    whole = without_fragment(whole)
    head, path, tail = (F.regexp_extract(whole, r"(?s)^((?i)https?://[^/?#]*)([^?#]*)(.*)$", k) for k in (1, 2, 3))
    return F.when((origin != "") & (head != ""), F.concat(head, _without_dots(path), tail))
