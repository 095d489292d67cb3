"""Elements of web pages as rows, and fields selected by element, class and place.

A page becomes a stream of events (start tag, end tag, text) by one regular expression; scripts, styles, comments and
declarations go. Every text event has a place in the page's text by a running sum, so the text of an element is a slice
of it, whatever lies inside. A page's events lie in its row, so its start tags meet their end tags there, a batch of pages at
a time and without a shuffle:

- an element of most kinds ends at the end tag of its name on its own level (running sum of its name's tags);
- a paragraph ends at its end tag or at the next tag of a block, a list item at the next item or the end of its list, as
  authors leave these open; html and body end with the page at the latest;
- any other start tag without an end tag, and an element that has none (br, img, ...), holds nothing;
- an end tag without a start tag goes.

A field is a list of steps. A step finds elements below those of the step before, at any depth or as direct children,
by name, class, attribute, place among them or the text of a child that marks it. Steps are filters, windows and joins of
elements on the page; only elements that a step asks for are shuffled, and texts once.

Defined results: null and empty pages have no elements and their fields are empty arrays; names are compared in lower
case; attribute values may stand in double, single or no quotes; the first of repeated attributes counts; a page key that is
null or repeated is an error of the caller (keys name pages)."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.runtime import settle, ship

#: One event each: a comment, a script, a style, a declaration, a tag, or text.
EVENT = (
    r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script[^>]*>|<style\b[^>]*>.*?</style[^>]*>|<![^>]*>|<\?[^>]*>"
    r"""|</?[a-z][a-z0-9:-]*(?:"[^"]*"|'[^']*'|[^"'>]+)*>|[^<]+|<"""
)
#: Elements that hold nothing.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
#: Elements whose tags end an open paragraph.
BLOCKS = [
    *["address", "article", "aside", "blockquote", "body", "center", "dd", "div", "dl", "dt", "fieldset", "figure", "font", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6"],
    *["header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"],
]
#: Stands behind each text in a page's text; it is taken out of the page first.
MARK = "\x01"
#: Names of characters. Others stay as they stand.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\xa0", "copy": "©", "middot": "·", "laquo": "«", "raquo": "»", "hellip": "…", "ndash": "–", "mdash": "—", "amp": "&"}


@dataclass(frozen=True)
class Step:
    """Elements below the ones before. name: of the element. cls: a class it has. attrs: (name, value) pairs it has, a
    value of None being any. child: a direct child only. place: the n-th, from 1, that the step finds below one parent.
    marked: (name, text), it has a child of that name whose text is exactly that, or holds it if `part`."""

    name: str | None = None
    cls: str | None = None
    attrs: tuple[tuple[str, str | None], ...] = ()
    child: bool = False
    place: int | None = None
    marked: tuple[str, str] | None = None
    part: bool = False


@dataclass(frozen=True)
class Field:
    """What the steps lead to: its text, its texts apart (`nodes`), or an attribute's value."""

    steps: tuple[Step, ...]
    attribute: str | None = None
    nodes: bool = False


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in the source of a tag; null without the attribute."""
    pattern = rf"""(?is)^<[^>\s]+(?:\s+[^\s=>"']+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?)*?\s+{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    value = F.regexp_extract(tag, pattern, 1)
    return F.when(value != "", unescape(F.when(value.rlike("^[\"']"), F.substring(value, F.lit(2), F.char_length(value) - 2)).otherwise(value)))


def unescape(text: Column) -> Column:
    """Named characters of ENTITIES, and numbers of code points, decimal or with x."""
    given = text
    for name, sign in ENTITIES.items():
        if name != "amp":
            text = F.replace(text, F.lit(f"&{name};"), F.lit(sign))
    number = r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"
    digits = lambda x: F.regexp_extract(x, "&#[xX]?([0-9a-fA-F]+);", 1)
    code = lambda x: F.when(x.rlike("^&#[xX]"), F.conv(digits(x), 16, 10)).otherwise(digits(x)).cast("int")
    sign = lambda x: F.when(code(x).between(1, 0xD7FF) | code(x).between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(code(x)), 8, "0")), "UTF-32")).otherwise(F.lit("�"))
    parts = F.zip_with(F.split(text, number, -1), F.regexp_extract_all(text, F.lit(number), F.lit(0)), lambda a, b: F.when(b.isNull(), a).otherwise(F.concat(a, sign(b))))
    return F.when(F.contains(given, F.lit("&")), F.replace(F.when(text.rlike(number), F.array_join(parts, "")).otherwise(text), F.lit("&amp;"), F.lit("&"))).otherwise(given)


def _sources(html: str) -> Column:
    return F.regexp_extract_all(F.replace(F.col(html), F.lit(MARK), F.lit("")), F.lit(EVENT), F.lit(0))


def events(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(page, k, kind, name, source, size, at): kind is start, end, void or text; at: characters of text before the event."""
    rows = pages.select(F.col(key).alias("page"), F.posexplode(_sources(html)).alias("k", "source"))
    name = F.lower(F.regexp_extract("source", "^</?([A-Za-z][A-Za-z0-9:-]*)", 1))
    s = F.col("source")
    rows = rows.withColumn("name", F.when(s.startswith("<") & (s != "<"), name))
    kind = (
        F.when(F.col("name").isNull(), "text")
        .when((F.col("name") == "") | (F.col("name").isin("script", "style")), "skip")
        .when(s.startswith("</"), "end")
        .when(F.col("name").isin(VOID) | s.endswith("/>"), "void")
        .otherwise("start")
    )
    rows = rows.withColumn("kind", kind).filter("kind <> 'skip'")
    rows = rows.withColumn("size", F.when(F.col("kind") == "text", F.char_length("source") + len(MARK)).otherwise(0).cast("long"))
    return rows.withColumn("at", F.coalesce(F.sum("size").over(Window.partitionBy("page").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def texts(found: DataFrame) -> DataFrame:
    """(page, text): all text of a page, MARK behind each piece."""
    pieces = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("k", "source")))), lambda x: F.concat(x["source"], F.lit(MARK)))
    return found.groupBy("page").agg(F.array_join(pieces, "").alias("text"))


def elements(found: DataFrame) -> DataFrame:
    """(page, k, last, name, source, at, until, depth, parent): an element holds the events between k and last, and the
    text from at to until; parent is the k of the element it lies in, -1 at the top."""
    pieces = F.array_sort(F.collect_list(F.struct("k", "source")))
    trees = _trees(found.groupBy("page").agg(pieces.alias("e")).select("page", F.col("e.k").alias("ks"), F.col("e.source").alias("sources")))
    return trees.select("page", F.inline("nodes"))


_TAG = re.compile("</?([A-Za-z][A-Za-z0-9:-]*)")
_NODE = {"k": "int", "last": "int", "name": "string", "source": "string", "at": "long", "until": "long", "depth": "int", "parent": "int"}


def _tags(ks: list[int], sources: list[str]) -> tuple[list[tuple], tuple[int, int], str]:
    """A page's tags as (k, kind, name, source, at), its end (k, at), and its text."""
    tags, texts, at, end = [], [], 0, (0, 0)
    for k, s in zip(ks, sources):
        if s == "<" or s[0] != "<":
            texts.append(s)
            at += len(s) + len(MARK)
        else:
            name = found[1].lower() if (found := _TAG.match(s)) else ""
            if name in ("", "script", "style"):
                continue
            tags.append((k, "end" if s[1] == "/" else "void" if name in _VOID or s.endswith("/>") else "start", name, s, at))
        end = (k + 1, at)
    return tags, end, "".join(x + MARK for x in texts)


_VOID, _BLOCKS = frozenset(VOID), frozenset(BLOCKS)


def _ends(tags: list[tuple], page_end: tuple[int, int]) -> list[tuple[int, int]]:
    """Where the element that each tag begins ends, as (k, at)."""
    match, waiting, levels, lists, depth = {}, {}, {}, [], 0
    for i, (k, kind, name, _, at) in enumerate(tags):
        up = {"start": 1, "end": -1, "void": 0}[kind]
        ends_list = name in ("ul", "ol") and kind == "end"
        depth += up if name in ("ul", "ol") else 0
        lists.append(depth + ends_list)
        if up:  # the next tag on the level of a name ends the element, if it is an end tag
            levels[name] = levels.get(name, 0) + up
            level = (name, levels[name] + (up < 0))
            before = waiting.pop(level, None)
            if up > 0:
                waiting[level] = i
            elif before is not None:
                match[before] = (k, at)
    found, next_block, next_item = [], page_end, {}
    for i in range(len(tags) - 1, -1, -1):
        k, kind, name, _, at = tags[i]
        here = (k, at)
        if kind == "void":
            found.append(here)
        elif name == "p":
            found.append(next_block)
        elif name == "li":  # ended by the next tag of an item on its list's level, or by the list's end
            found.append(next_item.get(lists[i], page_end))
        else:
            found.append(match.get(i, page_end if name in ("html", "body") else here))
        if name in _BLOCKS:
            next_block = here
        if kind != "void" and (name == "li" or name in ("ul", "ol") and kind == "end"):
            next_item[lists[i]] = here
    return found[::-1]


def _nodes(ks: list[int], sources: list[str]) -> tuple[list[tuple], str]:
    """A page's elements, with depth (elements begun and not yet ended) and parent (the last one a level up that began before), and its text."""
    tags, page_end, text = _tags(ks, sources)
    spans = [(k, end[0], name, s, at, end[1]) for (k, kind, name, s, at), end in zip(tags, _ends(tags, page_end)) if kind != "end"]
    closing = sorted(x[1] for x in spans if x[1] > x[0])
    out, begun, ended, above = [], 0, 0, {}
    for x in spans:
        while ended < len(closing) and closing[ended] <= x[0]:
            ended += 1
        begun += x[1] > x[0]
        depth = begun - ended + (x[1] == x[0])
        out.append((*x, depth, above.get(depth - 1, -1)))
        if x[1] > x[0]:
            above[depth] = x[0]
    return out, text


def _trees(rows: DataFrame) -> DataFrame:
    """rows (page, ks: places of events or null for all, sources: of events) -> (page, text, nodes); null sources have no text and no nodes."""
    ship(rows.sparkSession)
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    node = pa.struct([(c, kinds[t]) for c, t in _NODE.items()])

    def run(batches):
        for batch in batches:
            texts, nodes, offsets = [], [], [0]
            for ks, sources in zip(batch.column(1), batch.column(2)):
                events = sources.as_py()
                found, text = ([], None) if events is None else _nodes(ks.as_py() or range(len(events)), events)
                texts.append(text)
                nodes += found
                offsets.append(len(nodes))
            columns = [pa.array([x[i] for x in nodes], node.field(i).type) for i in range(len(_NODE))]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(node)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), lists], names=["page", "text", "nodes"])

    fields = ", ".join(f"{c}: {t}" for c, t in _NODE.items()).replace("long", "bigint")
    return rows.select("page", "ks", "sources").mapInArrow(run, f"page {rows.schema['page'].dataType.simpleString()}, text string, nodes array<struct<{fields}>>")


def _fits(step: Step) -> Column:
    fine = F.lit(True)
    if step.name:
        fine &= F.col("name") == step.name.lower()
    if step.cls:
        fine &= F.coalesce(F.array_contains(F.split(attribute(F.col("source"), "class"), r"\s+"), step.cls), F.lit(False))
    for name, value in step.attrs:
        found = attribute(F.col("source"), name)
        fine &= found.isNotNull() if value is None else F.coalesce(found == value, F.lit(False))
    return fine


def _below(nodes: DataFrame, above: DataFrame | None, step: Step, page_texts: DataFrame) -> DataFrame:
    some = nodes.filter(_fits(step))
    if step.marked:
        name, text = step.marked
        marks = nodes.filter(F.col("name") == name).join(page_texts, "page")
        own = unescape(_slice(F.col("at"), F.col("until"), False))
        marks = marks.filter(F.contains(own, F.lit(text)) if step.part else own == text).select("page", F.col("parent").alias("k")).distinct()
        some = some.join(marks, ["page", "k"], "left_semi")
    if above is not None and step.child:
        some = some.join(above.select("page", F.col("k").alias("parent")), ["page", "parent"], "left_semi").select(*nodes.columns)
    elif above is not None:
        # how many of the elements above are open where an element begins; ends count before it, starts after it
        turns = above.filter("last > k").select("page", F.col("k").alias("place"), F.lit(2).alias("turn"), F.lit(1).alias("step"))
        turns = turns.unionByName(above.filter("last > k").select("page", F.col("last").alias("place"), F.lit(0).alias("turn"), F.lit(-1).alias("step")))
        rows = some.withColumns({"place": F.col("k"), "turn": F.lit(1), "step": F.lit(0)}).unionByName(turns, allowMissingColumns=True)
        open_ = F.sum("step").over(Window.partitionBy("page").orderBy("place", "turn").rowsBetween(Window.unboundedPreceding, 0))
        some = rows.withColumn("open", open_).filter("turn = 1 AND open > 0").select(*nodes.columns)
    elif step.child:
        some = some.filter("parent = -1")
    if step.place:
        some = some.withColumn("nth", F.row_number().over(Window.partitionBy("page", "parent").orderBy("k"))).filter(F.col("nth") == step.place).drop("nth")
    return some


def _slice(at: Column, until: Column, apart: bool) -> Column:
    part = F.substring(F.col("text"), (at + 1).cast("int"), (until - at).cast("int"))
    return part if apart else F.replace(part, F.lit(MARK), F.lit(""))


def select_fields(pages: DataFrame, fields: dict[str, Field], key: str = "page_id", html: str = "html") -> DataFrame:
    """One row for each page: its key and an array of strings for each field, in the order of the page."""
    trees = settle(_trees(pages.select(F.col(key).alias("page"), F.lit(None).cast("array<int>").alias("ks"), _sources(html).alias("sources"))), "page-trees")
    page_texts, nodes = trees.select("page", "text"), trees.select("page", F.inline("nodes"))
    parts = []
    for name, field in fields.items():
        at = reduce(lambda above, step: _below(nodes, above, step, page_texts), field.steps, None)
        value = attribute(F.col("source"), field.attribute) if field.attribute else F.lit(None).cast("string")
        parts.append(at.select("page", F.struct("k", F.lit(name).alias("field"), "at", "until", value.alias("value")).alias("x")))
    hits = reduce(DataFrame.unionByName, parts).groupBy("page").agg(F.array_sort(F.collect_list("x")).alias("hits"))

    def values(name: str, field: Field) -> Column:
        own = F.filter("hits", lambda x: x["field"] == name)
        if field.attribute:
            return F.array_compact(F.transform(own, lambda x: x["value"]))
        if field.nodes:
            return F.flatten(F.transform(own, lambda x: F.transform(F.filter(F.split(_slice(x["at"], x["until"], True), MARK, -1), lambda t: t != ""), unescape)))
        return F.transform(own, lambda x: unescape(_slice(x["at"], x["until"], False)))

    none = F.array().cast("array<string>")
    out = page_texts.join(hits, "page", "left")
    return out.select(F.col("page").alias(key), *[F.coalesce(values(n, f), none).alias(n) for n, f in fields.items()])
