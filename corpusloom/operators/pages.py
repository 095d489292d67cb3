"""Page extraction and the tables of requests that a crawl would make (no network access)."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.operators import page_tree, tables
from corpusloom.runtime import ship


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)</title>", 1)


def links(html: Column) -> Column:
    """The values of href attributes as they stand, in double, single or no quotes."""
    values = F.regexp_extract_all(html, F.lit(r"""(?i)\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""), F.lit(1))
    return F.transform(values, lambda v: F.when(v.rlike("^[\"']"), F.substring(v, F.lit(2), F.char_length(v) - 2)).otherwise(v))


def text_by_pattern(html: Column) -> Column:
    """Text without scripts, styles, comments and tags; white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.paragraphs: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        if tag in ("p", "br", "div", "li", "tr") or tag[:1] == "h" and tag[1:].isdigit():
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0
        if tag in ("p", "div"):
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def parse_text(source: str | None) -> str:
    reader = _Reader()
    reader.feed(source or "")
    reader.close()
    lines = (" ".join(x.split()) for x in "".join(reader.out).split("\n"))
    return "\n".join(x for x in lines if x)


def page_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """Add body: the page's text by a real parser, one line for each block."""
    ship(pages.sparkSession)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(parse_text)

    return pages.withColumn("body", run(column))


#: Where judgements of the supreme court keep their fields: the subjects stand second in an i with the
#: first heading in bold, the summary in the paragraph with the second heading in bold, the body in a paragraph of the font.
SUBJECT, SUMMARY = "Θέμα", "Περίληψη:"


def _body(place: int) -> page_tree.Field:
    below = [page_tree.Step(n, child=True) for n in ("html", "body", "font")]
    return page_tree.Field((*below, page_tree.Step("p", child=True, place=place)), nodes=True)


JUDGEMENT = {
    "subject": page_tree.Field((page_tree.Step("i", marked=("b", SUBJECT)),), nodes=True),
    "summary": page_tree.Field((page_tree.Step("p", marked=("b", SUMMARY)),), nodes=True),
    **{f"body{k}": _body(k) for k in (2, 3, 4)},
}


def judgement_fields(pages: DataFrame, key: str = "page_id", html: str = "html", signifier: str = "ΔΙΚΑΣΤΗΡΙΟ", section: str = "ΤΜΗΜΑ") -> DataFrame:
    """One row a page: its key, case_tags, summary, court_category, text. The fourth paragraph is the text where there
    are tags and a summary, else the second or third one, whichever has more pieces (the third if equal); a text that begins with a
    summary starts after its first row of dashes."""
    d = page_tree.select_fields(pages, JUDGEMENT, key, html)
    tags = F.coalesce(F.get("subject", F.lit(1)), F.lit(""))
    joined = F.array_join(F.slice("summary", F.lit(2), F.greatest(F.size("summary") - 1, F.lit(0))), " ")
    d = d.withColumns({"case_tags": tags, "summary": F.substring(joined, F.lit(2), F.char_length(joined))})
    other = F.when(F.size("body2") > F.size("body3"), F.col("body2")).otherwise(F.col("body3"))
    d = d.withColumn("pieces", F.when((F.col("case_tags") != "") & (F.col("summary") != ""), F.col("body4")).otherwise(other))
    whole = F.array_join("pieces", "")
    rest = F.slice(F.split(whole, "------", -1), F.lit(2), F.greatest(F.size(F.split(whole, "------", -1)) - 1, F.lit(0)))
    dashed = F.when(F.contains(whole, F.lit("---")) & (F.char_length(F.replace(whole, F.lit("---"), F.lit("\n"))) > 30), F.replace(F.array_join(rest, "\n"), F.lit("--"), F.lit(""))).otherwise("")
    text = F.when(starts_with_summary(whole, ("Περίληψη", "Περιληψη", "περίληψη", "περιληψη")), dashed).otherwise(whole)
    return d.select(key, "case_tags", "summary", court_type(F.col("pieces"), signifier, section).alias("court_category"), F.trim(text, F.lit(" \t\n\r\x0b\x0c")).alias("text"))


def _result(*steps: page_tree.Step, **how) -> page_tree.Field:
    box = page_tree.Step("div", attrs=(("id", "result-container"),))
    return page_tree.Field((box, page_tree.Step("div", cls="expand_block"), *steps), **how)


#: Where a page of search results keeps the parts of its results.
RESULTS = {
    "metadata_url": _result(page_tree.Step("a", child=True), attribute="href"),
    "url": _result(page_tree.Step("li", cls="text"), page_tree.Step(attrs=(("href", None),)), attribute="href"),
    "provider": _result(page_tree.Step("li", marked=("strong", "Πάροχος ECLI:"), part=True), nodes=True),
    "country": _result(page_tree.Step("li", marked=("strong", "Χώρα"), part=True), nodes=True),
    "court": _result(page_tree.Step("li", marked=("strong", "Δικαστήριο"), part=True), nodes=True),
    "date": _result(page_tree.Step("li", marked=("strong", "Ημερομηνία"), part=True), nodes=True),
}


def search_results(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row for each result of each page: key, and the parts of RESULTS; lists of unequal length on one page are an error."""
    d = page_tree.select_fields(pages, RESULTS, key, html)
    second = lambda c: F.filter(F.col(c), lambda x, i: i % 2 == 1)  # the text behind each label
    d = d.withColumns({c: second(c) for c in ("provider", "country", "court", "date")})
    return tables.zip_equal(d.select(key, *RESULTS), list(RESULTS))


def court_type(lines: Column, signifier: str, section: str) -> Column:
    """The line after the first one with the signifier, or the one after that if the signifier's own line holds the
    section word; null if there is none."""
    at = F.array_position(F.transform(lines, lambda x: F.contains(x, F.lit(signifier))), True)
    step = F.when(F.contains(F.try_element_at(lines, at.cast("int")), F.lit(section)), 2).otherwise(1)
    return F.when(at > 0, F.try_element_at(lines, (at + step).cast("int")))


def body_or_fallback(a: Column, b: Column, dashes: str = "------") -> Column:
    """The longer list of paragraphs as one text, without a leading section that dashes close."""
    text = F.array_join(F.when(F.size(a) >= F.size(b), a).otherwise(b), "\n")
    parts = F.split(text, dashes, -1)
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(2), F.size(parts) - 1), "\n")).otherwise(text)


def starts_with_summary(text: Column, spellings: tuple[str, ...] = ("Περίληψη", "ΠΕΡΙΛΗΨΗ", "Περιληψη", "ΠΕΡΊΛΗΨΗ")) -> Column:
    found = F.lit(False)
    for s in spellings:
        found |= F.startswith(text, F.lit(s))
    return found


def crawl_requests(spark: SparkSession, first: int = 1980, last: int = 2022, ids: int = 3000) -> DataFrame:
    """(year, id): every year with every number; each year's numbers come from a sequence, no join."""
    return spark.range(first, last + 1).select(F.col("id").alias("year"), F.explode(F.sequence(F.lit(1), F.lit(ids))).alias("id"))


def page_offsets(counts: DataFrame, step: int = 25) -> DataFrame:
    """counts (year, n) -> (year, start): 1, 26, ... below n."""
    return counts.filter("n > 1").select("year", F.explode(F.sequence(F.lit(1), (F.col("n") - 1).cast("int"), F.lit(step))).alias("start"))


def year_label(number: Column, year: Column) -> Column:
    return F.concat_ws("/", number, year)
