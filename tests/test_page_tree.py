"""Elements and fields of pages against a stack machine over the standard library's tokenizer."""

import random
from html.parser import HTMLParser

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusloom.operators import page_tree as P, pages

S, Fd = P.Step, P.Field


def frame(spark, *htmls):
    return spark.createDataFrame(list(enumerate(htmls)), "page_id int, html string")


def fields(spark, html, **wanted):
    return P.select_fields(frame(spark, html), wanted).first().asDict()


def test_unclosed_single_quotes_and_case(spark):
    html = """<HTML><body><P CLASS='a b'>One<br>two &amp; &#233;<p>Three <b>fo<i>ur</b></p><A HREF=/x?y=1&amp;z>L</A><a href='/q'>M</a>
    <script>var t = "<p>no</p>";</script><style>p{}</style><!-- <p>no</p> --><ul><li>a<li>b<ul><li>c</ul><li>d</ul><p>last"""
    got = fields(
        spark,
        html,
        p=Fd((S("p"),)),
        a=Fd((S("p", cls="b"),)),
        pieces=Fd((S("p", cls="a"),), nodes=True),
        href=Fd((S("a"),), attribute="href"),
        li=Fd((S("li"),)),
        inner=Fd((S("ul"), S("ul"), S("li"))),
        marked=Fd((S("p", marked=("b", "four")),)),
        second=Fd((S("html", child=True), S("body", child=True), S("p", child=True, place=2))),
        none=Fd((S("table"), S("td"))),
    )
    assert got["p"] == ["Onetwo & é", "Three four", "last"] and got["a"] == ["Onetwo & é"] and got["pieces"] == ["One", "two & é"]
    assert got["href"] == ["/x?y=1&z", "/q"] and got["li"] == ["a", "bc", "c", "d"] and got["inner"] == ["c"]
    assert got["marked"] == got["second"] == ["Three four"] and got["none"] == []


def test_empty_null_and_plain_pages(spark):
    rows = P.select_fields(frame(spark, None, "", "plain < text", "<p", "</p></p>x<p>y"), {"p": Fd((S("p"),))}).orderBy("page_id").collect()
    assert [r.p for r in rows] == [[], [], [], [], ["y"]]
    assert P.select_fields(frame(spark).limit(0), {"p": Fd((S("p"),))}).count() == 0


class Stack(HTMLParser):
    """(name, text) of every element by a stack of open elements; only names that authors close, and br."""

    def __init__(self):
        super().__init__()
        self.open, self.found = [], []

    def handle_starttag(self, tag, attrs):
        item = [tag, "", len(self.open)]
        self.found.append(item)
        if tag != "br":
            self.open.append(item)

    def handle_endtag(self, tag):
        assert self.open.pop()[0] == tag

    def handle_data(self, data):
        for item in self.open:
            item[1] += data


def random_page(r, depth=0):
    out = ""
    for _ in range(r.randint(0, 4)):
        kind = r.choice(["text", "br", "div", "span", "em", "td"])
        out += {"text": f"t{r.randint(0, 99)} ", "br": "<br>"}.get(kind) or (f"<{kind}>{random_page(r, depth + 1)}</{kind}>" if depth < 5 else "")
    return out


def test_elements_against_a_stack(spark):
    r = random.Random(4)
    htmls = [random_page(r) for _ in range(60)]
    found = P.events(frame(spark, *htmls), "page_id", "html")
    rows = P.elements(found).join(P.texts(found), "page").orderBy("page", "k").collect()
    for page, html in enumerate(htmls):
        stack = Stack()
        stack.feed(html)
        stack.close()
        own = [x for x in rows if x.page == page]
        assert [(x.name, x.text[x.at : x.until].replace(P.MARK, ""), x.depth) for x in own] == [(n, t, d + 1) for n, t, d in stack.found]
        depth = {x.k: x.depth for x in own} | {-1: 0}
        assert all(depth[x.parent] == x.depth - 1 for x in own)


def test_unescape(spark):
    text = "&lt;&amp;lt;&#65;&#x1F600;&#0;&#55296;&unknown;&nbsp;&quot; &#;"
    assert spark.createDataFrame([(text,), (None,)], "t string").select(P.unescape(F.col("t"))).collect() == [("<&lt;A😀��&unknown;\xa0\" &#;",), (None,)]


def test_many_tags_and_long_attributes(spark):
    html = "<div>" + "".join(f"<p>x{k}" for k in range(3000)) + f'<a href="{"u" * 50_000}" title="{"v" * 20_000}">z</a></div>'
    got = fields(spark, html, p=Fd((S("div"), S("p"))), href=Fd((S("a"),), attribute="href"))
    assert got["p"][:-1] == [f"x{k}" for k in range(2999)] and got["p"][-1] == "x2999z" and got["href"] == ["u" * 50_000]


JUDGEMENT = "<html><body><font><p>0</p><p>{p2}</p><p>{p3}</p><p>{p4}</p></font><i><b>Θέμα</b>{tags}</i>{summary}</body></html>"


def test_judgement_fields(spark):
    full = JUDGEMENT.format(p2="a", p3="b", p4="Α<br>ΔΙΚΑΣΤΗΡΙΟ<br>Γ' ΤΜΗΜΑ<br>body", tags="tag one", summary="<p><b>Περίληψη:</b>\nFirst.<br>Second.</p>")
    bare = JUDGEMENT.format(p2="x<br>y<br>z", p3="b", p4="c", tags="", summary="")
    dashed = JUDGEMENT.format(p2="q", p3="Περίληψη of it ------ the text -- goes on for long enough", p4="c", tags="", summary="")
    rows = pages.judgement_fields(frame(spark, full, bare, dashed, None)).orderBy("page_id").collect()
    assert rows[0][1:] == ("tag one", "First. Second.", "Γ' ΤΜΗΜΑ", "ΑΔΙΚΑΣΤΗΡΙΟΓ' ΤΜΗΜΑbody")
    assert (rows[1].case_tags, rows[1].summary, rows[1].court_category, rows[1].text) == ("", "", None, "xyz")
    assert rows[2].text == "the text  goes on for long enough" and rows[3].text == ""


RESULT = '<div class="expand_block"><a href="/m{k}">m</a><ul><li class="text"><a href="/t{k}">t</a></li>' + "".join(
    f"<li><strong>{label}</strong>{value}</li>" for label, value in (("Πάροχος ECLI:", "prov"), ("Χώρα:", "GR"), ("Δικαστήριο:", "StE"), ("Ημερομηνία:", "1/2/2003"))
)


def test_search_results(spark):
    page = '<div id="result-container">' + "".join(RESULT.format(k=k) + "</ul></div>" for k in range(3)) + "</div>"
    rows = pages.search_results(frame(spark, page)).collect()
    assert sorted(tuple(r) for r in rows) == [(0, f"/m{k}", f"/t{k}", "prov", "GR", "StE", "1/2/2003") for k in range(3)]
    with pytest.raises(PySparkException):
        pages.search_results(frame(spark, page.replace('href="/m1"', ""))).collect()


def test_links_of_all_forms(spark):
    got = frame(spark, """<a href="/a">x</a><A HREF='/b'>y</A><a class=q href=/c>z</a> hrefs""").select(pages.links(F.col("html"))).first()[0]
    assert got == ["/a", "/b", "/c"]
