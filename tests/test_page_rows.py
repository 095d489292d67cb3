"""Elements made in a page's row: against the definitions by counting, and without a shuffle of events."""

import random

from corpusloom.operators import page_tree as P


def broken_page(r):
    names = ["p", "li", "ul", "ol", "html", "body", "div", "b", "br", "hr", "script"]
    token = lambda n: r.choice([f"<{n}>", f"<{n}>", f"</{n}>", f"</{n}>", f"<{n}/>", "text é😀", "<", "<!-- c -->", "</"])
    return "".join(token(r.choice(names)) for _ in range(r.randint(0, 40)))


def by_counting(tags, page_end):
    """Each end looked for among all later tags; levels are counts of all tags up to one."""
    up = lambda t, names: 0 if t[2] not in names else {"start": 1, "end": -1, "void": 0}[t[1]]
    level = lambda i, names: sum(up(t, names) for t in tags[: i + 1]) + (tags[i][1] == "end" and tags[i][2] in names)
    lists, spans = ("ul", "ol"), []
    for i, (k, kind, name, _, at) in enumerate(tags):
        later = range(i + 1, len(tags))
        place = lambda j: (tags[j][0], tags[j][4])
        if kind == "end":
            continue
        if kind == "void":
            end = (k, at)
        elif name == "p":
            end = next((place(j) for j in later if tags[j][2] in P.BLOCKS), page_end)
        elif name == "li":
            ends = (j for j in later if tags[j][1] != "void" and (tags[j][2] == "li" or tags[j][2] in lists and tags[j][1] == "end"))
            end = next((place(j) for j in ends if level(j, lists) == level(i, lists)), page_end)
        else:
            j = next((j for j in later if tags[j][1] != "void" and tags[j][2] == name and level(j, (name,)) == level(i, (name,))), None)
            end = place(j) if j is not None and tags[j][1] == "end" else page_end if name in ("html", "body") else (k, at)
        spans.append((k, end[0], at, end[1]))
    depth = {k: sum(a <= k < z for a, z, *_ in spans) + (last == k) for k, last, *_ in spans}
    parent = {k: max((a for a, z, *_ in spans if z > a and a < k and depth[a] == depth[k] - 1), default=-1) for k, *_ in spans}
    return [(*x, depth[x[0]], parent[x[0]]) for x in spans]


def test_elements_of_broken_pages(spark):
    r = random.Random(9)
    rows = [(k, broken_page(r)) for k in range(300)]
    pages = spark.createDataFrame(rows, "page_id int, html string")
    sources = {x.page_id: x.s for x in pages.select("page_id", P._sources("html").alias("s")).collect()}
    found = {k: [] for k, _ in rows}
    for x in P.elements(P.events(pages, "page_id", "html")).orderBy("page", "k").collect():
        found[x.page].append((x.k, x.last, x.at, x.until, x.depth, x.parent))
    for k, _ in rows:
        tags, end, _ = P._tags(range(len(sources[k])), sources[k])
        assert found[k] == by_counting(tags, end)
        assert [(x[0], x[1], *x[4:]) for x in P._nodes(range(len(sources[k])), sources[k])[0]] == found[k]


def test_events_are_not_shuffled(spark, monkeypatch):
    plans, plain = [], P.settle

    def settle(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name)

    monkeypatch.setattr(P, "settle", settle)
    pages = spark.createDataFrame([(1, "<div><p>a &amp; b<p>c</div>"), (2, None)], "page_id int, html string")
    fields = {"p": P.Field((P.Step("div"), P.Step("p"))), "n": P.Field((P.Step("p"),), nodes=True)}
    assert sorted(P.select_fields(pages, fields).collect()) == [(1, ["a & b", "c"], ["a & b", "c"]), (2, [], [])]
    assert plans and not any("Exchange" in x for x in plans)
