"""Selectors with combinators, against a tree built and searched the slow way."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from strandline.functions import selectors


class Node:
    def __init__(self, name, attrs, parent):
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []


def tree(page):
    root = Node("", {}, None)
    here, nodes = root, []
    for slash, name, attrs in re.findall(r'<(/?)([a-z0-9]+)((?: [a-z]+="[^"]*")*)>', page):
        path = []
        while here is not None:
            path.append(here)
            here = here.parent
        here = path[0]
        if slash:
            named = [n for n in path if n.name == name]
            here = named[0].parent if named else here
            continue
        while here.name in selectors.ENDS.get(name, ()):
            here = here.parent
        node = Node(name, dict(re.findall(r'([a-z]+)="([^"]*)"', attrs)), here)
        here.children.append(node)
        nodes.append(node)
        if name not in selectors.VOID:
            here = node
    return nodes


def meets(node, compounds, joins):
    name, parts = compounds[-1]
    if node.name == "" or (name and node.name != name):
        return False
    for part in parts:
        if part[0] == "." and part[1:] not in node.attrs.get("class", "").split():
            return False
        if part[0] == "[" and part[1:-1] not in node.attrs:
            return False
    if not joins:
        return True
    before = node.parent.children[: node.parent.children.index(node)]
    up, above = node.parent, []
    while up is not None:
        above.append(up)
        up = up.parent
    others = {" ": above, ">": above[:1], "+": before[-1:], "~": before}[joins[-1]]
    return any(meets(o, compounds[:-1], joins[:-1]) for o in others)


RULES = ["nav a->href", "nav > ul > li > a->href", "h2 + p a, h2 ~ .x > a -> href", "li li + li a[title]->href", ".x .x > *->href", "tr ~ tr td > a->href"]


def test_random_pages(spark):
    rng = random.Random(5)
    names = ["nav", "ul", "li", "a", "p", "h2", "div", "b", "table", "tr", "td", "br", "img"]

    def tag(i):
        name = rng.choice(names)
        if rng.random() < 0.35:
            return f"</{name}>"
        attrs = f' href="/{i}"' if name in "a b" or rng.random() < 0.3 else ""
        return f"<{name}{attrs}" + rng.choice(["", "", ' class="y x"', ' title="<a>"']) + ">"

    pages = ["".join(tag(i) + rng.choice(["", "text"]) for i in range(rng.choice([0, 1, 30, 700]))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(pages)) + [(-1, None)], "i int, html string")
    got = {r.i: r for r in df.select("i", *[selectors.nested_link_values(F.col("html"), [r]).alias(str(n)) for n, r in enumerate(RULES)]).collect()}
    assert not got[-1]["0"]
    total = 0
    for i, page in enumerate(pages):
        nodes = tree(page)
        for n, rule in enumerate(RULES):
            chains = selectors.parse(rule)
            want = [x.attrs["href"] for x in nodes if "href" in x.attrs and any(meets(x, c.compounds, c.joins) for c in chains)]
            assert got[i][str(n)] == want, (rule, page)
            total += len(want)
    assert total > 300
    together = df.select("i", selectors.nested_link_values(F.col("html"), RULES).alias("v")).collect()
    assert all(set(r.v or ()) == set().union(*(got[r.i][str(n)] or () for n in range(len(RULES)))) for r in together)


def test_time_grows_with_the_page(spark):
    """Large pages, deep ones and ones that never close: no more than linear."""
    rule = ["div div a[href]->href"]
    for unit in ('<div><a href="/x">x</a></div>', '<div><a href="/x">', "</div>", '<div a="'):
        took = []
        for size in (60_000, 480_000):
            df = spark.createDataFrame([("<div>" + unit * (size // len(unit)),)], "html string")
            start = time.perf_counter()
            n = df.select(F.size(selectors.nested_link_values(F.col("html"), rule))).first()[0]
            took.append(time.perf_counter() - start)
        assert n == (size // len(unit) if "<a" in unit else 0)
        assert took[1] < 12 * took[0] + 5


@pytest.mark.parametrize("rule", ["a >->href", "> a->href", "a,->href", "a b", "a:hover b->href", "a[b c->href", "->href", ", a->href"])
def test_refused(rule):
    with pytest.raises(ValueError):
        selectors.parse(rule)
