"""Selecting nodes and reading them, with array functions over the page tree."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.functions.html import page_dom
from rosterline.functions.text import clean_text, let, py_strip

Predicate = Callable[[Column], Column]

_SIMPLE = re.compile(
    r"""\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[*^$~|]?=)\s*(?P<q>["']?)(?P<value>.*?)(?P=q)\s*)?\]"""
    r"""|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)"""
    r"""|:contains\(\s*(?P<cq>["']?)(?P<needle>.*?)(?P=cq)\s*\)|:not\(\s*(?P<inner>(?:\[[^\]]*\]|[^()\[\]])+?)\s*\)"""
    r"""|:nth-child\(\s*(?P<nth>odd|even|[+-]?\d*n(?:\s*[+-]\s*\d+)?|[+-]?\d+)\s*\)|:(?P<edge>first|last)-child(?![\w-])"""
    r"""|(?P<tag>\*|[A-Za-z][\w-]*)"""
)
_LINK = re.compile(r"\s*([>+~,])\s*|\s+")


def parse_selector(selector: str) -> list[list[tuple[str, list[re.Match]]]]:
    """Alternatives, each a chain of (link to the compound before, simple selectors); what isn't known raises."""
    chains: list[list[tuple[str, list[re.Match]]]] = [[]]
    link, at, text = "", 0, selector.strip()
    while at < len(text):
        between, simple = _LINK.match(text, at), _SIMPLE.match(text, at)
        if between and (link or not chains[-1]) or not between and not simple:
            raise ValueError(f"unsupported selector at {text[at:]!r}: {selector}")
        if between and between[1] == ",":
            chains.append([])
        elif between:
            link = between[1] or " "
        elif link or not chains[-1]:
            chains[-1].append((link, [simple]))
            link = ""
        elif simple["tag"]:
            raise ValueError(f"a tag must come first: {selector}")
        else:
            chains[-1][-1][1].append(simple)
        at = (between or simple).end()
    if link or not all(chains):
        raise ValueError(f"incomplete selector: {selector!r}")
    return chains


def _nth(formula: str) -> tuple[int, int]:
    """``a`` and ``b`` of an+b."""
    formula = {"odd": "2n+1", "even": "2n"}.get(formula, re.sub(r"\s", "", formula))
    if "n" not in formula:
        return 0, int(formula)
    a, b = formula.split("n")
    return int(a + "1" if a in ("", "+", "-") else a), int(b or 0)


def attr(node: Column, name: str) -> Column:
    """Attribute value, '' when absent."""
    return F.coalesce(node["attrs"][name], F.lit(""))


def _ranks(places: Column, size: Column) -> Column:
    """For every place from 0 to ``size`` how many of the sorted ``places`` lie before it: a table to look up in."""
    return let(places, lambda at: F.flatten(F.concat(
        F.transform(at, lambda p, i: F.array_repeat(i, p - F.coalesce(F.get(at, i - 1), F.lit(-1)))),
        F.array(F.array_repeat(F.size(at), size - F.coalesce(F.get(at, F.size(at) - 1), F.lit(-1)))))))


def _held(ranks: Column, places: Column, place: Column) -> Column:
    """The position of ``place`` in the sorted, distinct ``places``; null if it isn't there."""
    rank = F.get(ranks, place)
    return F.when(F.get(places, rank) == place, rank)


@dataclass(frozen=True)
class Scope:
    """A page, or one node of it, to select in."""

    text: Column
    nodes: Column
    page_nodes: Column

    def pool(self, tag: str | None, attrs: set[str]) -> Column:
        return self.nodes

    def text_of(self, node: Column) -> Column:
        """Deep text of a node."""
        return F.substring(self.text, node["t0"] + 1, node["t1"] - node["t0"])

    def clean_text_of(self, node: Column) -> Column:
        return clean_text(self.text_of(node))

    def next_text_of(self, node: Column) -> Column:
        """Stripped text of the next sibling; null when there is none."""
        return F.when(
            node["n0"] >= 0, py_strip(F.substring(self.text, node["n0"] + 1, node["n1"] - node["n0"]))
        )

    def parent_of(self, node: Column) -> Column:
        return F.when(node["parent"] >= 0, F.get(self.page_nodes, node["parent"]))

    def within(self, node: Column) -> Scope:
        """The descendants of ``node``, got by their places: a slice would first unpack all nodes of the page."""
        places = F.when(node["last"] > node["id"], F.sequence(node["id"] + 1, node["last"])).when(node.isNotNull(), F.array().cast("array<int>"))
        return Scope(self.text, F.transform(places, lambda k: F.get(self.page_nodes, k)), self.page_nodes)

    def _place(self, node: Column) -> Column:
        """Position among the elements of the same parent, from 1."""
        until = F.slice(self.page_nodes, node["parent"] + 2, node["id"] - node["parent"])
        return F.size(F.filter(until, lambda s: s["parent"] == node["parent"]))

    def _is_last(self, node: Column) -> Column:
        return node["last"] == F.coalesce(self.parent_of(node)["last"], F.size(self.page_nodes) - 1)

    def _at(self, node: Column, a: int, b: int) -> Column:
        """Is the an+b-th child for some n from 0."""
        off = self._place(node) - b
        return off == 0 if a == 0 else (off % a == 0) & (off * (1 if a > 0 else -1) >= 0)

    def _without(self, selector: str) -> Predicate:
        """None of the compounds of the list holds."""
        compounds = []
        for chain in parse_selector(selector):
            if len(chain) > 1:
                raise ValueError(f":not() takes compounds only: {selector}")
            compounds.append(self._compound(chain[0][1])[0])
        return lambda n: ~reduce(or_, [holds(n) for holds in compounds])

    def _compound(self, simples: list[re.Match]) -> tuple[Predicate, Column]:
        tag, attrs, tests = None, set(), []
        for m in simples:
            if m["tag"]:
                tag = m["tag"]
                if tag != "*":
                    tests.append(lambda n, t=tag: n["tag"] == t.lower())
            elif m["cls"]:
                attrs.add("class")
                pattern = rf"(?:^|\s){re.escape(m['cls'])}(?:\s|$)"
                tests.append(lambda n, p=pattern: attr(n, "class").rlike(p))
            elif m["id"]:
                tests.append(lambda n, v=m["id"]: attr(n, "id") == v)
            elif m["attr"]:
                name, op, value = m["attr"].lower(), m["op"], m["value"]
                attrs.add(name)
                test = {
                    None: lambda n, a=name: n["attrs"][a].isNotNull(),
                    "=": lambda n, a=name, v=value: attr(n, a) == v,
                    "*=": lambda n, a=name, v=value: attr(n, a).contains(v),
                    "^=": lambda n, a=name, v=value: attr(n, a).startswith(v),
                    "$=": lambda n, a=name, v=value: attr(n, a).endswith(v),
                    "~=": lambda n, a=name, v=value: F.lit(v != "") & F.array_contains(F.split(attr(n, a), r"\s+"), v),
                    "|=": lambda n, a=name, v=value: (n["attrs"][a].isNotNull()) & (
                        (attr(n, a) == v) | attr(n, a).startswith(v + "-")),
                }[op]
                tests.append(test)
            elif m["inner"]:
                tests.append(self._without(m["inner"]))
            elif m["nth"]:
                tests.append(lambda n, ab=_nth(m["nth"]): self._at(n, *ab))
            elif m["edge"]:
                tests.append((lambda n: n["id"] == n["parent"] + 1) if m["edge"] == "first" else self._is_last)
            else:
                tests.append(lambda n, v=m["needle"]: self.text_of(n).contains(v))

        def holds(node: Column) -> Column:
            result = F.lit(True)
            for i, test in enumerate(tests):
                result = test(node) if i == 0 else result & test(node)
            return result

        return holds, self.pool(tag, attrs)

    def _linked(self, before: Column, link: str, pool: Column, holds: Predicate) -> Column:
        """Nodes of ``pool`` that hold and lie to one of ``before`` as ``link`` says.

        Places count from the scope's first node. Each node is looked up in tables by place, so the time is linear in the nodes.
        """
        base = F.coalesce(F.get(self.nodes, F.lit(0))["id"], F.lit(0))
        size = F.size(self.nodes)

        def inside(first: Column) -> Column:
            """Nodes that more subtrees of ``before`` begin before than end before."""
            begins = _ranks(F.transform(before, lambda o: o["id"] - first), size)
            ends = _ranks(F.array_sort(F.transform(before, lambda o: o["last"] - first)), size)
            return let(F.struct(begins.alias("begins"), ends.alias("ends")), lambda t: F.filter(
                pool, lambda n: holds(n) & (F.get(t["begins"], n["id"] - first) > F.get(t["ends"], n["id"] - first))))

        def met(first: Column, places: Column, place: Predicate) -> Column:
            """Nodes whose ``place`` is one of the sorted, distinct ``places``."""
            return let(places, lambda at: let(_ranks(at, size), lambda r: F.filter(
                pool, lambda n: holds(n) & _held(r, at, place(n) - first).isNotNull())))

        def after(first: Column) -> Column:
            """Nodes behind the first of ``before`` that has the same parent; parents count from the one around the scope."""
            pairs = F.array_sort(F.transform(before, lambda o: F.struct((o["parent"] + 1 - first).alias("p"), o["id"].alias("id"))))
            firsts = let(pairs, lambda ps: F.filter(ps, lambda x, i: F.coalesce(F.get(ps, i - 1)["p"] != x["p"], F.lit(True))))
            return let(firsts, lambda fs: let(F.transform(fs, lambda x: x["p"]), lambda at: let(_ranks(at, size), lambda r: F.filter(
                pool, lambda n: holds(n) & F.coalesce(n["id"] > F.get(fs, _held(r, at, n["parent"] + 1 - first))["id"], F.lit(False))))))

        def next_ones(first: Column) -> Column:
            follow = F.transform(before, lambda o: F.struct(o["parent"].alias("p"), F.get(self.page_nodes, o["last"] + 1).alias("n")))
            return F.array_sort(F.transform(F.filter(follow, lambda x: x["n"]["parent"] == x["p"]), lambda x: x["n"]["id"] - first))

        return let(base, {
            " ": inside,
            ">": lambda first: met(first, F.transform(before, lambda o: o["id"] - first), lambda n: n["parent"]),
            "+": lambda first: met(first, next_ones(first), lambda n: n["id"]),
            "~": after,
        }[link])

    def select(self, selector: str) -> Column:
        """All nodes matching a CSS selector, in document order.

        Known forms: tag, ``*``, ``.class``, ``#id``, ``[attr]`` with ``= *= ^= $= ~= |=``,
        ``:contains()``, ``:not()``, ``:first-child``, ``:last-child``, ``:nth-child()``, compounds
        of these, descendants (blank), ``>``, ``+``, ``~`` and alternatives (comma); others raise.
        """
        found = []
        for chain in parse_selector(selector):
            matched = None
            for link, simples in chain:
                holds, pool = self._compound(simples)
                if link:
                    matched = let(matched, lambda before: self._linked(before, link, pool, holds))  # noqa: B023
                else:
                    matched = F.filter(pool, holds)
            found.append(matched)
        if len(found) == 1:
            return found[0]
        ids = F.flatten(F.array(*[F.transform(f, lambda n: n["id"]) for f in found]))
        return F.transform(F.array_sort(F.array_distinct(ids)), lambda k: F.get(self.page_nodes, k))

    def first(self, selector: str) -> Column:
        return F.get(self.select(selector), F.lit(0))

    def first_of(self, *selectors: str) -> Column:
        return F.coalesce(*[self.first(s) for s in selectors])

    def when_text(self, selector: str, accept: Predicate, shape: Predicate = lambda t: t) -> Column:
        """Clean text of the *first* match where ``accept`` holds, else null."""
        return let(
            self.clean_text_of(self.first(selector)),
            lambda t: F.when(accept(t), shape(t)),
        )


POOLS: dict[str, Predicate] = {
    "dom_anchors": lambda n: n["tag"] == "a",
    "dom_classed": lambda n: attr(n, "class") != "",
    "dom_props": lambda n: n["attrs"]["itemprop"].isNotNull(),
    "dom_metas": lambda n: n["tag"].isin("meta", "link"),
    "dom_heads": lambda n: n["tag"].isin("h1", "h2", "h3", "h4"),
}


class Page(Scope):
    """A whole page, with the few node lists that nearly all selectors need cut out once."""

    def __init__(self) -> None:
        super().__init__(F.col("dom_text"), F.col("dom_nodes"), F.col("dom_nodes"))

    def pool(self, tag: str | None, attrs: set[str]) -> Column:
        if tag == "a":
            return F.col("dom_anchors")
        if tag in ("meta", "link"):
            return F.col("dom_metas")
        if tag in ("h1", "h2", "h3", "h4"):
            return F.col("dom_heads")
        if "class" in attrs:
            return F.col("dom_classed")
        if "itemprop" in attrs:
            return F.col("dom_props")
        return F.col("dom_nodes")


DOM_COLUMNS = ["dom_text", "dom_nodes", *POOLS]


def with_dom(pages: DataFrame, html: str = "html", keep_html: bool = False) -> DataFrame:
    """Add the tree of every page and its node lists; narrow, no shuffle."""
    parsed = pages.withColumn("_dom", page_dom(html))
    if not keep_html:
        parsed = parsed.drop(html)
    return (
        parsed.withColumns({"dom_text": F.col("_dom.text"), "dom_nodes": F.col("_dom.nodes")})
        .drop("_dom")
        .withColumns({name: F.filter("dom_nodes", test) for name, test in POOLS.items()})
    )


def page_links(dom: DataFrame, *keys: str) -> DataFrame:
    """Every anchor of every page: keys, ord, text, href."""
    page = Page()
    links = F.transform(
        F.col("dom_anchors"),
        lambda n, i: F.struct(
            i.cast("bigint").alias("ord"), py_strip(page.text_of(n)).alias("text"), attr(n, "href").alias("href")
        ),
    )
    return dom.select(*keys, F.inline(links))
