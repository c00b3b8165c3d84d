"""Combinators of selectors: against all pairs of nodes, and on a large page."""

import random
import time

from pyspark.sql import functions as F

from rosterline.functions.nodes import Page, with_dom


def _random_page(g, n):
    """HTML of about n nested elements with classes."""
    out, open_tags = [], []
    for _ in range(n):
        while open_tags and g.random() < 0.45:
            out.append(f"</{open_tags.pop()}>")
        tag = g.choice(["div", "section", "span"])
        out.append(f'<{tag} class="{g.choice(["a", "b", "c"])}">')
        open_tags.append(tag)
    return "<html><body>" + "".join(out) + "".join(f"</{t}>" for t in reversed(open_tags)) + "</body></html>"


def test_combinators_against_all_pairs(spark):
    g = random.Random(4)
    pages = spark.createDataFrame([(k, _random_page(g, g.randrange(1, 60))) for k in range(30)], "k long, html string")
    dom = with_dom(pages).cache()
    relations = {
        " ": lambda n, o: o.id < n.id <= o.last, ">": lambda n, o: n.parent == o.id,
        "+": lambda n, o: n.parent == o.parent and n.id == o.last + 1, "~": lambda n, o: n.parent == o.parent and n.id > o.id,
    }

    def plain(nodes, steps):
        found = None
        for link, name in steps:
            found = [n for n in nodes if name in (n.attrs.get("class"), n.tag)
                     and (found is None or any(relations[link](n, o) for o in found))]
        return [n.id for n in found]

    chains = [[("", x), (k, y)] for k in relations for x, y in (("a", "b"), ("div", "a"), ("c", "c"))]
    chains += [[("", "a"), (k, "div"), (m, "b")] for k in relations for m in relations]
    css = ["".join(k + (f".{n}" if len(n) == 1 else n) for k, n in chain) for chain in chains]
    whole = [F.transform(Page().select(s), lambda n: n["id"]).alias(f"s{i}") for i, s in enumerate(css)]
    # Within a node: the second element's descendants.
    part = [F.transform(Page().within(F.get("dom_nodes", F.lit(2))).select(s), lambda n: n["id"]).alias(f"t{i}") for i, s in enumerate(css)]
    both = F.transform(Page().select(f"{css[3]}, {css[0]}, .b"), lambda n: n["id"]).alias("both")
    for r in dom.select("dom_nodes", *whole, *part, both).collect():
        for i, chain in enumerate(chains):
            assert r[f"s{i}"] == plain(r.dom_nodes, chain), css[i]
            if len(r.dom_nodes) > 2:
                inside = r.dom_nodes[3 : r.dom_nodes[2].last + 1]
                assert r[f"t{i}"] == plain(inside, chain), css[i]
        assert r.both == sorted({*plain(r.dom_nodes, chains[3]), *plain(r.dom_nodes, chains[0]), *plain(r.dom_nodes, [("", "b")])})


def test_combinators_take_linear_time(spark):
    many = 25_000
    html = "<html><body>" + '<div class="a"><span class="b">x</span></div>' * many + "</body></html>"
    dom = with_dom(spark.createDataFrame([(html,)], "html string"))
    begun = time.monotonic()
    r = dom.select(*[F.size(Page().select(s)).alias(f"n{i}") for i, s in enumerate([".a .b", ".a > .b", ".a + .a", ".a ~ .a", ".a, .b"])]).first()
    assert tuple(r) == (many, many, many - 1, many - 1, 2 * many)
    assert time.monotonic() - begun < 60  # all pairs would be 10^9 tests
