"""Trees, selectors and field ladders on small pages."""

import pytest
from pyspark.sql import functions as F

from rosterline.functions.html import build_tree
from rosterline.functions.nodes import Page, parse_selector, with_dom
from rosterline.operators import extract as X
from rosterline.operators.schema import PERSON, RecordSchema

PROFILE = """<html lang="en"><head><meta property="og:url" content="https://u.edu/people/wiel">
<meta property="og:title" content="Prof. Tomas Wiel"><title>Geology | Wiel</title></head><body><div id="wrap">
<section class="biography"><p>Tomas maps glaciers of the northern ranges with students from four countries, and keeps
the longest record of their melt.</p></section>
<header><h1>Prof. Tomas Wiel</h1><span class="title">Professor of Geology</span></header>
<dl><dt>Email</dt> <dd><a href="mailto:wiel@u.edu">wiel@u.edu</a></dd> <dt>Phone</dt> <dd><a href="tel:212-555-0188">212-555-0188</a></dd></dl>
<table><tr><td class="department">Earth Sciences</td><td class="location">Building C, Floor 2</td></tr></table>
</div></body></html>"""


def fields(spark, html, build, **more):
    df = with_dom(spark.createDataFrame([(html, "https://u.edu/cur")], "html string, url string"))
    return df.select(build(Page()).alias("v")).first().v


def selected(spark, html, selector):
    return fields(spark, html, lambda p: F.transform(p.select(selector), p.text_of))


def test_tree_tolerates_unclosed_and_misnested():
    text, nodes = build_tree("<p>a<p><b>b<br><p>c</b><ul><li>1<li>2</ul><table><tr><td>x<td>y<tr><td>z</table>")
    assert text == "abc12xyz"
    assert [(n[4], text[n[6]:n[7]]) for n in nodes if n[4] in ("p", "li", "td", "tr")] == [
        ("p", "a"), ("p", "b"), ("p", "c"), ("li", "1"), ("li", "2"), ("tr", "xy"), ("td", "x"), ("td", "y"),
        ("tr", "z"), ("td", "z")]
    for node_id, n in enumerate(nodes):
        assert n[0] == node_id and n[2] >= node_id and (n[1] < node_id)


@pytest.mark.parametrize("html", [None, "", "plain &amp; text", "<![CDATA[x]]><p>a", "<", "</p></div>", "<a href=x",
                                  "<p a=1 a=2 b>t", "<script>var x='</p>'</script><p>k"])
def test_tree_accepts_anything(html):
    text, nodes = build_tree(html)
    assert [n[4] for n in nodes][:1] == ["html"] and "body" in [n[4] for n in nodes]


def test_head_and_scripts_carry_no_text():
    text, _ = build_tree("<head><title>T</title><style>s</style></head><body><script>x</script>b<!-- c --></body>")
    assert text == "b"


def test_next_sibling_is_text_or_element():
    text, nodes = build_tree("<p><b>Mail:</b> a@b.org <i>x</i></p>")
    b, i = [n for n in nodes if n[4] in ("b", "i")]
    assert text[b[8]:b[9]].strip() == "a@b.org" and i[8] == -1


def test_selectors(spark):
    html = ('<div id="m" class="card big"><a href="/people/x">A</a><p data-k="v">B</p></div>'
            '<div class="cards"><button>Load More</button></div><p>C</p>')
    df = with_dom(spark.createDataFrame([(html,)], "html string"))
    cases = {"p": ["B", "C"], "*": None, ".card": ["AB"], '[class*="card"]': ["AB", "Load More"], "#m": ["AB"],
             'a[href*="/people"]': ["A"], "a[href^='/peo']": ["A"], "[data-k]": ["B"], "div.card p": ["B"],
             'button:contains("Load More")': ["Load More"], "button, .card a": ["A", "Load More"], "div .none": []}
    p = Page()
    row = df.select(*[F.transform(p.select(s), p.text_of).alias(f"c{i}") for i, s in enumerate(cases)]).first()
    for got, (selector, expected) in zip(row, cases.items()):
        assert expected is None or got == expected, selector



def test_selector_links_and_places(spark):
    html = ('<ul class="x y"><li class="one two" lang="en-GB">a</li><li>b<i>deep</i></li><li class="x">c</li><li>d</li>'
            '<li lang="en">e</li></ul><div><i>f</i><p><i>g</i></p></div>')
    df = with_dom(spark.createDataFrame([(html,)], "html string"))
    cases = {"div > i": ["f"], "div i": ["f", "g"], "ul>li>i": ["deep"], "li:first-child": ["a"], "li:last-child": ["e"],
             "li:nth-child(2)": ["bdeep"], "li:nth-child(odd)": ["a", "c", "e"], "li:nth-child(even)": ["bdeep", "d"],
             "li:nth-child(3n+1)": ["a", "d"], "li:nth-child(-n+2)": ["a", "bdeep"], "li:not(.x):not([lang])": ["bdeep", "d"],
             "li:not(.x, .one)": ["bdeep", "d", "e"], "li.x + li": ["d"], "li.x ~ li": ["d", "e"], '[class~="two"]': ["a"],
             '[class~="tw"]': [], "li[lang|=en]": ["a", "e"], "li.one + li > i, div > p i": ["deep", "g"], "html:first-child > body > div i": ["f", "g"]}
    p = Page()
    row = df.select(*[F.transform(p.select(s), p.text_of).alias(f"c{i}") for i, s in enumerate(cases)]).first()
    for got, (selector, expected) in zip(row, cases.items()):
        assert got == expected, selector


@pytest.mark.parametrize("selector", ["", "p,", "> p", "p >", "p > > i", "p:hover", "a::before", "p:not(i b)", "[a!=b]", ".a%", "p:nth-child(x)"])
def test_unknown_selectors_raise(selector):
    with pytest.raises(ValueError):
        parse_selector(selector) and Page().select(selector)


def test_resolvers_on_profile(spark):
    df = with_dom(spark.createDataFrame([(PROFILE, "https://u.edu/cur")], "html string, url string"))
    row = X.resolve_all_fields(df).first().asDict()
    assert row["bio"].startswith("Tomas maps glaciers") and len(row.pop("bio")) > 50
    assert row == {"name": "Prof. Tomas Wiel", "email": "wiel@u.edu", "phone": "212-555-0188",
                   "title": "Professor of Geology", "page_url": "https://u.edu/people/wiel",
                   "org": "Earth Sciences", "location": "Building C, Floor 2"}


def test_ladder_goes_to_next_selector_not_next_match(spark):
    html = '<div class="title">' + "x" * 250 + '</div><div class="title">Boss</div><i class="role">Lead</i>'
    assert fields(spark, html, lambda p: X.resolve_title(p, F.lit(""))) == "Lead"


def test_resolver_edges(spark):
    assert fields(spark, "<h1>ab</h1><meta name='twitter:title' content='Jo Doe'>", X.resolve_name) == "Jo Doe"
    assert fields(spark, "<p>x test@a.org y real@b.org</p>", X.resolve_email) == "real@b.org"
    assert fields(spark, "<p>x test@a.org y</p>", X.resolve_email) == "test@a.org"
    assert fields(spark, "<a href='tel:'>t</a> 212-555-0188", X.resolve_phone) == ""
    assert fields(spark, "<h1>Jo Doe</h1><p class=title>JO DOE</p>", lambda p: X.resolve_title(p, X.resolve_name(p))) == ""
    long = "This paragraph is clearly longer than thirty characters."
    html = f"<p>{long}</p><p>short</p><p>{long}</p><p>{long} fourth</p>"
    assert fields(spark, html, X.resolve_bio) == f"{long} {long}"
    assert fields(spark, "<link rel=canonical href='/c'>", lambda p: X.resolve_page_url(p, F.lit("u"))) == "/c"
    assert fields(spark, "<p>x</p>", lambda p: X.resolve_page_url(p, F.lit("u"))) == "u"


def test_generic_ladders(spark):
    assert fields(spark, PROFILE, X.generic_name) == "Prof. Tomas Wiel"
    assert fields(spark, PROFILE, X.generic_email) == "wiel@u.edu"
    assert "Professor" in fields(spark, PROFILE, X.generic_title)
    assert "glaciers" in fields(spark, PROFILE, X.generic_bio)
    assert fields(spark, PROFILE, X.generic_org) == "Earth Sciences"
    assert fields(spark, PROFILE, X.generic_location) == "Building C, Floor 2"
    assert fields(spark, "<p>Position : Chief</p>", X.generic_title) == "Chief"


def test_label_scan(spark):
    by = lambda html, labels, **k: fields(spark, html, lambda p: X.extract_by_label(p, labels, **k))
    assert by("<dl><dt>Office</dt><dd>Room 5</dd></dl>", ["office"]) == "Room 5"
    assert by("<div><p><b>Rank</b></p><p>Dean</p></div>", ["rank"]) == "Dean"
    assert by("<p>Rank: Dean</p>", ["rank"]) == "Dean"
    assert by("<p><b>Mail:</b> a@b.org <i>x</i></p>", ["mail"]) == "a@b.org"
    assert by("<p>Ranking: Dean</p>", ["rank"]) is None
    assert by("<p>Grade: Dean</p>", ["rank", "grade"]) == "Dean"
    assert by("<div>Rank: Dean<p>more</p></div>", ["rank"], faithful=True) == "Deanmore"


def test_extract_by_schema(spark):
    df = with_dom(spark.createDataFrame([(PROFILE, "https://u.edu/cur")], "html string, url string"))
    row = X.extract_by_schema(df, PERSON).first()
    assert row.page_url == "https://u.edu/cur" and row.email == "wiel@u.edu" and row.phone == "212-555-0188"
    schema = RecordSchema.of({"fields": [{"name": "mail", "type": "str?", "synonyms": ["email"]}]})
    assert X.extract_by_schema(df, schema).first().mail == "wiel@u.edu"
