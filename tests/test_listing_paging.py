import urllib.robotparser

import pytest
from pyspark.sql import functions as F

from rosterline.functions.nodes import Page, page_links, with_dom
from rosterline.operators import hints, listing, paging, robots
from rosterline.operators.schema import PERSON

LIST = """<body><main id="staff"><p>Our people</p>
<section class="person-card"><span class="phone">303-555-0121</span> <h4><a href="/people/ira">Ira Novak</a></h4> <span class="email">ira@u.edu</span> <p class="title">Professor of Ice</p></section>
<section class="person-card"><h4><a href="/people/joel-pim">Joel Pim</a></h4> <p class="title">Curator</p></section>
<section class="person-card"><h4><a href="/people/kay">Kay Orr</a></h4> <span class="email">kay@u.edu</span></section>
<section class="person-card"><p class="title">Technician</p> <h4><a href="/people/lou-quist">Lou Quist</a></h4></section></main>
<footer><ul class="pagination"><li><a rel="next" href="?page=2">Onward</a></li><li><a href="?page=3">3</a></li><li><a href="?page=4">4</a></li></ul></footer></body>"""
URL = "https://u.edu/people"


def dom(spark, *pages, url=URL):
    return with_dom(spark.createDataFrame([(i, url, h) for i, h in enumerate(pages)], "id int, url string, html string"))


def test_cards_with_and_without_selector(spark):
    by_selector = listing.list_items(dom(spark, LIST), "id", selector=".person-card").orderBy("ord").collect()
    assert [r.ord for r in by_selector] == [0, 1, 2, 3] and "Ira Novak" in by_selector[0].text
    scored = listing.list_items(dom(spark, LIST), "id").orderBy("ord").collect()
    # person and card both match each of the four nodes
    assert [r.score for r in scored] == sorted((r.score for r in scored), reverse=True)
    assert len(scored) == 8 and scored[0].score == 10


def test_item_records(spark):
    rows = listing.item_records(dom(spark, LIST), "id", selector=".person-card", schema=PERSON).orderBy("ord").collect()
    assert rows[0].asDict() == {
        "id": 0, "ord": 0, "page_url": "https://u.edu/people/ira", "name": "Ira Novak",
        "email": "ira@u.edu", "phone": "303-555-0121", "title": "Professor of Ice", "bio": "",
        "org": "", "location": ""}
    odd = '<div class="card"><a href="/x">Some Person</a><img> a@b.org</div><div class="card">dr. no</div>'
    rows = listing.item_records(dom(spark, odd), "id").orderBy("ord").collect()
    assert [(r.page_url, r.name, r.email) for r in rows] == [("https://u.edu/x", "Some Person", "a@b.org"), ("", "", "")]


def test_detail_links(spark):
    links = listing.detail_links(dom(spark, LIST + '<a href="/people/joel-pim">again</a>'), "id").orderBy("ord").collect()
    assert [r.link for r in links] == [f"https://u.edu/people/{p}" for p in ("ira", "joel-pim", "kay", "lou-quist")]
    assert listing.detail_links(dom(spark, LIST), "id", selector="h4 a", limit=2).count() == 2
    assert page_links(dom(spark, LIST), "id").count() == 7


def strategy(spark, html, url=URL):
    return dom(spark, html, url=url).select(paging.pagination_strategy(Page(), F.col("url")).alias("s")).first().s


def test_strategies(spark):
    pager = '<nav class="pagination"><a href="?page=1">1</a><a href="?page=2"> 2 </a></nav>'
    assert strategy(spark, LIST) == "next_link"
    assert strategy(spark, pager) == "numbered"
    assert strategy(spark, pager.replace("pagination", "x")) == "none"
    assert strategy(spark, '<nav role="navigation"><a>1</a><a>2</a></nav>') == "numbered"
    assert strategy(spark, "<button>Load More</button>") == "infinite_scroll"
    assert strategy(spark, "<p>x</p>", "https://u.edu/?cursor=a") == "cursor"
    assert strategy(spark, "<p>x</p>", "https://u.edu/?cursor=") == "none"


def nexts(spark, html, url=URL, **k):
    if "seen" in k:
        k["seen"] = spark.createDataFrame([(s,) for s in k["seen"]], "seen_url string")
    return [r.next_url for r in paging.next_pages(dom(spark, html, url=url), "id", **k).orderBy("ord").collect()]


def test_next_pages(spark):
    assert nexts(spark, LIST) == [URL + "?page=2"]
    two = '<a rel="next" href="?page=2">x</a><a href="?page=3">Next Page</a><a href="?page=4">»</a>'
    assert nexts(spark, two, seen=[URL + "?page=2"]) == [URL + "?page=3"]
    pager = ('<div class="pager"><a href="/page/2">2</a><a href="/page/10">10</a><a href="/page/2">2</a>'
             '<a href="/PAGE/10">3</a><a href="/x">about</a><a href="/page/11">→</a></div>')
    assert nexts(spark, pager) == ["https://u.edu/PAGE/10", "https://u.edu/page/11", "https://u.edu/page/2"]
    assert nexts(spark, pager, max_pages=2) == ["https://u.edu/PAGE/10"]
    assert nexts(spark, pager, seen=["https://u.edu/page/10"]) == ["https://u.edu/page/11", "https://u.edu/page/2"]
    cursor = '<a href="?after=1">back</a><a href="?x=1">more</a><a href="?after=2">Load More</a>'
    assert nexts(spark, cursor, url="https://u.edu/l?after=0") == ["https://u.edu/l?after=2"]
    assert nexts(spark, "<button>Load More</button><a href='/n'>next</a>") == []


def test_numbered_urls(spark):
    df = spark.createDataFrame([("https://e.com/list?q=1",)], "u string")
    got = paging.numbered_urls(df, "u", 3).orderBy("page_num").collect()
    assert [r.next_url for r in got] == [f"https://e.com/list?q=1&page={i}" for i in (1, 2, 3)]
    seen = spark.createDataFrame([("https://e.com/list?q=1&page=2",)], "seen_url string")
    assert paging.numbered_urls(df, "u", 3, seen=seen).count() == 2


def test_hints(spark):
    table = spark.createDataFrame([(0, "eng.school.edu", "a"), (1, "school.edu", "b"), (2, "x.org", "c")],
                                  "ord int, domain string, sel string")
    targets = spark.createDataFrame([("school.edu",), ("www.x.org",), ("none.com",), (None,)], "target string")
    got = {r.target: r.hint and r.hint.sel for r in hints.hints_lookup(targets, table).collect()}
    assert got == {"school.edu": "a", "www.x.org": "c", "none.com": None, None: None}
    mine = [hints.SiteHints("u.edu", list_item_selector="h4", profile_link_selector="footer a")]
    assert listing.item_records(dom(spark, LIST), "id", hints=mine).count() == 4
    assert listing.detail_links(dom(spark, LIST), "id", hints=mine).count() == 3
    other = [hints.SiteHints("z.com", list_item_selector="h3")]
    assert listing.item_records(dom(spark, LIST), "id", hints=other).count() == 8


ROBOTS = """# c
User-agent: badbot
User-agent: worse
Disallow: /

User-agent: *
Allow: /private/open
Disallow: /private # no
Disallow: /a%20b
"""


@pytest.mark.parametrize("agent", ["*", "badbot/1.0", "Fine"])
def test_robots(spark, agent):
    paths = ["/", "", "/private/x", "/private/open/1", "/a b", "/ok?x=/private"]
    urls = spark.createDataFrame([("https://h.org" + p,) for p in paths] + [("https://free.org/private",)], "url string")
    stored = spark.createDataFrame([("h.org", ROBOTS)], "host string, robots_txt string")
    got = {r.url: r.allowed for r in robots.with_robots_allowed(urls, stored, agent).collect()}
    parser = urllib.robotparser.RobotFileParser()
    parser.parse(ROBOTS.splitlines())
    for p in paths:
        assert got["https://h.org" + p] == parser.can_fetch(agent, "https://h.org" + p), p
    assert got["https://free.org/private"]


ENTRIES = [
    "User-agent: crab\nDisallow: /a\n\nDisallow: /b\n",
    "User-agent: crab\n\nDisallow: /a\nUser-agent: *\nDisallow: /b",
    "User-agent: crab\nDisallow: /a\n\nUser-agent: crab\nDisallow: /b\n\nUser-agent: *\nDisallow: /c",
    "User-agent: *\nDisallow: /a\n\nUser-agent: *\nDisallow: /b",
    "User-agent: crab\nCrawl-delay: 5\nUser-agent: *\nDisallow: /b",
    "Disallow: /a\nUser-agent: eel\nUser-agent: crab\nAllow: /a/x\nDisallow: /a\nDisallow:\n \nDisallow: /b",
    "User-agent: crab # us\nno colon here\nSitemap: /s\nDisallow: *\n", "", "User-agent: crab",
    "User-agent: eel\nUser-agent: *\nDisallow: /b\r\n\r\nUser-agent: crab\nDisallow: /c",
]


@pytest.mark.parametrize("agent", ["crab/2.1", "*", "eel"])
def test_robots_entries(spark, agent):
    paths = ["/", "/a", "/a/x", "/b", "/c"]
    urls = spark.createDataFrame([(f"https://h{i}.org{p}",) for i in range(len(ENTRIES)) for p in paths], "url string")
    stored = spark.createDataFrame(
        [(f"h{i}.org", t, "2024-02-01") for i, t in enumerate(ENTRIES)] + [("h0.org", "User-agent: *\nDisallow: /", "2024-01-01"),
                                                                          ("h1.org", None, "2024-03-01")],
        "host string, robots_txt string, fetched_at string")
    got = {r.url: r.allowed for r in robots.with_robots_allowed(urls, stored, agent).collect()}
    for i, text in enumerate(ENTRIES):
        parser = urllib.robotparser.RobotFileParser()
        parser.parse(text.splitlines())
        for p in paths:
            assert got[f"https://h{i}.org{p}"] == parser.can_fetch(agent, f"https://h{i}.org{p}"), (i, p)


def test_robots_rules_rows(spark):
    stored = spark.createDataFrame([("h.org", ENTRIES[2])], "host string, robots_txt string")
    rows = robots.robots_rules(stored).orderBy("entry", "ord").collect()
    assert [(r.entry, r.agents, r.ord, r.allow, r.prefix) for r in rows] == [
        (0, ["crab"], 0, False, "/a"), (1, ["crab"], 0, False, "/b"), (2, ["*"], 0, False, "/c")]
