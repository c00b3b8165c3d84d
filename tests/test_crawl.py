"""Crawl replay against a small sequential model of the same walk."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from rosterline.functions.nodes import with_dom
from rosterline.operators.hints import SiteHints
from rosterline.plans import crawl as C
from rosterline.session import BucketedTable
from rosterline.sources.runlog import event_rows

BASE = "https://u.edu"


def card(slug, name):
    return (f'<div class="person-card"><h3><a href="/people/{slug}">{name}</a></h3> <p class="email">{slug}@u.edu</p>'
            f"</div>")


def lister(cards, pager):
    return f"<html><body>{''.join(card(*c) for c in cards)}<nav class='pagination'>{pager}</nav></body></html>"


def numbers(*pages):
    return " ".join(f'<a href="/people?page={p}">{p}</a>' for p in pages)


def profile(name):
    return f"<html><body><h1>{name}</h1><p class='title'>Professor</p></body></html>"


PAGES = {
    f"{BASE}/people": lister([("amy", "Amy Adams"), ("bob", "Bob Brown"), ("gone", "Gone Girl")], numbers(1, 2, 3)),
    f"{BASE}/people?page=2": lister([("cat", "Cat Clark"), ("amy", "Amy Adams"), ("gone", "Gone Girl")],
                                    '<a rel="next" href="/people?page=3">Next</a> <a href="/people?page=4">»</a>'),
    f"{BASE}/people?page=3": lister([("dan", "Dan Drake")],
                                    '<a rel="next" href="/people?page=4">Next</a> <a href="/people?page=5">»</a>'),
    f"{BASE}/people?page=4": lister([("eve", "Eve Evans")], ""),
    f"{BASE}/people?page=5": lister([("fay", "Fay Fuchs")], ""),
    **{f"{BASE}/people/{n}": profile(n.title() + " Detail") for n in ("amy", "bob", "cat", "dan", "eve", "fay")},
}


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(list(PAGES.items()), "url string, html string")


def starts(spark, *urls):
    return spark.createDataFrame([(u,) for u in urls or (f"{BASE}/people",)], "start_url string")


def walk(crawl):
    return [r.url.removeprefix(BASE) for r in crawl.visited.orderBy("level", "rank").collect()]


def test_whole_walk(spark, pages):
    run = C.crawl_replay(pages, starts(spark))
    # Page 1 is queued again under its numbered URL, which is not stored. Pages 2 and 3 are contested at their
    # level: page 2 takes "»" (page 4) because page 3 is seen, which leaves page 5 to page 3.
    assert walk(run) == ["/people", "/people/amy", "/people/bob", "/people?page=2", "/people?page=3", "/people/cat",
                         "/people?page=4", "/people/dan", "/people?page=5", "/people/eve", "/people/fay"]
    records = C.crawl_records(run)
    output = C.crawl_output(records)
    assert [r.name for r in output.orderBy(*C.ORDER).collect()] == [
        "Amy Adams", "Bob Brown", "Gone Girl", "Cat Clark", "Dan Drake", "Eve Evans", "Fay Fuchs"]
    stats = C.run_stats(run, records, output).first()
    assert (stats.pages_fetched, stats.pages_failed, stats.records_extracted, stats.records_valid) == (11, 3, 7, 7)
    events = C.page_events(run)
    assert events.count() == 11 and '"status":200' in events.first().meta_json
    # A second run that is given the log has nothing left to fetch.
    again = C.crawl_replay(pages, starts(spark), done=events)
    assert again.visited.count() == 0


def test_budget_prefer_and_two_crawls(spark, pages):
    run = C.crawl_replay(pages, starts(spark, f"{BASE}/people", f"{BASE}/people?page=3"),
                         C.CrawlOptions(max_pages=4, prefer="confidence"))
    by = lambda c: [u.removeprefix(BASE) for u in (
        r.url for r in run.visited.where(F.col("crawl_id") == c).orderBy("level", "rank").collect())]
    assert by(f"{BASE}/people") == ["/people", "/people/amy", "/people/bob", "/people?page=2"]
    assert by(f"{BASE}/people?page=3") == ["/people?page=3", "/people/dan", "/people?page=4", "/people/eve"]
    records = C.crawl_records(run)
    names = {r.name for r in records.where(F.col("crawl_id") == f"{BASE}/people").collect()}
    assert {"Amy Detail", "Bob Detail", "Gone Girl"} <= names and "Amy Adams" not in names
    stats = {r.start_url: r.pages_failed for r in C.run_stats(run, records, C.crawl_output(records)).collect()}
    # "gone" and the stored-nowhere page 1 come before page 2, the last page the budget allows.
    assert stats == {f"{BASE}/people": 2, f"{BASE}/people?page=3": 0}


def test_hints_fill_and_robots(spark, pages):
    options = C.CrawlOptions(
        hints=[SiteHints("u.edu", list_item_selector="h3", profile_link_selector="h3 a", pagination_strategy="none")],
        fill=lambda records: records.withColumn("org", F.lit("Filled")))
    stored = spark.createDataFrame([("u.edu", "User-agent: *\nDisallow: /private")], "host string, robots_txt string")
    run = C.crawl_replay(pages, starts(spark, f"{BASE}/people", f"{BASE}/private/x"), options, robots=stored)
    assert walk(run) == ["/people", "/people/amy", "/people/bob"]
    records = C.crawl_records(run)
    stats = {r.start_url: (r.pages_fetched, r.error) for r in C.run_stats(run, records, records).collect()}
    assert stats == {f"{BASE}/people": (3, None), f"{BASE}/private/x": (0, "Disallowed by robots.txt")}
    details = C.detail_page_records(run.visited, run.facts, options.fill).collect()
    assert {r.org for r in details} == {"Filled"} and {r.extraction_method for r in details} == {"hybrid"}


def test_long_chain_many_links_and_versions(spark):
    many = [(f"p{i}", f"Person Number{i}") for i in range(70)]
    chain = {f"{BASE}/people?page={i}": lister([], f'<a rel="next" href="/people?page={i + 1}">Next</a>') for i in range(2, 7)}
    stored = [(f"{BASE}/people", lister(many, '<a rel="next" href="/people?page=2">Next</a>'), None, None)]
    stored += [(u, h, 200, "2024-01-02") for u, h in chain.items()]
    stored += [(f"{BASE}/people/p0", profile("Old Name"), 200, "2024-01-01"), (f"{BASE}/people/p0", profile("New Name"), 200, "2024-01-03"),
               (f"{BASE}/people/p0", "moved", 404, "2024-01-02"), (f"{BASE}/people/p1", profile("Was There"), 200, "2024-01-01"),
               (f"{BASE}/people/p1", "gone", 404, "2024-01-02"), (f"{BASE}/people/p69", profile("Last One"), 200, None)]
    pages = spark.createDataFrame(stored, "url string, html string, status int, fetched_at string")
    run = C.crawl_replay(pages, starts(spark))
    urls = walk(run)
    assert [u for u in urls if "people/" not in u] == ["/people"] + [f"/people?page={i}" for i in range(2, 7)]
    assert [u for u in urls if "people/" in u] == ["/people/p0", "/people/p69"]
    names = {r.name for r in C.detail_page_records(run.visited, run.facts).collect()}
    assert names == {"New Name", "Last One"}
    stats = C.run_stats(run, C.crawl_records(run), C.crawl_records(run)).first()
    assert (stats.pages_fetched, stats.pages_failed) == (8, 69)  # 68 profiles and the page after the last


def chain_of(n, start=1):
    """A start page and ``n`` - 1 further ones, each with one person and a link to the next."""
    url = lambda k: f"{BASE}/people" if k == start else f"{BASE}/people?page={k}"
    return [(url(k), lister([(f"p{k}", f"Person Number{k}")], f'<a rel="next" href="/people?page={k + 1}">Next</a>' if k < start + n - 1 else ""))
            for k in range(start, start + n)]


def jobs_of(spark, run):
    group = f"crawl {uuid.uuid4()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_chain_takes_rounds_by_its_logarithm(spark):
    jobs = {}
    for n in (8, 128):
        stored = chain_of(n) + [(f"{BASE}/people/p{k}", profile(f"Person {k}")) for k in range(1, n + 1, 2)]
        crawl, jobs[n] = jobs_of(spark, lambda: C.crawl_replay(spark.createDataFrame(stored, "url string, html string"), starts(spark)))
        rows = [(r.level, r.depth, r.url.removeprefix(BASE)) for r in crawl.visited.orderBy("level", "rank").collect()]
        lists = [(k, 0, "/people" if k == 0 else f"/people?page={k + 1}") for k in range(n)]
        details = [(k, 1, f"/people/p{k}") for k in range(1, n + 1, 2)]
        assert rows == sorted(lists + details, key=lambda r: (r[0], -r[1]))
        assert sum(r.pages_failed for r in crawl.failed.collect()) == n // 2
    # 16 times the pages: four doublings more, each a handful of jobs.
    assert jobs[128] - jobs[8] <= 4 * 16


def model(pages, start, done=()):
    """The walk page by page: (level, depth, url) in order and the number of failed fetches."""
    queue, seen, visited, out, failed = [(start, 0, 0)], set(), set(done), [], 0
    while queue:
        url, depth, level = queue.pop(0)
        if url in visited:
            continue
        if url not in pages:
            failed += 1
            continue
        visited.add(url)
        out.append((level, depth, url))
        if depth == 0:
            details, nexts = pages[url]
            queue += [(d, 1, level + 1) for d in details]
            for n in nexts:
                if n not in seen:
                    seen.add(n)
                    queue.append((n, 0, level + 1))
                    break
    return out, failed


@pytest.mark.parametrize("seed", range(4))
def test_chains_of_any_shape_are_walked_page_by_page(spark, seed):
    """Loops, further candidates, detail links to list pages, dead ends, several crawls and a log of done pages."""
    rng = random.Random(seed)
    sites, crawls, log = {}, [], []
    for site in range(4):
        base = f"https://s{site}.edu"
        url = lambda k, base=base: f"{base}/people/{k}"
        for k in range(24):
            if rng.random() < 0.06:
                continue
            nexts = [url(k + 1)] if rng.random() < 0.9 else [url(rng.randrange(26))]
            nexts += [url(rng.randrange(26)) for _ in range(rng.choice([0, 0, 1, 2]))]
            details = list(dict.fromkeys(url(rng.choice([rng.randrange(26), 100 + rng.randrange(9), 100 + k])) for _ in range(rng.choice([0, 1, 2]))))
            sites[url(k)] = (details, nexts)
        sites.update({url(100 + k): ([], []) for k in range(0, 24, 2)})
        crawls += [url(0), url(5)]
        log += [(url(5), url(rng.randrange(24)))]
    html = {u: "<html><body>" + "".join(f'<div class="person-card"><h3><a href="{d}">Some Person</a></h3></div>' for d in ds)
            + (f'<p><a rel="next" href="{ns[0]}">on</a>' + " ".join(f'<a href="{n}">next</a>' for n in ns[1:]) + "</p>" if ns else "") + "</body></html>"
            for u, (ds, ns) in sites.items()}
    pages = spark.createDataFrame(list(html.items()), "url string, html string")
    done = event_rows(spark.createDataFrame(log, "crawl_id string, url string"), F.col("crawl_id"), F.lit("page_fetched"), C.task_id("url"))
    options = C.CrawlOptions(hints=[SiteHints(".edu", profile_link_selector="h3 a")])
    run = C.crawl_replay(pages, starts(spark, *crawls), options, done=done)
    got = {c: [] for c in crawls}
    for r in run.visited.orderBy("level", "rank").collect():
        got[r.crawl_id].append((r.level, r.depth, r.url))
    failed = {r.crawl_id: 0 for r in run.failed.collect()}
    for r in run.failed.collect():
        failed[r.crawl_id] += r.pages_failed
    for c in crawls:
        want, lost = model(sites, c, [u for d, u in log if d == c])
        assert got[c] == want
        assert failed.get(c, 0) == lost


def test_visited_pages_stay_in_their_buckets(spark, pages):
    table = BucketedTable(spark, "crawl_id", "task_id")
    rows = spark.range(1000).selectExpr("cast(id % 7 as string) AS crawl_id", "sha2(cast(id as string), 256) AS task_id", "id")
    table.append(rows.where("id < 600"))
    table.append(rows.where("id >= 600"))
    todo = spark.range(500, 1500).selectExpr("cast(id % 7 as string) AS crawl_id", "sha2(cast(id as string), 256) AS task_id").distinct()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = todo.join(table.frame.select("crawl_id", "task_id"), ["crawl_id", "task_id"], "left_anti")
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert left.count() == 500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # One exchange: the frontier's own, which its distinct needs anyway.
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    assert table.close().count() == 1000


def test_list_page_step(spark):
    two = lister([("amy", "Amy Adams"), ("bob", "Bob Brown")], numbers(2, 3, 2))
    pages = [(f"{BASE}/people", two, "a"), (f"{BASE}/people?page=2", lister([("amy", "Amy Adams")], '<a rel="next" href="?page=3">x</a>'), "b")]
    dom = with_dom(spark.createDataFrame(pages, "url string, html string, tag string"))
    rows = sorted((r.tag, r.kind, r.ord, r.url.removeprefix(BASE), r.name, r.confidence) for r in C.list_page_step(dom, "tag").collect())
    assert rows == sorted([
        ("a", "record", 0, "/people/amy", "Amy Adams", 0.8), ("a", "record", 1, "/people/bob", "Bob Brown", 0.8), ("a", "detail", 0, "/people/amy", None, None),
        ("a", "detail", 1, "/people/bob", None, None), ("a", "next", 0, "/people?page=2", None, None), ("a", "next", 1, "/people?page=3", None, None),
        ("b", "detail", 0, "/people/amy", None, None), ("b", "next", 0, "/people?page=3", None, None)])
    assert C.list_page_step(dom, "tag", detail_limit=1).where("kind = 'detail'").count() == 2
