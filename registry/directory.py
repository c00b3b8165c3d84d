"""A directory site rendered from customer and nation: list pages, profile pages, crawls.

Each nation is a site section. Its list page number p shows the customers whose key
falls in the p-th block of 250 and links to pages 2p and 2p+1. A crawl finds every tenth
profile missing. What a crawl must find follows from the tables, which gives the SQL.
"""

from pyspark.sql import functions as F

from registry import query, table
from rosterline.functions.nodes import Page, with_dom
from rosterline.operators import extract, hints, listing, paging, robots
from rosterline.operators.dedup import dedup_record_id
from rosterline.operators.schema import PERSON, Field, RecordSchema
from rosterline.plans import crawl as crawls
from rosterline.sources.pages import as_pages, spread

SITE = "https://dir.example.org"
BLOCK = 250

MEMBERS_SQL = """
    m AS (SELECT c_custkey AS id, c_nationkey AS n, n_name AS place, c_custkey // 250 + 1 AS p, c_mktsegment AS org,
            'https://dir.example.org/people/' || c_custkey AS url, replace(c_name, '#', ' ') AS name,
            'c' || c_custkey || '@mail.example.org' AS email,
            '555-010-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS phone, 'Professor of ' || c_mktsegment AS title,
            c_custkey % 10 <> 0 AS stored
          FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
BIO_SQL = "name || ' works in the ' || org || ' department of ' || place || ' and has done so for many years.'"
LISTS_SQL = """
    lists AS (SELECT DISTINCT n, place, p, 'https://dir.example.org/nation/' || n || '?page=' || p AS url FROM m)"""
DETAIL = f"WITH {MEMBERS_SQL}, d AS (SELECT *, {BIO_SQL} AS bio FROM m) "
LISTED = f"WITH {MEMBERS_SQL}, {LISTS_SQL} "


def members(spark, d):
    people = spread(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))
    places = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return people.join(places, "c_nationkey").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n"), F.col("n_name").alias("place"),
        (F.floor(F.col("c_custkey") / BLOCK) + 1).alias("p"), F.col("c_mktsegment").alias("org"),
        F.translate("c_name", "#", " ").alias("name"),
        F.concat(F.lit("c"), "c_custkey", F.lit("@mail.example.org")).alias("email"),
        F.concat(F.lit("555-010-"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")).alias("phone"),
        F.concat(F.lit("Professor of "), "c_mktsegment").alias("title"))


# Three layouts of a profile, by key. They differ in which rule of a ladder finds a value: item properties, then classes,
# then what is left (page metadata, short class names, opening paragraphs, a value after a colon).
BIO = "%1$s works in the %3$s department of %4$s and has done so for many years."
SHEET = (
    "<html><head><title>Staff sheet</title></head><body><article><h1>%1$s</h1>\n<dl>"
    '<dt>Post</dt> <dd itemprop="jobTitle">%2$s</dd>\n<dt>Unit</dt> <dd itemprop="affiliation">%3$s</dd>\n'
    '<dt>Seat</dt> <dd itemprop="address">%4$s</dd>\n<dt>Mail</dt> <dd><a href="mailto:%5$s?subject=hi">%5$s</a></dd>\n'
    '<dt class="cue">Call</dt> <dd><a href="tel:%6$s">%6$s</a></dd>\n</dl>'
    f'<blockquote itemprop="description">{BIO}</blockquote></article></body></html>')
GRID = (
    '<html><head><meta name="twitter:title" content="%1$s"></head><body><h2 class="full-name">%1$s</h2>\n<table>'
    '<tr><td>Post</td> <td class="position">%2$s</td></tr>\n<tr><td>Unit</td> <td class="organization">%3$s</td></tr>\n'
    '<tr><td>Seat</td> <td class="street-address">%4$s</td></tr>\n<tr><td>Mail</td> <td>%5$s</td></tr>\n'
    '<tr><td><i class="cue">Call</i></td> <td>%6$s</td></tr>\n</table>'
    f'<section class="about-me">{BIO}</section></body></html>')
NOTE = (
    '<html><head><meta property="og:title" content="%1$s"></head><body><main><em class="role-line">%2$s</em>\n'
    f'<p>{BIO}</p>\n'
    '<ol><li class="dept">%3$s</li> <li class="office">%4$s</li></ol>\n'
    '<ul><li>Mail</li> <li><a href="mailto:%5$s">%5$s</a></li></ul>\n'
    '<div><span class="cue">Call: %6$s</span></div></main></body></html>')


def detail_pages(spark, d):
    """url, html of every customer's profile."""
    sheet, grid, note = (
        F.format_string(layout, "name", "title", "org", "place", "email", "phone") for layout in (SHEET, GRID, NOTE))
    html = F.when(F.col("id") % 3 == 0, sheet).when(F.col("id") % 3 == 1, grid).otherwise(note)
    return members(spark, d).select(F.concat(F.lit(f"{SITE}/people/"), "id").alias("url"), html.alias("html"))


def fetched_details(spark, d):
    """Profiles a crawl can meet: links to keys that end in 0 are dead."""
    return detail_pages(spark, d).where("url NOT LIKE '%0'")


def list_pages(spark, d):
    """url, html of every list page; a page holds at most one block of customers."""
    card = F.format_string(
        '<div class="person-card"><h3><a href="/people/%1$s">%2$s</a></h3> <p class="title">%3$s</p> '
        '<p class="email">%4$s</p> <p class="phone">%5$s</p></div>', "id", "name", "title", "email", "phone")
    # By number, so that pages stay spread: they are small to store but not to parse.
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pages = members(spark, d).repartition(width, "n", "place", "p").groupBy("n", "place", "p").agg(
        F.array_sort(F.collect_list(F.struct("id", card.alias("card")))).alias("cards"))
    html = F.concat(
        F.format_string("<html><head><title>%1$s</title></head><body><h1>People of %1$s</h1><div class='listing'>", "place"),
        F.array_join(F.transform("cards", lambda c: c["card"]), "\n"),
        F.format_string(
            "</div><nav class='pagination'><a href='/nation/%1$s?page=%2$s'>%2$s</a> "
            "<a href='/nation/%1$s?page=%3$s'>%3$s</a></nav></body></html>",
            "n", F.col("p") * 2, F.col("p") * 2 + 1))
    return pages.select(
        F.concat(F.lit(f"{SITE}/nation/"), "n", F.lit("?page="), "p").alias("url"), html.alias("html"))


def site(spark, d):
    return list_pages(spark, d).unionByName(fetched_details(spark, d))


def starts(spark, d):
    return table(spark, d, "nation").select(
        F.concat(F.lit(f"{SITE}/nation/"), "n_nationkey", F.lit("?page=1")).alias("start_url"))


def details(spark, d):
    return with_dom(detail_pages(spark, d))


def lists(spark, d):
    return with_dom(list_pages(spark, d))


# --- detail pages ----------------------------------------------------------------------------


def _field(key, out, build, value_sql):
    @query(key, f"{DETAIL} SELECT url, {value_sql} AS {out} FROM d")
    def run(spark, d):
        return details(spark, d).select("url", build(Page()).alias(out))


_field("resolve_email", "email", extract.resolve_email, "email")
_field("resolve_phone", "phone", extract.resolve_phone, "phone")
_field("resolve_title", "title", lambda p: extract.resolve_title(p, extract.resolve_name(p)), "title")
_field("resolve_bio", "bio", extract.resolve_bio, "bio")
_field("resolve_org", "org", extract.resolve_org, "org")
_field("resolve_location", "location", extract.resolve_location, "place")
_field("generic_email", "email", extract.generic_email, "email")
_field("generic_phone", "phone", extract.generic_phone, "phone")
_field("generic_name", "name", extract.generic_name, "name")
_field("generic_title", "title", extract.generic_title, "title")
_field("generic_bio", "bio", extract.generic_bio, "bio")
# The generic ladders don't know the class names "dept" and "office".
_field("generic_org", "org", extract.generic_org, "CASE WHEN id % 3 = 2 THEN '' ELSE org END")
_field("generic_location", "location", extract.generic_location, "CASE WHEN id % 3 = 2 THEN '' ELSE place END")
_field("extract_field", "phone", lambda p: extract.extract_field(p, Field("phone", "str?", synonyms=("call",))), "phone")
_field("extract_by_label", "mail", lambda p: extract.extract_by_label(p, ["e-mail", "mail"]), "email")
_field("value_near_label", "phone",
       lambda p: extract.value_near_label(p, p.first(".cue"), F.lit("Call")), "phone")

RECORD = "url AS page_url, name, email, phone, title, bio, org, place AS location"


@query("resolve_all_fields", f"{DETAIL} SELECT {RECORD} FROM d")
def resolve_all_fields(spark, d):
    return extract.resolve_all_fields(details(spark, d))


@query("extract_by_schema", f"""{DETAIL} SELECT url AS page_url, name, email AS mail, phone, bio,
    CASE WHEN id % 3 = 2 THEN '' ELSE org END AS organization, '' AS fax FROM d""")
def extract_by_schema(spark, d):
    schema = RecordSchema.of({"fields": [
        {"name": "name", "type": "str"}, {"name": "mail", "type": "email?"}, {"name": "phone", "type": "str?"},
        {"name": "bio", "type": "str?"}, {"name": "organization", "type": "str?"}, {"name": "fax", "type": "str?"}]})
    return extract.extract_by_schema(details(spark, d), schema, synonyms={"phone": ["call"]})


@query("detail_page_step", f"""{DETAIL} SELECT {RECORD}, substr(sha256(url), 1, 16) AS record_id,
    'heuristic' AS extraction_method, 0.9::DOUBLE AS confidence FROM d""")
def detail_page_step(spark, d):
    records = extract.resolve_all_fields(details(spark, d), F.col("url").alias("source_url")).withColumns({
        "extraction_method": F.lit("heuristic"), "confidence": F.lit(crawls.DETAIL_CONFIDENCE)})
    return dedup_record_id(records, ["source_url"]).drop("source_url")


# --- list pages ------------------------------------------------------------------------------


@query("list_items_selector", f"""{LISTED} SELECT lists.url, row_number() OVER (PARTITION BY m.n, m.p ORDER BY id) - 1
    AS ord, name || ' ' || title || ' ' || email || ' ' || phone AS text FROM m JOIN lists USING (n, p)""")
def list_items_selector(spark, d):
    return listing.list_items(lists(spark, d), "url", selector="div.person-card").select("url", "ord", "text")


@query("list_items_scored", f"""{LISTED}, c AS (SELECT lists.url, id, selector, name || ' ' || title || ' ' || email
        || ' ' || phone AS text FROM m JOIN lists USING (n, p), (SELECT unnest([0, 1]) AS selector))
    SELECT url, row_number() OVER (PARTITION BY url ORDER BY selector, id) - 1 AS ord, 10 AS score, text FROM c""")
def list_items_scored(spark, d):
    return listing.list_items(lists(spark, d), "url").select("url", "ord", "score", "text")


ITEM_SQL = "m.url AS page_url, name, email, phone, title"


@query("item_record", f"""{LISTED} SELECT lists.url AS list_url, {ITEM_SQL}, '' AS bio, '' AS org, '' AS location
    FROM m JOIN lists USING (n, p)""")
def item_record(spark, d):
    records = listing.item_records(lists(spark, d), "url", selector=".person-card", schema=PERSON)
    return records.withColumnRenamed("url", "list_url").drop("ord")


@query("hint_selectors", f"""{LISTED} SELECT lists.url AS list_url, {ITEM_SQL} FROM m JOIN lists USING (n, p)""")
def hint_selectors(spark, d):
    site_hints = [hints.SiteHints("other.com", list_item_selector="li"),
                  hints.SiteHints("example.org", list_item_selector="div.listing .person-card")]
    records = listing.item_records(lists(spark, d), "url", hints=site_hints)
    return records.withColumnRenamed("url", "list_url").drop("ord")


@query("detail_links", f"""{LISTED} SELECT lists.url, row_number() OVER (PARTITION BY m.n, m.p ORDER BY id) - 1 AS ord,
    m.url AS link FROM m JOIN lists USING (n, p)""")
def detail_links(spark, d):
    return listing.detail_links(lists(spark, d), "url")


@query("list_page_step", f"""{LISTED}
    SELECT 'record' AS kind, lists.url AS list_url, m.url AS url, name, email, phone, title, substr(sha256(m.url), 1, 16) AS record_id,
        0.8::DOUBLE AS confidence FROM m JOIN lists USING (n, p)
    UNION ALL SELECT 'detail', lists.url, m.url, NULL, NULL, NULL, NULL, NULL, NULL FROM m JOIN lists USING (n, p)
    UNION ALL SELECT 'next', url, 'https://dir.example.org/nation/' || n || '?page=' || (2 * p + k), NULL, NULL, NULL, NULL, NULL, NULL
        FROM lists, (SELECT unnest([0, 1]) AS k)""")
def list_page_step(spark, d):
    return crawls.list_page_step(lists(spark, d).withColumn("list_url", F.col("url")), "list_url").drop("ord")


# --- pagination ------------------------------------------------------------------------------


@query("pagination_strategy", f"{LISTED} SELECT url, 'numbered' AS strategy FROM lists")
def pagination_strategy(spark, d):
    return lists(spark, d).select("url", paging.pagination_strategy(Page(), F.col("url")).alias("strategy"))


@query("has_numbered", f"{LISTED} SELECT url, true AS numbered FROM lists")
def has_numbered(spark, d):
    return lists(spark, d).select("url", paging.has_numbered(Page()).alias("numbered"))


NEXT_SQL = """SELECT url, 'https://dir.example.org/nation/' || n || '?page=' || (2 * p + k) AS next_url
    FROM lists, (SELECT unnest([0, 1]) AS k)"""


@query("next_pages", f"{LISTED}, nx AS ({NEXT_SQL}) SELECT url, 'numbered' AS strategy, next_url FROM nx")
def next_pages(spark, d):
    return paging.next_pages(lists(spark, d), "url").drop("ord")


@query("numbered_links", f"""{LISTED}, nx AS ({NEXT_SQL}) SELECT url, next_url FROM nx
    QUALIFY row_number() OVER (PARTITION BY url ORDER BY next_url) <= 1""")
def numbered_links(spark, d):
    return paging.next_pages(lists(spark, d), "url", strategy=F.lit(paging.NUMBERED), max_pages=2).select("url", "next_url")


def _with_pager(spark, d, pager):
    pages = list_pages(spark, d).withColumn("html", F.concat("html", F.lit(pager)))
    return with_dom(pages)


@query("next_link", f"""{LISTED} SELECT url, 'https://dir.example.org/nation/' || n || '?page=next' AS next_url FROM lists""")
def next_link(spark, d):
    dom = _with_pager(spark, d, '<a href="?page=next">Next Page</a> <a href="?page=later" rel="next">x</a>')
    seen = list_pages(spark, d).select(F.regexp_replace("url", r"page=\d+$", "page=later").alias("seen_url")).distinct()
    return paging.next_pages(dom, "url", seen=seen).select("url", "next_url")


@query("cursor_link", f"""{LISTED} SELECT url, 'https://dir.example.org/nation/' || n || '?after=9' AS next_url FROM lists""")
def cursor_link(spark, d):
    dom = _with_pager(spark, d, '<a href="?after=8">back</a><a href="?page=8">more</a><a href="?after=9"> Load More</a>')
    return paging.next_pages(dom, "url", strategy=F.lit(paging.CURSOR)).select("url", "next_url")


@query("numbered_urls", """
    SELECT page_id, k AS page_num, regexp_extract(url, '^([^?#]*)', 1) || '?' || CASE
        WHEN url LIKE '%?page=2&ref=x%' THEN 'page=' || k || '&ref=x'
        WHEN url LIKE '%?utm_source=feed%' THEN 'utm_source=feed&page=' || k ELSE 'page=' || k END AS next_url
    FROM pages, (SELECT unnest([1, 2, 3]) AS k)""")
def numbered_urls(spark, d):
    return paging.numbered_urls(table(spark, d, "pages").select("page_id", "url"), "url", 3).select(
        "page_id", "page_num", "next_url")


@query("seen_urls", f"{LISTED}, nx AS ({NEXT_SQL}) SELECT next_url FROM nx WHERE next_url NOT IN (SELECT url FROM lists)")
def seen_urls(spark, d):
    found = paging.next_pages(lists(spark, d), "url").select("next_url")
    return paging.unseen_urls(found, list_pages(spark, d).select(F.col("url").alias("seen_url")), "next_url")


# Pagers of all kinds, by the list page's number: rel=next, numbers, a load-more button, a link by cursor, none.
PAGERS = (
    "CASE WHEN p % 5 = 0 THEN concat('<a rel=\"next\" href=\"/go?page=', p, '\">on</a>') WHEN p % 5 = 1 THEN concat('<div class=\"pager\"><a href=\"/go?page=', p, "
    "'\"> 1 </a><a href=\"/go?page=2\">2</a></div>') WHEN p % 5 = 2 THEN '<button class=\"load-more\">Load More</button>' "
    "WHEN p % 5 = 3 THEN concat('<a href=\"/go?cursor=c', p, '\">More</a>') ELSE '<p>the end</p>' END")
KINDS_SQL = """k AS (SELECT c_custkey AS p, CASE WHEN c_custkey % 5 = 3 THEN 'https://dir.example.org/list?cursor=a' ELSE 'https://dir.example.org/list' END
    || CASE WHEN c_custkey % 5 = 3 THEN '&' ELSE '?' END || 'k=' || c_custkey AS url FROM customer)"""


def pager_pages(spark, d):
    """A list page per customer with one of five pagers."""
    start = F.when(F.col("p") % 5 == 3, f"{SITE}/list?cursor=a&k=").otherwise(f"{SITE}/list?k=")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("p")).select(
        F.concat(start, "p").alias("url"), F.concat(F.lit("<html><body>"), F.expr(PAGERS), F.lit("</body></html>")).alias("html"))


@query("pager_kinds", f"""WITH {KINDS_SQL}
    SELECT url, CASE p % 5 WHEN 0 THEN 'next_link' WHEN 1 THEN 'numbered' WHEN 2 THEN 'infinite_scroll' WHEN 3 THEN 'cursor' ELSE 'none' END AS strategy,
        p % 5 = 1 AS numbered FROM k""")
def pager_kinds(spark, d):
    return with_dom(pager_pages(spark, d)).select(
        "url", paging.pagination_strategy(Page(), F.col("url")).alias("strategy"), paging.has_numbered(Page()).alias("numbered"))


@query("pager_steps", f"""WITH {KINDS_SQL}
    SELECT DISTINCT url, strategy, 'https://dir.example.org/go?' || q AS next_url FROM (
        SELECT url, 'next_link' AS strategy, 'page=' || p AS q FROM k WHERE p % 5 = 0
        UNION ALL SELECT url, 'numbered', 'page=' || unnest([p, 2]) FROM k WHERE p % 5 = 1
        UNION ALL SELECT url, 'cursor', 'cursor=c' || p FROM k WHERE p % 5 = 3)""")
def pager_steps(spark, d):
    return paging.next_pages(with_dom(pager_pages(spark, d)), "url").drop("ord")


# --- crawls ----------------------------------------------------------------------------------

REACH_SQL = f"""
    WITH RECURSIVE {MEMBERS_SQL}, {LISTS_SQL},
    reach(n, p, level) AS (SELECT n, p, 0 FROM lists WHERE p = 1 UNION ALL
        SELECT l.n, l.p, r.level + 1 FROM reach r JOIN lists l ON l.n = r.n AND l.p // 2 = r.p AND l.p > 1),
    crawl AS (SELECT n, 'https://dir.example.org/nation/' || n || '?page=1' AS crawl_id FROM (SELECT DISTINCT n FROM lists)),
    listed AS (SELECT r.n, m.*, r.level FROM m JOIN reach r ON m.n = r.n AND m.p = r.p)"""
VISITED_SQL = """visited AS (
        SELECT n, 'https://dir.example.org/nation/' || n || '?page=' || p AS url, 0 AS depth, level FROM reach
        UNION ALL SELECT n, url, 1, level + 1 FROM listed WHERE stored)"""


@query("crawl_replay", f"""{REACH_SQL}, {VISITED_SQL}
    SELECT crawl_id, url, depth, level FROM visited JOIN crawl USING (n)""")
def crawl_replay(spark, d):
    run = crawls.crawl_replay(site(spark, d), starts(spark, d))
    return run.visited.select("crawl_id", "url", "depth", "level")


def chain_site(spark, d):
    """Three sections of list pages of five people each; every page names only the next, so a chain grows with the tables."""
    card = F.format_string('<div class="person-card"><h3><a href="/people/%1$s">%2$s</a></h3> <p class="title">%3$s</p></div>', "id", "name", "title")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    people = members(spark, d).select(F.floor(F.col("id") / 5).alias("block"), "id", card.alias("card"))
    pages = people.repartition(width, "block").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("id", "card"))).alias("cards"))
    section, number = F.col("block") % 3, F.floor(F.col("block") / 3)
    html = F.concat(F.lit("<html><body><div class='listing'>"), F.array_join(F.transform("cards", lambda c: c["card"]), "\n"),
                    F.format_string("</div><a rel='next' href='/section/%1$s?page=%2$s'>Next</a></body></html>", section, number + 1))
    lists_ = pages.select(F.format_string(f"{SITE}/section/%1$s?page=%2$s", section, number).alias("url"), html.alias("html"))
    return lists_.unionByName(fetched_details(spark, d))


@query("crawl_chain", f"""WITH RECURSIVE {MEMBERS_SQL},
    c AS (SELECT *, (id // 5) % 3 AS s, id // 15 AS q FROM m), pages AS (SELECT DISTINCT s, q FROM c),
    reach(s, q) AS (SELECT s, q FROM pages WHERE q = 0 UNION ALL SELECT r.s, p.q FROM reach r JOIN pages p ON p.s = r.s AND p.q = r.q + 1),
    visited AS (SELECT s, 'https://dir.example.org/section/' || s || '?page=' || q AS url, 0 AS depth, q AS level FROM reach
        UNION ALL SELECT s, url, 1, q + 1 FROM c JOIN reach USING (s, q) WHERE stored)
    SELECT 'https://dir.example.org/section/' || s || '?page=0' AS crawl_id, url, depth, level::INT AS level FROM visited""")
def crawl_chain(spark, d):
    begun = spark.range(3).select(F.format_string(f"{SITE}/section/%s?page=0", "id").alias("start_url"))
    return crawls.crawl_replay(chain_site(spark, d), begun).visited.select("crawl_id", "url", "depth", "level")


@query("crawl_limits", f"""{REACH_SQL},
    queue AS (SELECT n, url, 0 AS level, 0 AS kind, 0 AS ord FROM lists WHERE p = 1
        UNION ALL SELECT n, url, 1, 0, id FROM m WHERE p = 1 AND stored
        UNION ALL SELECT n, url, 1, 1, p FROM lists WHERE p IN (2, 3))
    SELECT crawl_id, url FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY level, kind, ord) AS k FROM queue)
    JOIN crawl USING (n) WHERE k <= 4""")
def crawl_limits(spark, d):
    run = crawls.crawl_replay(site(spark, d), starts(spark, d), crawls.CrawlOptions(max_pages=4))
    return run.visited.select("crawl_id", "url")


@query("crawl_output", f"""{REACH_SQL} SELECT crawl_id, url AS page_url, name, email, phone, title, '' AS bio, '' AS org,
    0.8::DOUBLE AS confidence FROM listed JOIN crawl USING (n)""")
def crawl_output(spark, d):
    run = crawls.crawl_replay(site(spark, d), starts(spark, d))
    return crawls.crawl_output(crawls.crawl_records(run)).select(
        "crawl_id", "page_url", "name", "email", "phone", "title", "bio", "org", "confidence")


@query("run_stats", f"""{REACH_SQL}, {VISITED_SQL},
    broken AS (SELECT n, count(*) AS k FROM listed WHERE NOT stored GROUP BY n
        UNION ALL SELECT r.n, count(*) FROM reach r, (SELECT unnest([0, 1]) AS k) q
        WHERE NOT EXISTS (SELECT 1 FROM lists l WHERE l.n = r.n AND l.p = 2 * r.p + q.k) GROUP BY r.n),
    begun AS (SELECT n_nationkey AS n, 'https://dir.example.org/nation/' || n_nationkey || '?page=1' AS crawl_id FROM nation)
    SELECT crawl_id, (SELECT count(*) FROM visited v WHERE v.n = begun.n) AS pages_fetched,
        CASE WHEN n IN (SELECT n FROM reach) THEN (SELECT coalesce(sum(k), 0)::BIGINT FROM broken b WHERE b.n = begun.n)
            ELSE 1 END AS pages_failed,
        (SELECT count(*) FROM listed l WHERE l.n = begun.n) AS records_extracted,
        (SELECT count(*) FROM listed l WHERE l.n = begun.n) AS records_valid FROM begun""")
def run_stats(spark, d):
    run = crawls.crawl_replay(site(spark, d), starts(spark, d))
    records = crawls.crawl_records(run)
    return crawls.run_stats(run, records, crawls.crawl_output(records)).drop("start_url", "error")


@query("frontier_pages", f"WITH {MEMBERS_SQL} SELECT url, stored AS found FROM m")
def frontier_pages(spark, d):
    frontier = members(spark, d).select(F.concat(F.lit(f"{SITE}/people/"), "id").alias("url"))
    stored = as_pages(fetched_details(spark, d)).select("task_id", "status")
    keyed = frontier.withColumn("task_id", crawls.task_id("url"))
    return crawls.join_frontier(keyed, stored).select("url", F.col("status").isNotNull().alias("found"))


# --- robots and hints ------------------------------------------------------------------------

ROBOTS = ("concat('User-agent: helper\\nUser-agent: other\\nDisallow: /en/\\n\\nUser-agent: *\\nAllow: /de/1\\nDisallow: /de/\\n',"
          " CASE WHEN host LIKE '%.org' THEN 'Disallow: /fr/ # closed' ELSE '' END)")
HOST_SQL = "SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, " \
           "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages"


def _robots(spark, d):
    hosts = table(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host")).distinct()
    return hosts.where("host NOT LIKE '%.net'").withColumn("robots_txt", F.expr(ROBOTS))


@query("robots_filter", f"""WITH h AS ({HOST_SQL}) SELECT page_id, url FROM h WHERE host LIKE '%.net'
    OR NOT ((path LIKE '/de/%' AND path NOT LIKE '/de/1%') OR (host LIKE '%.org' AND path LIKE '/fr/%'))""")
def robots_filter(spark, d):
    return robots.robots_filter(table(spark, d, "pages").select("page_id", "url"), _robots(spark, d))


@query("robots_rules", f"""WITH h AS ({HOST_SQL})
    SELECT page_id, host LIKE '%.net' OR path NOT LIKE '/en/%' AS allowed FROM h""")
def robots_rules(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    return robots.with_robots_allowed(pages, _robots(spark, d), "Helper/2.0").select("page_id", "allowed")


SETTINGS = [(0, "blog.ththan.example.net", "a"), (1, "example.org", "b"), (2, "blog.", "c"), (3, "www.", "d")]


@query("hints_lookup", f"""WITH h AS ({HOST_SQL}),
    s AS (SELECT * FROM (VALUES (0, 'blog.ththan.example.net', 'a'), (1, 'example.org', 'b'), (2, 'blog.', 'c'),
        (3, 'www.', 'd')) t(ord, domain, selector))
    SELECT page_id, (SELECT arg_min(selector, ord) FROM s WHERE contains(host, domain) OR contains(domain, host))
    AS selector FROM h""")
def hints_lookup(spark, d):
    targets = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("target"))
    settings = spark.createDataFrame(SETTINGS, "ord int, domain string, selector string")
    return hints.hints_lookup(targets, settings).select("page_id", F.col("hint.selector").alias("selector"))
