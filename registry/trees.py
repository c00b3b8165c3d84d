"""The page tree over the whole pages table."""

from pyspark.sql import functions as F

from registry import query, table
from registry.scalars import STRICT_SQL, clean_sql
from rosterline.functions.nodes import Page, attr, page_links, with_dom
from rosterline.operators import extract
from rosterline.sources.pages import scan_pages, spread


def decoded(expression: str) -> str:
    """Entities of the pages, the ampersand last."""
    for entity, char in (("&copy;", "©"), ("&middot;", "·")):
        expression = f"replace({expression}, '{entity}', '{char}')"
    return f"regexp_replace(regexp_replace({expression}, '&quot;?', '\"', 'g'), '&amp;?', '&', 'g')"


def dom(spark, d):
    return with_dom(spread(table(spark, d, "pages")))


def count_of(pattern: str) -> str:
    return f"len(regexp_extract_all(html, '{pattern}'))::BIGINT"


@query("scan_pages", f"""
    SELECT sha256({STRICT_SQL}) AS task_id, url, length(html)::BIGINT AS n_chars, 200 AS status FROM (
        SELECT *, lower(url) AS u FROM pages)""")
def scan(spark, d):
    return scan_pages(spark, f"{d}/pages.parquet").select(
        "task_id", "url", F.length("html").cast("bigint").alias("n_chars"), "status")


@query("page_dom", f"""
    SELECT page_id, {count_of('<p>')} AS paragraphs, {count_of('<a ')} AS anchors, {count_of('<b>')} AS bolds,
        {count_of('<li>')} AS items, {count_of('<br>')} AS breaks FROM pages""")
def page_dom(spark, d):
    def tags(tag):
        return F.size(F.filter("dom_nodes", lambda n: n["tag"] == tag)).cast("bigint")

    return dom(spark, d).select("page_id", *[tags(t).alias(n) for t, n in (
        ("p", "paragraphs"), ("a", "anchors"), ("b", "bolds"), ("li", "items"), ("br", "breaks"))])


@query("select_nodes", f"""
    SELECT page_id, {count_of('<li><a ')} AS menu_links, regexp_extract(html, '<div class="ad">([^<]*)</div>', 1) AS ad,
        {count_of('<div class="ad">')} AS ads, ({count_of('<h1>')} + {count_of('<footer>')}) AS heads_and_feet FROM pages""")
def select_nodes(spark, d):
    page = Page()

    def count(selector):
        return F.size(page.select(selector)).cast("bigint")

    return dom(spark, d).select(
        "page_id", count("nav li a").alias("menu_links"), F.coalesce(page.text_of(page.first("div.ad")), F.lit("")).alias("ad"),
        count('[class*="ad"]').alias("ads"), count("h1, footer").alias("heads_and_feet"))


H1_SQL = decoded("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")


@query("node_text", f"SELECT page_id, {H1_SQL} AS heading FROM pages")
def node_text(spark, d):
    page = Page()
    return dom(spark, d).select("page_id", page.text_of(page.first("h1")).alias("heading"))


@query("node_attr", """
    SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
        regexp_extract(html, '<meta charset="([^"]*)"', 1) AS charset, '' AS absent FROM pages""")
def node_attr(spark, d):
    page = Page()
    return dom(spark, d).select(
        "page_id", attr(page.first("html"), "lang").alias("lang"), attr(page.first("meta"), "charset").alias("charset"),
        attr(page.first("a"), "rel").alias("absent"))


@query("page_links", f"""
    WITH l AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hrefs,
        regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS texts FROM pages),
    u AS (SELECT page_id, unnest(hrefs) AS href, unnest(texts) AS t, unnest(range(len(hrefs))) AS ord FROM l)
    SELECT page_id, ord::BIGINT AS ord, {decoded('t')} AS text, {decoded('href')} AS href FROM u""")
def links(spark, d):
    return page_links(dom(spark, d), "page_id")


@query("resolve_name", f"""
    WITH h AS (SELECT page_id, {clean_sql(H1_SQL)} AS h FROM pages)
    SELECT page_id, CASE WHEN length(h) > 3 AND length(h) < 100 THEN h ELSE '' END AS name FROM h""")
def resolve_name(spark, d):
    return dom(spark, d).select("page_id", extract.resolve_name(Page()).alias("name"))


@query("resolve_page_url", "SELECT page_id, url AS page_url FROM pages")
def resolve_page_url(spark, d):
    return dom(spark, d).select("page_id", extract.resolve_page_url(Page(), F.col("url")).alias("page_url"))
