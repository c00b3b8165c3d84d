"""Pagination: which strategy a page uses and which pages come next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.functions.nodes import DOM_COLUMNS, Page, Scope, attr
from rosterline.functions.text import DIGITS_ONLY, let, py_strip
from rosterline.functions.urls import has_cursor_param, url_join, url_normalize, with_query_param
from rosterline.operators.extract import BLANK

# Strategies and the link texts that mean "next".
NEXT_LINK, NUMBERED, CURSOR, INFINITE_SCROLL, NONE = "next_link", "numbered", "cursor", "infinite_scroll", "none"
NEXT_TEXTS = ["next", "next page", "→", "»"]
PAGER_TEXTS = ["next", "→", "»"]
CURSOR_TEXTS = ["next", "more", "load more"]


def _label(page: Scope, node: Column) -> Column:
    return F.lower(py_strip(page.text_of(node)))


def _rel_next(page: Scope) -> Column:
    return page.first_of('a[rel="next"]', 'link[rel="next"]')


def _pager_links(page: Scope) -> Column:
    """Anchors of the pagination container; null without one."""
    box = page.first_of('[class*="pagination"]', '[class*="pager"]', 'nav[role="navigation"]')
    return let(box, lambda b: F.when(b.isNotNull(), page.within(b).select("a")))


def has_numbered(page: Scope) -> Column:
    numbers = F.filter(_pager_links(page), lambda n: _label(page, n).rlike(DIGITS_ONLY))
    return F.coalesce(F.size(numbers) >= 2, F.lit(False))


def has_load_more(page: Scope) -> Column:
    return page.first_of('[class*="load-more"]', 'button:contains("Load More")').isNotNull()


def pagination_strategy(page: Scope, start_url: Column) -> Column:
    return (
        F.when(_rel_next(page).isNotNull(), NEXT_LINK)
        .when(has_numbered(page), NUMBERED)
        .when(has_load_more(page), INFINITE_SCROLL)
        .when(has_cursor_param(start_url), CURSOR)
        .otherwise(NONE)
    )


def _hrefs(nodes: Column, keep) -> Column:
    linked = F.filter(nodes, lambda n: (attr(n, "href") != BLANK) & keep(n))
    return F.transform(linked, lambda n: attr(n, "href"))


def next_link_hrefs(page: Scope) -> Column:
    """rel=next first, then links whose text says next."""
    rel = F.filter(F.array(attr(_rel_next(page), "href")), lambda h: h != BLANK)
    return F.concat(rel, _hrefs(page.select("a"), lambda n: _label(page, n).isin(NEXT_TEXTS)))


def numbered_hrefs(page: Scope) -> Column:
    found = _hrefs(
        _pager_links(page), lambda n: _label(page, n).rlike(DIGITS_ONLY) | _label(page, n).isin(PAGER_TEXTS)
    )
    return F.coalesce(found, F.array().cast("array<string>"))


def cursor_hrefs(page: Scope) -> Column:
    return _hrefs(
        page.select("a"), lambda n: _label(page, n).isin(CURSOR_TEXTS) & has_cursor_param(attr(n, "href"))
    )


def candidate_hrefs(page: Scope, strategy: Column) -> Column:
    """Hrefs of possible next pages, in the order they would be taken; empty for other strategies."""
    return (
        F.when(strategy == NEXT_LINK, next_link_hrefs(page))
        .when(strategy == NUMBERED, numbered_hrefs(page))
        .when(strategy == CURSOR, cursor_hrefs(page))
        .otherwise(F.array().cast("array<string>"))
    )


def candidate_urls(hrefs: Column, start_url: Column, strategy: Column) -> Column:
    """Absolute candidates; numbered ones are distinct and sorted as text."""
    urls = F.transform(hrefs, lambda h: url_join(start_url, h))
    return F.when(strategy == NUMBERED, F.array_sort(F.array_distinct(urls))).otherwise(urls)


def next_pages(
    dom: DataFrame, *keys: str, start_url: str = "url", strategy: Column | None = None,
    seen: DataFrame | None = None, max_pages: int | None = None,
) -> DataFrame:
    """One row per page to visit next: keys, strategy, ord, next_url.

    ``keys`` must name a page. Links resolve against ``start_url``. ``seen`` holds
    normalized URLs (column ``seen_url``) that are out. next_link and cursor give
    the first unseen candidate, numbered all of them (at most ``max_pages - 1``).
    """
    page = Page()
    chosen = strategy if strategy is not None else pagination_strategy(page, F.col(start_url))
    planned = dom.select(*dict.fromkeys([*keys, start_url]), chosen.alias("strategy"), *DOM_COLUMNS)
    urls = candidate_urls(candidate_hrefs(page, F.col("strategy")), F.col(start_url), F.col("strategy"))
    entries = F.transform(
        urls,
        lambda u, i: F.struct(i.cast("bigint").alias("ord"), u.alias("next_url"), url_normalize(u).alias("seen_url")),
    )
    listed = planned.select(*keys, "strategy", entries.alias("found"))
    if seen is not None:
        unseen = listed.select(*keys, "strategy", F.inline("found")).join(seen.select("seen_url"), "seen_url", "left_anti")
        # Back to one row per page. A set, so that copies of a page fold into one pager before the shuffle.
        listed = unseen.groupBy(*keys, "strategy").agg(
            F.array_sort(F.collect_set(F.struct("ord", "next_url", "seen_url"))).alias("found")
        )
    found = F.col("found")
    many = F.slice(found, 1, max_pages - 1) if max_pages else found
    norms = F.transform(many, lambda e: e["seen_url"])
    distinct = F.filter(many, lambda e, i: F.array_position(norms, e["seen_url"]) == i + 1)
    taken = F.when(F.col("strategy") == NUMBERED, distinct).otherwise(F.slice(found, 1, 1))
    return listed.select(*keys, "strategy", F.inline(taken)).drop("seen_url")


def numbered_urls(
    starts: DataFrame, base: str, max_pages: int, param: str = "page", start_page: int = 1,
    seen: DataFrame | None = None,
) -> DataFrame:
    """Add page_num, next_url: ``max_pages`` generated page URLs per base URL."""
    pages = F.explode(F.sequence(F.lit(start_page), F.lit(start_page + max_pages - 1))).alias("page_num")
    made = starts.select("*", pages).withColumn("next_url", with_query_param(F.col(base), param, F.col("page_num")))
    if seen is None:
        return made
    return made.withColumn("seen_url", url_normalize("next_url")).join(
        seen.select("seen_url"), "seen_url", "left_anti"
    ).drop("seen_url")


def unseen_urls(candidates: DataFrame, seen: DataFrame, url: str = "url") -> DataFrame:
    """Candidates whose normalized URL is not in ``seen`` (column ``seen_url``)."""
    return candidates.withColumn("seen_url", url_normalize(url)).join(
        seen.select("seen_url"), "seen_url", "left_anti"
    ).drop("seen_url")
