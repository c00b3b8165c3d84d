"""List pages: person cards, the record of a card, links to detail pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.functions.nodes import Page, Scope, attr
from rosterline.functions.text import first_email, first_phone, let
from rosterline.functions.urls import url_join
from rosterline.operators.extract import BLANK, between, ladder
from rosterline.operators.hints import SiteHints, hinted
from rosterline.operators.schema import RecordSchema

# Card selectors in the order they are tried, and what a card scores by.
CARD_SELECTORS = [
    '[class*="person"]', '[class*="profile"]', '[class*="member"]', '[class*="card"]', '[class*="item"]',
    "article", '[itemtype*="Person"]',
]
ACADEMIC_WORDS = ["phd", "dr.", "professor", "research"]
JOB_WORDS = [
    "professor", "researcher", "engineer", "scientist", "manager", "director", "phd", "dr.", "assistant", "associate",
]
MIN_SCORE = 2
CARD_LINK = r"(?i)/(people|person|profile|faculty)/"
DETAIL_LINK = r"(?i)/(people|person|profile|faculty|staff|member)/"


def _any_word(words: list[str]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def card_score(page: Scope, card: Column) -> Column:
    """How person-like a node is."""
    def points(condition: Column, value: int) -> Column:
        return F.when(condition, value).otherwise(0)

    def of_text(text: Column) -> Column:
        return (
            points(text.rlike(_any_word(ACADEMIC_WORDS)), 2)
            + points(text.contains("@"), 3)
            + points(text.rlike(r"\p{Nd}{3}[-.]?\p{Nd}{3}[-.]?\p{Nd}{4}"), 2)
        )

    def of_nodes(nodes: Column) -> Column:
        return (
            points(F.exists(nodes, lambda n: n["tag"] == "img"), 1)
            + points(F.exists(nodes, lambda n: (n["tag"] == "a") & attr(n, "href").rlike("/profile|/people")), 3)
        )

    return let(F.lower(page.text_of(card)), of_text) + let(page.within(card).nodes, of_nodes)


def _once(ids: Column, value: Callable[[Column], Column], each: Callable[[Column, Column], Column]) -> Column:
    """``each(position, value(id))`` of every id, whose value is worked out once however often it is listed."""
    def looked_up(known: Column) -> Column:
        return let(F.transform(known, value), lambda values: F.transform(
            ids, lambda k, i: each(i, F.get(values, (F.array_position(known, k) - 1).cast("int")))))

    return let(F.array_distinct(ids), looked_up)


def scored_cards(page: Scope) -> Column:
    """array<struct<score,id>>: nodes that look like person cards, best first.

    A node several selectors match is listed once per selector.
    """

    def matches(position: int, selector: str) -> Column:
        return F.transform(
            page.select(selector), lambda n: F.struct(F.lit(position).alias("selector"), n["id"].alias("id")))

    def scores(found: Column) -> Column:
        return _once(
            F.transform(found, lambda c: c["id"]), lambda k: card_score(page, F.get(page.page_nodes, k)),
            lambda i, score: F.struct((-score).alias("order"), F.get(found, i)["selector"].alias("selector"), F.get(found, i)["id"].alias("id")))

    scored = let(F.flatten(F.array(*[matches(i, s) for i, s in enumerate(CARD_SELECTORS)])), scores)
    kept = F.array_sort(F.filter(scored, lambda c: c["order"] <= -MIN_SCORE))
    return F.transform(kept, lambda c: F.struct((-c["order"]).alias("score"), c["id"].alias("id")))


def selected_cards(page: Scope, selector: str) -> Column:
    """Same shape as :func:`scored_cards` for a known selector, in document order."""
    return F.transform(page.select(selector), lambda n: F.struct(F.lit(None).cast("int").alias("score"), n["id"]))


def cards(page: Scope, selector: str | None = None, hints: list[SiteHints] | None = None,
          url: Column | None = None) -> Column:
    if selector:
        return selected_cards(page, selector)
    return hinted(
        hints, url, lambda h: h.list_item_selector, lambda s: selected_cards(page, s), scored_cards(page)
    )


def card_record(page: Scope, card: Column) -> Column:
    """struct(href, name, email, phone, title) of one card; ``href`` is still relative."""
    text = page.text_of(card)

    def of_nodes(nodes: Column) -> Column:
        inside = Scope(page.text, nodes, page.page_nodes)
        anchors = inside.select("a")
        person = F.get(F.filter(anchors, lambda n: attr(n, "href").rlike(CARD_LINK)), F.lit(0))
        href = F.coalesce(attr_or_null(person, "href"), attr_or_null(F.get(anchors, F.lit(0)), "href"), F.lit(BLANK))
        name = ladder(*[
            inside.when_text(s, between(5, 100)) for s in ("h1", "h2", "h3", "h4", "a", '[class*="name"]')
        ])

        def with_name(name: Column) -> Column:
            lines = F.transform(inside.nodes, page.clean_text_of)
            job = F.filter(
                lines,
                lambda t: (t != BLANK) & (t != name) & (F.length(t) < 200) & F.lower(t).rlike(_any_word(JOB_WORDS)),
            )
            return F.struct(
                href.alias("href"), name.alias("name"), first_email(text).alias("email"), first_phone(text).alias("phone"),
                F.coalesce(F.get(job, F.lit(0)), F.lit(BLANK)).alias("title"),
            )

        return let(name, with_name)

    return let(page.within(card).nodes, of_nodes)


def attr_or_null(node: Column, name: str) -> Column:
    return F.nullif(attr(node, name), F.lit(BLANK))


def card_records(page: Scope, found: Column) -> Column:
    """array of :func:`card_record` for an array of cards."""
    return let(found, lambda cards: _once(
        F.transform(cards, lambda c: c["id"]), lambda k: card_record(page, F.get(page.page_nodes, k)), lambda i, record: record))


def detail_hrefs(page: Scope, selector: str | None = None, hints: list[SiteHints] | None = None,
                 url: Column | None = None) -> Column:
    """Non-empty hrefs of links to detail pages, in document order, still relative."""

    def hrefs(nodes: Column, keep) -> Column:
        return F.filter(F.transform(nodes, lambda n: attr(n, "href")), keep)

    def by_selector(s: str) -> Column:
        return hrefs(page.select(s), lambda h: h != BLANK)

    if selector:
        return by_selector(selector)
    by_path = hrefs(page.select("a"), lambda h: h.rlike(DETAIL_LINK))
    return hinted(hints, url, lambda h: h.profile_link_selector, by_selector, by_path)


def absolute(hrefs: Column, base: Column) -> Column:
    """Distinct absolute URLs in first-seen order."""
    return F.array_distinct(F.transform(hrefs, lambda h: url_join(base, h)))


def list_items(dom: DataFrame, *keys: str, selector: str | None = None) -> DataFrame:
    """One row per card: keys, ord, node_id, score, text."""
    page = Page()
    found = F.transform(
        cards(page, selector),
        lambda c, i: F.struct(
            i.cast("bigint").alias("ord"), c["id"].alias("node_id"), c["score"].alias("score"),
            page.clean_text_of(F.get(page.page_nodes, c["id"])).alias("text"),
        ),
    )
    return dom.select(*keys, F.inline(found))


def item_records(
    dom: DataFrame, *keys: str, url: str = "url", selector: str | None = None,
    hints: list[SiteHints] | None = None, schema: RecordSchema | None = None,
) -> DataFrame:
    """One record per card: keys, ord, page_url, name, email, phone, title, and blank schema fields.

    Records are built inside the page row and only then exploded, so the tree is never copied per card.
    """
    page = Page()
    found = dom.withColumn("_cards", cards(page, selector, hints, F.col(url)))
    rows = found.select(*dict.fromkeys([*keys, url]), F.posexplode(card_records(page, F.col("_cards"))).alias("ord", "_r"))
    record = rows.select(
        *[F.col(k) for k in keys], F.col("ord").cast("bigint").alias("ord"),
        F.when(F.col("_r.href") != BLANK, url_join(F.col(url), F.col("_r.href"))).otherwise(BLANK).alias("page_url"),
        *[F.col(f"_r.{c}").alias(c) for c in ("name", "email", "phone", "title")],
    )
    blanks = [n for n in (schema.names if schema else []) if n not in record.columns]
    return record.withColumns({n: F.lit(BLANK) for n in blanks})


def detail_links(
    dom: DataFrame, *keys: str, url: str = "url", selector: str | None = None,
    hints: list[SiteHints] | None = None, limit: int | None = None,
) -> DataFrame:
    """One row per distinct detail link of a page: keys, ord, link."""
    links = absolute(detail_hrefs(Page(), selector, hints, F.col(url)), F.col(url))
    if limit:
        links = F.slice(links, 1, limit)
    return dom.select(*keys, F.posexplode(links).alias("ord", "link")).withColumn("ord", F.col("ord").cast("bigint"))
