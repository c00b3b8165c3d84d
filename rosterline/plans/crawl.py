"""Replaying crawls over stored pages.

All crawls advance together, one level of the link graph per step. A page is parsed
once, into a compact row of facts bucketed by task id, so each level reads the link
columns once and shuffles nothing but the frontier; visited pages and seen URLs are tables
bucketed by the keys they are met on, which grow by appends and stay where they are. Order
within a level is an id from a parallel sort; no crawl is gathered in one task, whatever its
share of the pages. Chains of pages with one next page each are walked by pointer doubling.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.functions.nodes import Page, with_dom
from rosterline.functions.urls import has_cursor_param, task_id, url_is_person, url_join, url_normalize
from rosterline.operators import listing, paging
from rosterline.operators.dedup import dedup_by_keys, dedup_record_id, with_record_id
from rosterline.operators.extract import BLANK, resolve_all_fields
from rosterline.operators.hints import SiteHints, hinted
from rosterline.operators.ranking import top_k, with_global_rank, with_order_id
from rosterline.operators.robots import with_robots_allowed
from rosterline.plans import chains
from rosterline.session import BucketedTable, materialize, store_bucketed
from rosterline.sources.pages import as_pages
from rosterline.sources.runlog import event_rows, skip_done

LIST_CONFIDENCE, DETAIL_CONFIDENCE = 0.8, 0.9
FIELDS = ["page_url", "name", "email", "phone", "title", "bio", "org", "location"]
OUTPUT_KEYS = ["page_url", "name"]
ORDER = ["level", "rank", "item"]
# What a level needs of its list pages.
LINKS = ["detail_hrefs", "strategy", "next_hrefs", "numbered_hrefs", "cursor_hrefs"]
VISITED = ["crawl_id", "task_id", "start_url", "url", "parent_url", "depth", "rank", "status", "level"]
# Levels kept as separate checkpoints before they are merged into one.
MERGE_EVERY = 8


@dataclass(frozen=True)
class CrawlOptions:
    max_pages: int | None = None
    force: bool = False
    detail_limit: int | None = None
    hints: list[SiteHints] = field(default_factory=list)
    user_agent: str = "*"
    prefer: str | None = None
    fill: Callable[[DataFrame], DataFrame] | None = None


@dataclass(frozen=True)
class Crawl:
    """visited: pages in order; failed: failed fetches per crawl; facts: parsed pages; starts: with ``allowed``."""

    visited: DataFrame
    failed: DataFrame
    facts: DataFrame
    starts: DataFrame
    options: CrawlOptions


def page_facts(pages: DataFrame, hints: list[SiteHints] | None = None) -> DataFrame:
    """One compact row per task id: cards, links, pager candidates and detail fields; URLs still relative."""
    page, url = Page(), F.col("url")
    # An error page is a failed fetch: it isn't parsed, but as the latest version of its URL it wins.
    dom = with_dom(as_pages(pages).withColumn("html", F.when(F.col("status") < 400, F.col("html")).otherwise(BLANK)))
    structural = (
        F.when(paging._rel_next(page).isNotNull(), paging.NEXT_LINK)
        .when(paging.has_numbered(page), paging.NUMBERED)
        .when(paging.has_load_more(page), paging.INFINITE_SCROLL)
    )
    links = dom.withColumns({
        "_cards": listing.cards(page, hints=hints, url=url),
        "detail_hrefs": listing.detail_hrefs(page, hints=hints, url=url),
        "strategy": hinted(hints, url, lambda h: h.pagination_strategy, F.lit, structural),
        "next_hrefs": paging.next_link_hrefs(page),
        "numbered_hrefs": paging.numbered_hrefs(page),
        "cursor_hrefs": paging.cursor_hrefs(page),
    }).withColumn("cards", listing.card_records(page, F.col("_cards")))
    kept = ["task_id", "url", "status", "fetched_at", "cards", *LINKS]
    # An empty page URL marks "the page's own", which is known only once it is visited.
    facts = resolve_all_fields(links.withColumn("_own", F.lit(BLANK)), *kept, url="_own")
    packed = facts.select(*kept, F.struct(*FIELDS).alias("detail"))
    # Of several stored versions of a URL the latest is kept; without times one by content, whatever their order.
    latest = [F.col("fetched_at").desc_nulls_last(), "url",
              F.xxhash64("cards", "detail", "detail_hrefs", "next_hrefs", "numbered_hrefs", "cursor_hrefs")]
    return top_k(packed, ["task_id"], latest, 1).where("status < 400").drop("fetched_at")


def join_frontier(frontier: DataFrame, facts: DataFrame, how: str = "left") -> DataFrame:
    """Frontier rows with the facts of their page; unmatched ones are failed fetches."""
    return frontier.join(facts, "task_id", how)


class _Growing:
    """A union of checkpointed parts, merged now and then so that plans stay small."""

    def __init__(self) -> None:
        self.parts: list[DataFrame] = []

    def add(self, part: DataFrame) -> None:
        self.parts.append(part)
        if len(self.parts) > MERGE_EVERY:
            self.parts = [materialize(self.frame)]

    @property
    def frame(self) -> DataFrame:
        merged = self.parts[0]
        for part in self.parts[1:]:
            merged = merged.unionByName(part)
        return merged


def _one_per_task(tasks: DataFrame, force: bool) -> DataFrame:
    """The earliest attempt per crawl and task with the number of attempts; every attempt under ``force``."""
    if force:
        return tasks.withColumn("n", F.lit(1).cast("bigint"))
    rest = F.struct("start_url", "url", "parent_url", "depth", "rank", "level")
    return tasks.groupBy("crawl_id", "task_id").agg(
        F.min_by(rest, F.struct("level", "rank")).alias("_t"), F.count("*").alias("n")
    ).select("crawl_id", "task_id", "_t.*", "n")


def _attempted(todo: DataFrame, facts: DataFrame) -> DataFrame:
    """Tasks with their page's status (null: a failed fetch) and, for list pages, its links."""
    met = join_frontier(todo, facts.select("task_id", "status", *LINKS))
    return met.withColumns({c: F.when(F.col("depth") == 0, F.col(c)) for c in LINKS})


def _fetched(visited: BucketedTable, starts: DataFrame) -> DataFrame:
    if visited.frame is None:
        return starts.select("crawl_id", F.lit(0).cast("bigint").alias("fetched"))
    return visited.frame.groupBy("crawl_id").agg(F.count("*").alias("fetched"))


def _within_budget(found: DataFrame, fetched: DataFrame, max_pages: int) -> tuple[DataFrame, DataFrame]:
    """Pages that fit each crawl's budget, and the rank at which a crawl that used it up stops."""
    ranked = with_global_rank(found, ["crawl_id", "rank"], "_g")
    first = ranked.groupBy("crawl_id").agg(F.min("_g").alias("_first"))
    room = first.join(fetched, "crawl_id", "left").select(
        "crawl_id", "_first", (F.lit(max_pages) - F.coalesce("fetched", F.lit(0))).alias("_room")
    )
    placed = ranked.join(room, "crawl_id").withColumn("_i", F.col("_g") - F.col("_first"))
    kept = materialize(placed.where(F.col("_i") < F.col("_room")))
    stops = kept.where(F.col("_i") == F.col("_room") - 1).select("crawl_id", F.col("rank").alias("stop"))
    return kept.drop("_g", "_first", "_room", "_i"), stops


def _claims(candidates: DataFrame, contested: bool) -> DataFrame:
    """Who gets which next page when pages of one level want the same.

    Pages come in rank order: a numbered page takes all its candidates, any other its
    first free one. Losers move on to their next candidate until nobody loses. At the
    first level a crawl has one page, so nothing is contested.
    """
    page = ["crawl_id", "parent_rank"]
    open_ = candidates
    while True:
        firsts = top_k(open_.where(~F.col("many")), page, ["ord"], 1)
        wanted = firsts.unionByName(open_.where("many"))
        winners = top_k(wanted, ["crawl_id", "seen_url"], ["parent_rank", "ord"], 1)
        if not contested:
            return winners
        lost = firsts.select(*page, "ord").join(winners.select(*page, "ord"), [*page, "ord"], "left_anti")
        if lost.isEmpty():
            return winners
        open_ = materialize(open_.join(lost, [*page, "ord"], "left_anti"))


def _level_columns(options: CrawlOptions) -> dict[str, Column]:
    """The expressions every level uses, built once per replay."""
    def details_of(page_url: Column) -> Column:
        urls = listing.absolute(F.col("detail_hrefs"), page_url)
        return urls if options.detail_limit is None else F.slice(urls, 1, options.detail_limit)

    details = details_of(F.col("url"))
    hrefs = (
        F.when(F.col("used") == paging.NEXT_LINK, F.col("next_hrefs"))
        .when(F.col("used") == paging.NUMBERED, F.col("numbered_hrefs"))
        .when(F.col("used") == paging.CURSOR, F.col("cursor_hrefs"))
    )
    return {
        "details": F.posexplode(details).alias("ord", "next_url"),
        "detail_urls": details_of(F.col("parent_url")),
        "used": F.coalesce(
            F.col("strategy"), F.when(has_cursor_param("start_url"), paging.CURSOR).otherwise(paging.NONE)),
        "nexts": F.posexplode(paging.candidate_urls(hrefs, F.col("start_url"), F.col("used"))).alias("ord", "next_url"),
        "is_person": url_is_person("next_url"),
        "seen_url": url_normalize("next_url"),
        "task_id": task_id("next_url"),
    }


def _next_tasks(lists: DataFrame, seen: BucketedTable, columns: dict[str, Column], contested: bool) -> DataFrame:
    """What a level of list pages queues, in order of (crawl_id, parent_rank, kind, ord): a row per page with its detail
    links, then its next pages. ``_queued`` makes tasks of them."""
    parent = ["crawl_id", "start_url", "level", F.col("url").alias("parent_url"), F.col("rank").alias("parent_rank")]
    details = lists.where(F.size("detail_hrefs") > 0).select(*parent, "detail_hrefs").withColumns({
        "kind": F.lit(0), "ord": F.lit(0), "depth": F.lit(1), "next_url": F.lit(None).cast("string"), "seen_url": F.lit(None).cast("string")})
    candidates = lists.withColumn("used", columns["used"]).select(
        *parent, (F.col("used") == paging.NUMBERED).alias("many"), columns["nexts"],
    ).withColumn("seen_url", columns["seen_url"])
    if seen.frame is not None:
        candidates = candidates.join(seen.frame, ["crawl_id", "seen_url"], "left_anti")
    candidates = materialize(candidates)
    contested = contested and not candidates.where("not many").isEmpty()
    nexts = _claims(candidates, contested).drop("many").withColumns({
        "kind": F.lit(1), "depth": F.lit(0), "detail_hrefs": F.lit(None).cast("array<string>")})
    return details.unionByName(nexts)


def _queued(ordered: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """A row per link of a page's details, in their order, and per next page; links that lead to no person are left out."""
    links = F.when(F.col("kind") == 0, F.filter(columns["detail_urls"], url_is_person)).otherwise(F.array("next_url"))
    return ordered.select(
        "crawl_id", "start_url", "level", "parent_url", "kind", "depth", "seen_url", F.explode(links).alias("next_url"))


def _chain_heads(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """The list pages that are their crawl's only one in the frontier, and from which the first two edges lead on."""
    alone = frontier.where("depth = 0").groupBy("crawl_id").agg(F.count("*").alias("n")).where("n = 1").select("crawl_id")
    second = edges.select("task_id", "next_task").join(edges.select(F.col("task_id").alias("next_task")), "next_task").select("task_id")
    return frontier.where("depth = 0").join(alone, "crawl_id", "left_semi").join(second, "task_id", "left_semi").select(*frontier.columns)


@dataclass(frozen=True)
class _Walked:
    """Pages of chains up to the last that is safe (``tails``, which the frontier goes on with), and their detail links."""

    heads: DataFrame
    pages: DataFrame
    tails: DataFrame
    details: DataFrame


def _walk_chains(frontier: DataFrame, facts: DataFrame, jumps: chains.Jumps, visited: BucketedTable, seen: BucketedTable,
                 done: DataFrame | None, columns: dict[str, Column], force: bool) -> _Walked | None:
    """Follow the chains of a frontier as far as a walk page by page would take the same pages.

    A chain ends before the first page that is taken otherwise, or not at all: one whose edge a crawl resolves differently,
    one that was seen, visited or done, one that is also a task of this frontier or a detail link of an earlier page.
    The last page before that goes back to the frontier, where all its candidates are tried.
    """
    heads = materialize(_chain_heads(frontier, jumps.edges))
    if heads.isEmpty():
        return None
    rows = materialize(chains.with_seen_url(chains.walk(heads, jumps)))
    later = rows.where("at > 0")
    stops = [chains.broken_edges(rows, jumps.edges), chains.repeated(later, "seen_url")]
    first = heads.select("crawl_id", url_normalize("url").alias("seen_url"), F.col("level").alias("base"), F.col("rank").alias("base_rank"), "parent_url")
    stops.append(later.join(first.where("parent_url is not null"), ["crawl_id", "seen_url"], "left_semi").select("crawl_id", "at"))
    if seen.frame is not None:
        stops.append(later.join(seen.frame, ["crawl_id", "seen_url"], "left_semi").select("crawl_id", "at"))
    pages = facts.select("task_id", "status", "detail_hrefs")
    found = rows.join(pages, "task_id")
    details = found.select("crawl_id", "start_url", "at", F.col("url").alias("parent_url"), "url", "detail_hrefs").select(
        "crawl_id", "start_url", "at", "parent_url", columns["details"]).where(columns["is_person"])
    details = materialize(details.withColumn("task_id", columns["task_id"]))
    if not force:
        stops.append(chains.repeated(rows, "task_id"))
        if visited.frame is not None:
            stops.append(rows.join(visited.frame.select("crawl_id", "task_id"), ["crawl_id", "task_id"], "left_semi").select("crawl_id", "at"))
        if done is not None:
            open_ = skip_done(rows, done, "crawl_id", "task_id").select("crawl_id", "at")
            stops.append(rows.select("crawl_id", "at").join(open_, ["crawl_id", "at"], "left_anti"))
        others = frontier.join(heads.select("crawl_id"), "crawl_id", "left_semi").where("depth > 0").select("crawl_id", "task_id")
        stops.append(rows.join(others, ["crawl_id", "task_id"], "left_semi").select("crawl_id", "at"))
        linked = details.groupBy("crawl_id", "task_id").agg(F.min("at").alias("from_at"))
        stops.append(rows.join(linked, ["crawl_id", "task_id"]).where("at > from_at").select("crawl_id", "at"))
    ends = stops[0]
    for part in stops[1:]:
        ends = ends.unionByName(part)
    ends = ends.groupBy("crawl_id").agg(F.min("at").alias("end")).where("end > 1")
    ends = materialize(ends.join(first.select("crawl_id", "base", "base_rank"), "crawl_id"))
    if ends.isEmpty():
        return None
    before = rows.select("crawl_id", (F.col("at") + 1).alias("at"), F.col("url").alias("before_url"))
    placed = rows.join(ends, "crawl_id").where("at < end").join(before, ["crawl_id", "at"], "left").join(
        heads.select("crawl_id", F.col("parent_url").alias("head_parent")), "crawl_id")
    placed = placed.select(
        "crawl_id", "start_url", "url", "task_id", F.coalesce("before_url", "head_parent").alias("parent_url"), F.lit(0).alias("depth"),
        F.when(F.col("at") == 0, F.col("base_rank")).otherwise(chains.AFTER_DETAILS).cast("bigint").alias("rank"),
        (F.col("base") + F.col("at")).cast("int").alias("level"), "seen_url", "at", "end")
    placed = materialize(placed)
    inner = placed.where("at < end - 1")
    links = details.join(ends, "crawl_id").where("at < end - 1").select(
        "crawl_id", "start_url", F.col("next_url").alias("url"), "task_id", "parent_url", F.lit(1).alias("depth"), F.col("ord").cast("bigint").alias("rank"),
        (F.col("base") + F.col("at") + 1).cast("int").alias("level"))
    return _Walked(heads.join(ends.select("crawl_id"), "crawl_id", "left_semi"), inner, placed.where("at = end - 1"), links)


def crawl_replay(
    pages: DataFrame, starts: DataFrame, options: CrawlOptions | None = None, done: DataFrame | None = None,
    robots: DataFrame | None = None,
) -> Crawl:
    """Walk the stored pages from every row of ``starts`` (start_url[, crawl_id]).

    ``pages`` holds url, html; ``done`` is an event log whose keys are skipped; ``robots``
    stored robots texts that starts must pass. Pages link to details (never expanded) and
    to further list pages. All list pages of a step are expanded together; a page that is its crawl's only one
    is followed along its whole chain at once, except under ``max_pages``, which is met page by page.
    """
    options = options or CrawlOptions()
    spark = pages.sparkSession
    if "crawl_id" not in starts.columns:
        starts = starts.withColumn("crawl_id", F.col("start_url"))
    starts = starts.select("crawl_id", "start_url")
    if robots is not None:
        starts = with_robots_allowed(starts, robots, options.user_agent, "start_url")
    else:
        starts = starts.withColumn("allowed", F.lit(True))
    starts = materialize(starts)
    facts = store_bucketed(page_facts(pages, options.hints), "task_id")
    edges = materialize(chains.chain_edges(facts))
    jumps = None if options.max_pages or edges.isEmpty() else chains.Jumps(edges)
    frontier = starts.where("allowed").select(
        "crawl_id", "start_url", F.col("start_url").alias("url"), task_id("start_url").alias("task_id"),
        F.lit(None).cast("string").alias("parent_url"), F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("rank"), F.lit(0).alias("level"),
    )
    columns = _level_columns(options)
    visited, seen, failed = BucketedTable(spark, "crawl_id", "task_id"), BucketedTable(spark, "crawl_id", "seen_url"), _Growing()

    def unvisited(tasks: DataFrame) -> DataFrame:
        if done is not None:
            tasks = skip_done(tasks, done, "crawl_id", "task_id", options.force)
        if not options.force and visited.frame is not None:
            tasks = tasks.join(visited.frame.select("crawl_id", "task_id"), ["crawl_id", "task_id"], "left_anti")
        return tasks

    first = True
    while True:
        walked = jumps and _walk_chains(frontier, facts, jumps, visited, seen, done, columns, options.force)
        if walked:
            head = walked.heads.select("crawl_id", F.lit(0).alias("depth"))
            frontier = frontier.join(head, ["crawl_id", "depth"], "left_anti").select(*frontier.columns)
        # A link on every page is one row per crawl from here on.
        todo = unvisited(_one_per_task(frontier, options.force))
        attempted = materialize(_attempted(todo, facts))
        found, missing = attempted.where("status is not null").drop("n"), attempted.where("status is null")
        stops = None
        if options.max_pages:
            found, stops = _within_budget(found, _fetched(visited, starts), options.max_pages)
            # Only attempts before a crawl's last page happened; their rows are still in the frontier.
            before = frontier.join(stops, "crawl_id", "left").where(
                F.col("stop").isNull() | (F.col("rank") < F.col("stop")))
            lacking = missing.select("crawl_id", "task_id")
            missing = _one_per_task(before.join(lacking, ["crawl_id", "task_id"], "left_semi"), options.force)
        failed.add(missing.groupBy("crawl_id").agg(F.sum("n").alias("pages_failed")))
        visited.append(found.select(*VISITED))
        lists = found.where("depth = 0")
        if stops is not None:
            lists = lists.join(stops, "crawl_id", "left_anti")
        ranked = with_order_id(
            _next_tasks(lists, seen, columns, contested=not first), ["crawl_id", "parent_rank", "kind", "ord"],
            expand=lambda ordered: _queued(ordered, columns))
        seen.append(ranked.where("kind = 1").select("crawl_id", "seen_url"))
        frontier = ranked.select(
            "crawl_id", "start_url", F.col("next_url").alias("url"), columns["task_id"].alias("task_id"), "parent_url",
            "depth", "rank", (F.col("level") + 1).alias("level"),
        )
        if walked:
            # This step's details came first; those of the chains follow, level by level.
            visited.append(walked.pages.join(facts.select("task_id", "status"), "task_id").select(*VISITED))
            tried = unvisited(_one_per_task(walked.details, options.force))
            tried = materialize(join_frontier(tried, facts.select("task_id", "status")))
            failed.add(tried.where("status is null").groupBy("crawl_id").agg(F.sum("n").alias("pages_failed")))
            visited.append(tried.where("status is not null").select(*VISITED))
            seen.append(walked.pages.unionByName(walked.tails).where("at > 0").select("crawl_id", "seen_url"))
            frontier = materialize(frontier.unionByName(walked.tails.select(*frontier.columns)))
        if frontier.isEmpty():
            break
        first = False
    seen.close()
    return Crawl(visited.close(), failed.frame, facts, starts, options)


STEP_TYPE = "array<struct<kind:string,ord:bigint,url:string,name:string,email:string,phone:string,title:string>>"


def list_page_step(dom: DataFrame, *keys: str, start_url: str = "url", url: str = "url", hints: list[SiteHints] | None = None,
                   detail_limit: int | None = None) -> DataFrame:
    """What one visit of a list page yields: keys, kind, ord, url, name, email, phone, title, record_id, confidence.

    ``record`` rows are its cards, one per record id over all pages (by keys, then place); ``detail`` rows its links to person
    pages, of the first ``detail_limit`` links where given; ``next`` rows the pages to go on with, by the page's strategy and
    resolved against ``start_url``: all numbered ones, else the first candidate. All three are read off the parsed row
    and exploded at once; only the record ids meet in a shuffle.
    """
    page, own = Page(), F.col(url)
    links = listing.absolute(listing.detail_hrefs(page, hints=hints, url=own), own)
    if detail_limit is not None:
        links = F.slice(links, 1, detail_limit)
    strategy = hinted(hints, own, lambda h: h.pagination_strategy, F.lit, paging.pagination_strategy(page, F.col(start_url)))
    found = dom.withColumn("_cards", listing.cards(page, hints=hints, url=own)).withColumn("_strategy", strategy)
    nexts = paging.candidate_urls(paging.candidate_hrefs(page, F.col("_strategy")), F.col(start_url), F.col("_strategy"))
    found = found.select(*dict.fromkeys([*keys, url]), "_strategy", listing.card_records(page, F.col("_cards")).alias("_records"),
                         F.filter(links, url_is_person).alias("_details"), nexts.alias("_nexts"))
    norms = F.transform("_nexts", url_normalize)
    numbered = F.filter("_nexts", lambda u, i: F.array_position(norms, url_normalize(u)) == i + 1)
    taken = F.when(F.col("_strategy") == paging.NUMBERED, numbered).otherwise(F.slice("_nexts", 1, 1))

    def records(c: Column, i: Column) -> Column:
        target = F.when(c["href"] != BLANK, url_join(own, c["href"])).otherwise(BLANK)
        return F.struct(F.lit("record"), i.cast("bigint"), target, c["name"], c["email"], c["phone"], c["title"])

    def tasks(kind: str, urls: Column) -> Column:
        none = F.lit(None).cast("string")
        return F.transform(urls, lambda u, i: F.struct(F.lit(kind), i.cast("bigint"), u, none, none, none, none)).cast(STEP_TYPE)

    rows = F.concat(F.transform("_records", records).cast(STEP_TYPE), tasks("detail", F.col("_details")), tasks("next", taken))
    rows = found.select(*dict.fromkeys([*keys, url]), F.explode(rows).alias("_row"))
    is_record = F.col("_row.kind") == "record"
    keyed = with_record_id(rows.select("*", F.col("_row.url").alias("page_url"), F.col("_row.name").alias("name"), F.col("_row.email").alias("email")).withColumn("source_url", own))
    # Tasks are groups of their own.
    group = F.when(is_record, F.col("record_id")).otherwise(F.concat_ws(" ", "_row.kind", F.col("_row.ord").cast("string"), own))
    order = [F.col(k) for k in dict.fromkeys([*keys, url])] + [F.col("_row.ord")]
    once = top_k(keyed.withColumn("_group", group), ["_group"], order, 1)
    return once.select(*keys, "_row.*", F.when(is_record, F.col("record_id")).alias("record_id"), F.when(is_record, LIST_CONFIDENCE).alias("confidence"))


def list_page_records(visited: DataFrame, facts: DataFrame) -> DataFrame:
    """Records of the cards on visited list pages."""
    rows = visited.where("depth = 0").join(facts.select("task_id", "cards"), "task_id").select(
        "crawl_id", "level", "rank", F.col("url").alias("source_url"), F.posexplode("cards").alias("item", "_c"))
    blanks = {n: F.lit(BLANK) for n in FIELDS if n not in ("page_url", "name", "email", "phone", "title")}
    linked = F.when(F.col("_c.href") != BLANK, url_join("source_url", F.col("_c.href"))).otherwise(BLANK)
    return rows.select(
        "crawl_id", *ORDER, "source_url", linked.alias("page_url"),
        *[F.col(f"_c.{n}").alias(n) for n in ("name", "email", "phone", "title")],
    ).withColumns(blanks).withColumns({
        "extraction_method": F.lit("heuristic"), "confidence": F.lit(LIST_CONFIDENCE)})


def detail_page_records(
    visited: DataFrame, facts: DataFrame, fill: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """One record per visited detail page; ``fill`` completes it from a second source."""
    rows = visited.where("depth = 1").join(facts.select("task_id", "detail"), "task_id").select(
        "crawl_id", "level", "rank", F.lit(0).alias("item"), F.col("url").alias("source_url"), "detail.*")
    rows = rows.withColumn("page_url", F.coalesce(F.nullif("page_url", F.lit(BLANK)), F.col("source_url")))
    if fill:
        rows = fill(rows)
    return rows.withColumns({
        "extraction_method": F.lit("hybrid" if fill else "heuristic"), "confidence": F.lit(DETAIL_CONFIDENCE)})


def crawl_records(crawl: Crawl) -> DataFrame:
    """Records in crawl order, one per record id and crawl, before the final key dedup.

    Written to a checkpoint once, because output and statistics both read them.
    """
    both = list_page_records(crawl.visited, crawl.facts).unionByName(
        detail_page_records(crawl.visited, crawl.facts, crawl.options.fill), allowMissingColumns=True)
    return materialize(dedup_record_id(both, ORDER, ["crawl_id"], crawl.options.prefer))


def crawl_output(records: DataFrame) -> DataFrame:
    """The records a crawl delivers: one per page URL and name."""
    return dedup_by_keys(records, OUTPUT_KEYS, ORDER, ["crawl_id"])


def run_stats(crawl: Crawl, records: DataFrame, output: DataFrame) -> DataFrame:
    """Per crawl: pages fetched and failed, records before and after the final dedup, error."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("crawl_id").agg(F.count("*").alias(name))

    parts = {
        "pages_fetched": counted(crawl.visited, "pages_fetched"),
        "pages_failed": crawl.failed.groupBy("crawl_id").agg(F.sum("pages_failed").alias("pages_failed")),
        "records_extracted": counted(records, "records_extracted"),
        "records_valid": counted(output, "records_valid"),
    }
    stats = crawl.starts
    for part in parts.values():
        stats = stats.join(part, "crawl_id", "left")
    return stats.select(
        "crawl_id", "start_url", *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in parts],
        F.when(~F.col("allowed"), F.lit("Disallowed by robots.txt")).alias("error"),
    )


def page_events(crawl: Crawl) -> DataFrame:
    """A page_fetched event per visited page, for the event log."""
    return event_rows(
        crawl.visited, F.col("crawl_id"), F.lit("page_fetched"), F.col("task_id"), F.struct("url", "status"))
