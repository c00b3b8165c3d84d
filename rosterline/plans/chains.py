"""Chains of list pages that name one next page each, walked by pointer doubling.

A level-wise walk needs a step per page of such a chain. Here a table of pointers is joined
with itself, so after k rounds a pointer leads 2^k pages on; a walk that knows its first 2^k
pages learns the next 2^k in one join. A chain of N pages takes about log N rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.functions.urls import SCHEME, split_url, task_id, url_join, url_normalize
from rosterline.operators import paging
from rosterline.session import materialize

#: Next pages come after all details of their level.
AFTER_DETAILS = 1 << 40


def _site(url: Column) -> Column:
    parts = split_url(url)
    return F.concat(parts["scheme"], F.lit("://"), F.lower(parts["netloc"]))


def _path(url: Column) -> Column:
    return split_url(url)["path"]


def chain_edges(facts: DataFrame) -> DataFrame:
    """(task_id, next_task, next_url, reach, site, path): the first next page of each list page that takes one.

    Links resolve against a crawl's start; ``reach`` says when the page's own URL gives the same: always for ``full`` ones,
    on the same site for ``root`` ones, and with the same path for the others.
    """
    href = F.when(F.col("strategy") == paging.NEXT_LINK, F.get("next_hrefs", 0)).when(F.col("strategy") == paging.CURSOR, F.get("cursor_hrefs", 0))
    found = facts.select("task_id", "url", href.alias("href")).where("href is not null and href not like '#%'")
    reach = F.when(F.col("href").rlike(SCHEME), "full").when(F.col("href").startswith("/"), "root").otherwise("path")
    found = found.select("task_id", url_join("url", F.col("href")).alias("next_url"), reach.alias("reach"), _site(F.col("url")).alias("site"), _path(F.col("url")).alias("path"))
    return found.withColumn("next_task", task_id("next_url"))


class Jumps:
    """Pointers over the edges, doubled as far as a walk asks for and kept for the next one."""

    def __init__(self, edges: DataFrame):
        self.edges = edges
        self.tables = [edges.select("task_id", "next_task", "next_url")]

    def table(self, k: int) -> DataFrame:
        """Where ``2 ** k`` steps lead."""
        while len(self.tables) <= k:
            last = self.tables[-1]
            on = last.select(F.col("task_id").alias("next_task"), F.col("next_task").alias("far_task"), F.col("next_url").alias("far_url"))
            doubled = last.drop("next_url").join(on, "next_task").select("task_id", F.col("far_task").alias("next_task"), F.col("far_url").alias("next_url"))
            self.tables.append(materialize(doubled))
        return self.tables[k]


def walk(heads: DataFrame, jumps: Jumps) -> DataFrame:
    """(crawl_id, start_url, task_id, url, at): the pages of each head's chain, ``at`` steps from it, as the edges lead.

    A chain that meets one of its pages again is not followed further; it may hold pages twice.
    """
    rows, k = materialize(heads.select("crawl_id", "start_url", "task_id", "url", F.lit(0).cast("bigint").alias("at"))), 0
    open_ = rows
    while True:
        step = open_.join(jumps.table(k), "task_id").select(
            "crawl_id", "start_url", F.col("next_task").alias("task_id"), F.col("next_url").alias("url"), (F.col("at") + F.lit(1 << k)).alias("at"))
        step = materialize(step)
        if step.isEmpty():
            return rows
        rows = materialize(rows.unionByName(step))
        again = rows.groupBy("crawl_id", "task_id").agg(F.count("at").alias("n")).where("n > 1").select("crawl_id").distinct()
        open_ = rows.join(again, "crawl_id", "left_anti")
        k += 1


def broken_edges(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(crawl_id, at): the places after pages without an edge, or whose edge a crawl with this start would resolve otherwise."""
    known = edges.select("task_id", "reach", "site", "path")
    start = F.col("start_url")
    holds = ((F.col("reach") == "full") | (F.col("site") == _site(start)) & ((F.col("reach") == "root") | (F.col("path") == _path(start))))
    return rows.join(known, "task_id", "left").where(~F.coalesce(holds, F.lit(False))).select("crawl_id", (F.col("at") + 1).alias("at"))


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """(crawl_id, at): places whose keys an earlier place of the same chain has."""
    first = rows.groupBy("crawl_id", *keys).agg(F.min("at").alias("first"))
    return rows.join(first, ["crawl_id", *keys]).where("at > first").select("crawl_id", "at")


def with_seen_url(rows: DataFrame) -> DataFrame:
    return rows.withColumn("seen_url", url_normalize("url"))
