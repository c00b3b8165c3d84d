"""Stored robots.txt texts as an allow/deny filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.functions.text import let, py_strip
from rosterline.functions.urls import split_url, url_netloc
from rosterline.operators.skew import skew_join

RULES = "array<struct<allow:boolean,prefix:string>>"
ENTRIES = f"array<struct<agents:array<string>,rules:{RULES}>>"
# What the entry being read holds so far: nothing, agents only, or rules as well.
EMPTY, NAMED, RULED = 0, 1, 2


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def _entries(text: Column) -> Column:
    """The entries of a robots text, in its order; folded within the row that holds the text.

    Consecutive User-agent lines share the rules below them. A blank line, or a User-agent line
    after a rule, ends the entry; one without rules is dropped, and rules before any User-agent
    are ignored. An empty Disallow allows everything.
    """
    lines = F.transform(
        F.split(text, r"\r\n|\n|\r"),
        lambda line: let(
            py_strip(F.split_part(line, F.lit("#"), F.lit(1))),
            lambda t: F.struct(
                (line == "").alias("blank"),
                F.when(t.contains(":"), F.lower(py_strip(F.split_part(t, F.lit(":"), F.lit(1))))).otherwise("").alias("key"),
                _decoded(py_strip(F.regexp_extract(t, r"^[^:]*:(.*)$", 1))).alias("value"),
            ),
        ),
    )
    no_agents, no_rules = F.array().cast("array<string>"), F.array().cast(RULES)
    start = F.struct(
        F.array().cast(ENTRIES).alias("done"), no_agents.alias("agents"), no_rules.alias("rules"), F.lit(EMPTY).alias("stage"))

    def closed(state: Column) -> Column:
        whole = F.array(F.struct(state["agents"].alias("agents"), state["rules"].alias("rules"))).cast(ENTRIES)
        return F.when(state["stage"] == RULED, F.concat(state["done"], whole)).otherwise(state["done"])

    def step(state: Column, line: Column) -> Column:
        named = line["key"] == "user-agent"
        # Delays and rates end the list of agents as rules do.
        ruling = line["key"].isin("allow", "disallow", "crawl-delay", "request-rate") & (state["stage"] != EMPTY)
        rule = F.array(F.struct(
            ((line["key"] == "allow") | (line["value"] == "")).alias("allow"), line["value"].alias("prefix"))).cast(RULES)
        ends = line["blank"] | (named & (state["stage"] == RULED))
        agents = F.when(ends, no_agents).otherwise(state["agents"])
        return F.struct(
            F.when(ends, closed(state)).otherwise(state["done"]).alias("done"),
            F.when(named, F.concat(agents, F.array(F.lower(line["value"])))).otherwise(agents).alias("agents"),
            F.when(ends, no_rules).when(ruling & line["key"].isin("allow", "disallow"), F.concat(state["rules"], rule))
            .otherwise(state["rules"]).alias("rules"),
            F.when(named, NAMED).when(line["blank"], EMPTY).when(ruling, RULED).otherwise(state["stage"]).alias("stage"),
        )

    return F.aggregate(lines, start, step, closed)


def _texts(robots: DataFrame) -> DataFrame:
    """One text per host: the latest by ``fetched_at`` where it is stored, then the greatest."""
    times = [F.col("fetched_at").cast("timestamp")] if "fetched_at" in robots.columns else []
    known = robots.where(F.col("robots_txt").isNotNull())
    return known.groupBy("host").agg(F.max_by("robots_txt", F.struct(*times, F.col("robots_txt"))).alias("robots_txt"))


def robots_rules(robots: DataFrame) -> DataFrame:
    """host, entry, agents, ord, allow, prefix: one row per rule of a host's text."""
    entries = _texts(robots).select("host", F.posexplode(_entries(F.col("robots_txt"))).alias("entry", "_e"))
    return entries.select("host", "entry", "_e.agents", F.posexplode("_e.rules").alias("ord", "_r")).select(
        "host", "entry", "agents", "ord", "_r.*")


def with_robots_allowed(urls: DataFrame, robots: DataFrame, user_agent: str = "*", url: str = "url") -> DataFrame:
    """Add ``allowed``. Hosts without stored rules are open.

    The first entry that names the agent counts, else the first for all; in it the first matching
    rule decides. It is chosen before the join, so every URL meets at most one row by an equi join
    and no pair of URL and rule is ever emitted.
    """
    agent = F.lit(user_agent.split("/")[0].lower())
    entries = F.col("_entries")
    general = F.filter(entries, lambda e: F.array_contains(e["agents"], "*"))
    own = F.filter(entries, lambda e: ~F.array_contains(e["agents"], "*") & F.exists(e["agents"], agent.contains))
    per_host = _texts(robots).select("host", _entries(F.col("robots_txt")).alias("_entries")).select(
        "host", F.coalesce(F.get(own, F.lit(0)), F.get(general, F.lit(0)))["rules"].alias("_rules"))

    def decide(rules: Column) -> Column:
        fits = F.filter(rules, lambda r: F.col("_path").startswith(r["prefix"]))
        return F.get(fits, F.lit(0))["allow"]

    parts = split_url(F.col(url))
    path = F.concat(
        F.when(parts["path"] == "", F.lit("/")).otherwise(parts["path"]),
        F.when(parts["params"] != "", F.concat(F.lit(";"), parts["params"])).otherwise(""),
        F.when(parts["query"] != "", F.concat(F.lit("?"), parts["query"])).otherwise(""),
    )
    located = urls.withColumn("host", F.coalesce(url_netloc(url), F.lit(""))).withColumn("_path", _decoded(path))
    joined = skew_join(located, per_host, "host")
    return joined.withColumn(
        "allowed", F.coalesce(decide(F.col("_rules")), F.lit(True))
    ).drop("_rules", "_path", "host")


def robots_filter(urls: DataFrame, robots: DataFrame, user_agent: str = "*", url: str = "url") -> DataFrame:
    return with_robots_allowed(urls, robots, user_agent, url).where("allowed").drop("allowed")
