"""Per-site hints: as driver-side settings compiled into expressions, and as a lookup join."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.functions.urls import url_registered_domain


@dataclass(frozen=True)
class SiteHints:
    domain: str
    root_url: str | None = None
    list_item_selector: str | None = None
    next_page_selector: str | None = None
    profile_link_selector: str | None = None
    pagination_strategy: str | None = None
    field_label_synonyms: dict = field(default_factory=dict)


def domain_matches(domain: Column, target: Column) -> Column:
    """Either name contains the other."""
    return target.contains(domain) | domain.contains(target)


def hinted(
    hints: list[SiteHints] | None, url: Column | None, pick: Callable[[SiteHints], str | None],
    use: Callable[[str], Column], default: Column,
) -> Column:
    """``use(value)`` on the pages of the first matching site that sets the value, else ``default``."""
    chain = None
    for h in hints or []:
        here = domain_matches(F.lit(h.domain), url_registered_domain(url))
        value = pick(h)
        result = use(value) if value else default
        chain = F.when(here, result) if chain is None else chain.when(here, result)
    return default if chain is None else chain.otherwise(default)


def _parts(df: DataFrame, text: str, other: DataFrame, other_text: str) -> DataFrame:
    """``df`` once per distinct substring (``_part``) of ``text`` that is as long as some ``other_text``."""
    lengths = other.agg(F.collect_set(F.length(other_text)).alias("_lengths"))  # one row, one entry per length of a name
    size = F.length(text)
    parts = F.flatten(F.transform(
        F.filter("_lengths", lambda n: (n > 0) & (n <= size)),
        lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda at: F.substring(F.col(text), at, n))))
    return df.crossJoin(F.broadcast(lengths)).withColumn("_part", F.explode(F.array_distinct(parts))).drop("_lengths")


def hints_lookup(targets: DataFrame, hints: DataFrame, target: str = "target") -> DataFrame:
    """Add ``hint``: the first hint row (by ``ord``) whose ``domain`` matches, else null.

    "Contains" is an equi join here: the distinct targets' substrings of the lengths that domains have meet the domains,
    and the other way round, so any number of hints will do.
    """
    packed = hints.select(F.col("ord"), F.col("domain").alias("_domain"), F.struct(*hints.columns).alias("hint"))
    names = targets.select(target).where(F.col(target).isNotNull()).distinct()
    within = _parts(names, target, packed, "_domain").join(packed, F.col("_part") == F.col("_domain")).select(target, "ord", "hint")
    around = _parts(packed, "_domain", names, target).join(names, F.col("_part") == F.col(target)).select(target, "ord", "hint")
    empty = names.where(F.col(target) == "").crossJoin(F.broadcast(packed.agg(F.min("ord").alias("ord"), F.min_by("hint", "ord").alias("hint"))))
    blank = packed.where("_domain = ''").agg(F.min("ord").alias("ord"), F.min_by("hint", "ord").alias("hint")).where("ord is not null")
    everywhere = names.crossJoin(F.broadcast(blank))
    found = within.unionByName(around).unionByName(empty.where("ord is not null")).unionByName(everywhere)
    return targets.join(found.groupBy(target).agg(F.min_by("hint", "ord").alias("hint")), target, "left")
