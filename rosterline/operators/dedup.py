"""First-wins deduplication, unions and distinct sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.functions.text import dedup_key, record_id
from rosterline.operators.ranking import top_k
from rosterline.operators.schema import column_types


def _named(columns: dict, name: str) -> Column:
    return F.col(f"`{name}`").cast("string") if name in columns else F.lit(None).cast("string")


def with_record_id(records: DataFrame) -> DataFrame:
    types = column_types(records)
    parts = [_named(types, c) for c in ("page_url", "name", "email", "source_url")]
    return records.withColumn("record_id", record_id(*parts))


def dedup_record_id(
    records: DataFrame, order: list[str] | None = None, within: list[str] | None = None, prefer: str | None = None
) -> DataFrame:
    """First record per id in ``order``; ``prefer='confidence'`` ranks by that column first.

    ``within`` keeps runs apart. Keeps ``record_id``.
    """
    ranked = ([F.desc(prefer)] if prefer else []) + [F.col(c) for c in order or ["seq"]]
    return top_k(with_record_id(records), [*(within or []), "record_id"], ranked, 1)


def dedup_by_keys(
    records: DataFrame, fields: list[str], order: list[str] | None = None, within: list[str] | None = None
) -> DataFrame:
    """First record per key; records without any key value are all kept.

    Keyless records bypass the shuffle, so they never meet in one group.
    """
    keyed = records.withColumn("_key", dedup_key(column_types(records), fields))
    winners = top_k(keyed.where(F.col("_key").isNotNull()), [*(within or []), "_key"], list(order or ["seq"]), 1)
    return winners.unionByName(keyed.where(F.col("_key").isNull())).drop("_key")


def union_records(*frames: DataFrame) -> DataFrame:
    """All records; columns one side lacks become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()
