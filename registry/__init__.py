"""The registered queries: each one a callable and, where SQL can say it, the equivalent SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rosterline.session import ensure_checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a query under its key."""

    def add(fn: Query) -> Query:
        QUERIES[key] = fn
        if sql:
            SQL[key] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints, reachable by every executor."""
    return f"{ensure_checkpoint_dir(spark)}/rosterline-{uuid.uuid4().hex}/{name}"


def load_all() -> None:
    from registry import directory, jobs, records, scalars, trees  # noqa: F401
