"""Ranks, top-n cuts and samples that never gather the whole input in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterline.session import materialize

_ROW_BITS = 33
_GREATEST = 1.7976931348623157e308
# Size of the quantile sketch (some 80 KB) and the share of rows its ranks may be off by, with room to spare.
_SKETCH_K = 4096
_SLACK = 0.001


def with_order_id(df: DataFrame, order: list[Column | str], name: str = "rank",
                  expand: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Add an increasing, not dense id along a total order, sorted in parallel and checkpointed.

    ``order`` should be unique: equal keys are never split across partitions. ``expand``, a narrow step that keeps the order
    (an explode, say), is taken between sort and id: what it makes is neither sorted nor worked out again for the ranges' bounds.
    """
    # Without a number, so that adaptive execution merges neighbouring ranges of a small table.
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(expand(ordered).withColumn(name, F.monotonically_increasing_id()))


def with_global_rank(df: DataFrame, order: list[Column | str], rank: str = "rank") -> DataFrame:
    """Add the 0-based position in a total order.

    A position is the rows of all partitions before plus the place within one. Only one
    count per partition is joined back, which is bounded by the number of partitions.
    """
    placed = with_order_id(df, order, "_place")
    part = F.shiftright("_place", _ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = F.coalesce(
        F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    offsets = sizes.select("_part", before.alias("_offset"))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(rank, F.col("_offset") + F.col("_place").bitwiseAND((1 << _ROW_BITS) - 1))
        .drop("_part", "_place", "_offset")
    )


def _order_number(name: str, kind: T.DataType) -> Column:
    """A double that never falls where the column rises, null lowest; equal numbers say nothing. Zero for kinds without one."""
    c = F.col(f"`{name}`")
    if isinstance(kind, T.BooleanType):
        number = c.cast("int")
    elif isinstance(kind, T.NumericType):
        number = c
    elif isinstance(kind, T.DateType):
        number = F.unix_date(c)
    elif isinstance(kind, T.TimestampType):
        number = F.unix_micros(c)
    elif isinstance(kind, T.BinaryType) or isinstance(kind, T.StringType) and kind.isUTF8BinaryCollation():
        # The first six bytes; shorter values are filled with zeros.
        head = F.substring(F.encode(c, "UTF-8") if isinstance(kind, T.StringType) else c, 1, 6)
        number = F.conv(F.rpad(F.hex(head), 12, "0"), 16, 10)
    else:
        return F.lit(0.0)
    number = number.cast("double")
    # Sketches leave out NaN, which sorts last.
    return F.when(F.isnan(number), _GREATEST).otherwise(F.greatest(F.least(F.coalesce(number, F.lit(-_GREATEST)), F.lit(_GREATEST)), F.lit(-_GREATEST)))


def _widen(slack: float) -> float:
    return slack * 4


def first_n(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of a total order of ascending columns, by position, whatever ``n`` is.

    A quantile sketch, merged from all tasks, gives a bound of the n-th value of the first column; only rows up to it are
    stored and ranked. Their exact number is then counted, and the bound widened while they are too few, so the sketch's
    error costs time, never rows. Ties of the bound are all ranked. ``df`` is read once for the sketch and once for the rows.
    """
    if n <= 0:
        return df.limit(0)
    number = _order_number(order[0], df.schema[order[0]].dataType)
    about = df.select(number.alias("_c")).agg(F.count("*").alias("total"), F.kll_sketch_agg_double("_c", F.lit(_SKETCH_K)).alias("sketch"))
    # The one row lies in memory, so that widening reads its sketch and not the table.
    row = about.first()
    if row.total <= n:
        return df
    one = df.sparkSession.createDataFrame([(bytearray(row.sketch),)], "sketch binary")
    slack = _SLACK
    while True:
        share = min(1.0, max(0.0, n / row.total + slack))
        bound = one.select(F.kll_sketch_get_quantile_double("sketch", F.lit(share))).first()[0]
        within = materialize(df if share == 1.0 else df.where(number <= bound))
        if share == 1.0 or within.count() >= n:
            return with_global_rank(within, order, "_rank").where(F.col("_rank") < n).drop("_rank")
        slack = _widen(slack)


def call_budget(df: DataFrame, budget: int, order: str = "seq") -> DataFrame:
    """The rows whose calls fit the budget, in order."""
    return first_n(df, [order], budget)


def sample_n(df: DataFrame, n: int, key: list[str], seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows without replacement (all when fewer); the same ones for the same seed.

    Those with the least SHA-256 of the seed and the key columns' texts; equal ones go by the key columns.
    """
    texts = [F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in key]
    drawn = df.withColumn("_draw", F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), *texts), 256))
    return first_n(drawn, ["_draw", *key], n).drop("_draw")


def top_k(df: DataFrame, by: list[str], order: list[Column | str], k: int) -> DataFrame:
    """First ``k`` rows per group; Spark cuts each group before the shuffle, so a hot group stays small."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= k).drop("_n")


def top_k_links(links: DataFrame, page: str = "page_id", order: str = "ord", k: int = 50) -> DataFrame:
    return top_k(links, [page], [order], k)


def sort_by_score(df: DataFrame, score: str, *ties: str) -> DataFrame:
    """Best first; ``ties`` keep equal scores in a fixed order."""
    return df.orderBy(F.desc(score), *ties)
