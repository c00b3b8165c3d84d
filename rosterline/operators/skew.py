"""Joins that stay balanced when single keys hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot above this share of all rows, so there can never be more than HOT_SHARE of them.
HOT_SHARE = 1000
SPREAD = 32


def skew_join(big: DataFrame, keyed: DataFrame, on: str, how: str = "left", spread: int = SPREAD) -> DataFrame:
    """Join ``big`` with ``keyed`` on one column, spreading each hot key over ``spread`` tasks.

    Hot keys are counted, not guessed: fewer than ``HOT_SHARE`` keys can exceed that
    share, which bounds what is broadcast. Only their rows in ``keyed`` are repeated.
    The result is partitioned by key and salt, so a following aggregate by the key
    combines within tasks first.
    """
    # One plan for the limit and both sides, so that its shuffle is run once and reused.
    sizes = big.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("_n"))
    limit = sizes.agg(F.sum("_n") / HOT_SHARE).scalar()
    hot = F.broadcast(sizes.where(F.col("_n") > limit).select(on, F.lit(True).alias("_hot")))
    # A row's own number, so that equal rows of a hot key spread too.
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(spread)).cast("int")
    # Null keys match nothing, but would all meet in one task.
    spread_out = F.col("_hot") | F.col(on).isNull()
    left = big.join(hot, on, "left").withColumn("_salt", F.when(spread_out, salt).otherwise(0)).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(F.lit(0)))
    right = keyed.join(hot, on, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [on, "_salt"], how).drop("_salt")
