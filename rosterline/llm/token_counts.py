"""Token counts: an exact histogram of encoded lengths, and what its suffix sums answer for every context limit."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterline.llm.common import columns_as, map_batches, store
from rosterline.llm.wordbpe import encoder

#: Lengths per block of the two-level suffix sums.
BLOCK = 1024


def length_histogram(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """``(n_tokens, n_docs)``, one row per distinct encoded length.

    A null text counts as empty (0 tokens); texts are encoded whole; repeated rows count each time; an empty table gives
    no rows. Tasks send one row per batch and length.
    """

    def run(batch: dict):
        encode = encoder(tokenizer)
        lengths, counts = np.unique([len(encode(t)) for t in batch["text"]], return_counts=True)
        yield {"n_tokens": lengths, "n_docs": counts}

    parts = map_batches(columns_as(docs, text=text), run, "n_tokens long, n_docs long", rows=10_000)
    return parts.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def _with_prefix(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Running sum of ``value`` by ``n_tokens``, its own row included: within blocks of lengths, plus what lies before."""
    blocks = df.groupBy("_block").agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum(value).over(Window.partitionBy("_block").orderBy("n_tokens"))
    out = df.withColumn(name, inside).join(blocks.select("_block", before.alias("_before")), "_block")
    return out.withColumn(name, F.col(name) + F.col("_before")).drop("_before")


def length_report(histogram: DataFrame, limits: Iterable[int] = ()) -> DataFrame:
    """Per length of the histogram, and per further limit asked for (with no documents of its own):

    ``n_docs``, ``docs_at_most``, ``docs_at_least`` and ``tokens_at_least`` (suffix sums), ``truncated_tokens`` (what is left
    when each document is cut to that many tokens), ``docs_cut``, and ``quantile`` (share of documents at most that long;
    the q-quantile is the smallest length whose share reaches q). Only block sums meet in one task: one per 1024 lengths.
    The histogram is stored first, because the sums read it several times and each reading would encode all texts anew.
    """
    histogram = store(histogram)
    asked = [(int(x),) for x in limits]
    if asked:
        more = histogram.sparkSession.createDataFrame(asked, "n_tokens long").select("n_tokens", F.lit(0).cast("long").alias("n_docs"))
        histogram = histogram.unionByName(more).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    cut = histogram.withColumn("_block", F.floor(F.col("n_tokens") / BLOCK))
    out = _with_prefix(cut, F.col("n_docs"), "docs_at_most")
    out = _with_prefix(out, F.col("n_docs") * F.col("n_tokens"), "tokens_at_most")
    whole = histogram.agg(F.sum("n_docs").alias("_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("_tokens"))
    out = out.crossJoin(F.broadcast(whole))  # one row
    at_least = F.col("_docs") - F.col("docs_at_most") + F.col("n_docs")
    return out.select(
        "n_tokens", "n_docs", "docs_at_most", at_least.alias("docs_at_least"),
        (F.col("_tokens") - F.col("tokens_at_most") + F.col("n_docs") * F.col("n_tokens")).alias("tokens_at_least"),
        (F.col("tokens_at_most") + F.col("n_tokens") * (F.col("_docs") - F.col("docs_at_most"))).alias("truncated_tokens"),
        (F.col("_docs") - F.col("docs_at_most")).alias("docs_cut"),
        (F.col("docs_at_most") / F.col("_docs")).alias("quantile"),
    )


def quantiles(report: DataFrame, shares: Iterable[float]) -> DataFrame:
    """One row: for each share the smallest length that this share of the documents doesn't exceed."""
    return report.agg(*[F.min(F.when(F.col("quantile") >= q, F.col("n_tokens"))).alias(f"q{q:g}") for q in shares])
