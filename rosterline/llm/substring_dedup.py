"""Repeated passages by content-defined chunking: a gear rolling hash says where the stretches that are compared begin."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterline.llm.common import columns_as, map_batches, process_object, store


@dataclass(frozen=True)
class Chunking:
    """A chunk ends where the hash of the last 32 characters has ``bits`` leading zeros, but not before ``least`` characters;
    where none comes within ``most``, at the smallest hash, so that also monotonous text is cut by its content.

    Stretches of ``run`` characters are compared exactly (by 64-bit digest). They begin at the smallest hash of every
    ``window`` characters, so any passage of ``run + window - 1`` characters that documents share holds one that starts
    at the same place of the passage in each of them: all such passages are found, and none of less than ``run``. Up to
    ``window - 1`` characters at each end of a passage inside a text may stay out of its span.
    """

    bits: int = 5
    least: int = 16
    most: int = 512
    run: int = 120
    window: int = 32


def _gear() -> np.ndarray:
    return np.random.default_rng(29).integers(0, 1 << 32, 1 << 16, dtype=np.uint32)


def rolling_hash(codes: np.ndarray) -> np.ndarray:
    """Gear hash at every character: the last 32 characters' random numbers, each shifted once per step, summed by doubling."""
    h = process_object("gear", _gear)[(codes ^ (codes >> np.uint32(16))) & np.uint32(0xFFFF)]
    for step in (1, 2, 4, 8, 16):
        if len(h) > step:
            more = h.copy()
            more[step:] += h[:-step] << np.uint32(step)
            h = more
    return h


def cuts(h: np.ndarray, chunking: Chunking) -> list[int]:
    """Ends of the chunks of a text with these hashes."""
    n, out, start = len(h), [], 0
    for c in [*(np.flatnonzero(h >> np.uint32(32 - chunking.bits) == 0) + 1).tolist(), n]:
        while c - start > chunking.most:
            start += chunking.least + int(h[start + chunking.least : start + chunking.most].argmin()) + 1
            out.append(start)
        if c - start >= chunking.least:
            out.append(c)
            start = c
    if start < n:  # a short rest
        out.append(n)
    return out


def stretches(h: np.ndarray, chunking: Chunking) -> np.ndarray:
    """Starts of the stretches of a text with these hashes, among them its first and its last; none if it is too short.

    The hash of a start is that of the stretch's own first 32 characters."""
    most = len(h) - chunking.run + 1
    if most < 1:
        return np.zeros(0, np.int64)
    # Hash and place in one number; the smallest of every window by doubling.
    own = h[31 : 31 + most].astype(np.uint64) << np.uint64(32) | np.arange(most, dtype=np.uint64)
    low, width = own, 1
    while width < chunking.window and len(low) > 1:
        step = min(width, chunking.window - width, len(low) - 1)
        low = np.minimum(low[:-step], low[step:])
        width += step
    return np.unique(np.concatenate([[0], (low & np.uint64(0xFFFFFFFF)).astype(np.int64), [most - 1]]))


def chunks(docs: DataFrame, chunking: Chunking, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, start, digest)`` of each stretch of ``run`` characters; null ids and short or null texts have none."""

    def run(batch: dict):
        for doc, content in zip(batch["doc_id"], batch["text"]):
            if not content or len(content) < chunking.run:
                continue
            codes = np.frombuffer(content.encode("utf-32-le", "surrogatepass"), np.uint32)
            starts = stretches(rolling_hash(codes), chunking)
            digest, raw, size = xxhash.xxh3_64_intdigest, memoryview(codes).cast("B"), 4 * chunking.run
            found = np.fromiter((digest(raw[a : a + size]) for a in (4 * starts).tolist()), np.uint64, len(starts))
            keep = _apart(starts, found, chunking.window)
            held["doc_id"].append(np.full(len(keep), doc, np.int64))
            held["start"].append(starts[keep].astype(np.int32))
            held["digest"].append(found[keep].view(np.int64))
            if len(held["doc_id"]) >= 500:
                yield flush()
        if held["doc_id"]:
            yield flush()

    held: dict[str, list] = {k: [] for k in ("doc_id", "start", "digest")}

    def flush():
        out = {k: np.concatenate(v) for k, v in held.items()}
        for v in held.values():
            v.clear()
        return out

    plain = columns_as(docs, doc_id=doc_id, text=text).where("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long"))
    return map_batches(plain, run, "doc_id long, start int, digest long")


def _apart(starts: np.ndarray, found: np.ndarray, least: int) -> np.ndarray:
    """Which stretches to send: of equal ones in a row (monotonous text) the first, the last and one every ``least`` characters,
    which still cover the same characters."""
    same = found[1:] == found[:-1]
    keep = np.ones(len(starts), bool)
    inner = np.flatnonzero(same[1:] & same[:-1]) + 1 if len(same) > 1 else ()
    last = -1
    for k in inner:
        if keep[k - 1]:
            last = k - 1
        # Left out if the next one still lies within reach of the last that was kept.
        keep[k] = starts[k + 1] - starts[last] > least
    return np.flatnonzero(keep)


def repeated_passages(docs: DataFrame, chunking: Chunking = Chunking(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, start, end, removed)``: the spans (characters) of a document that other documents have too.

    ``removed`` is true where an earlier document (smaller id) has the stretches; the earliest document keeps them, so of
    copies and shared passages one stays. Repeats inside one document aren't counted. Digests are combined in tasks before
    they are shuffled, and the join back to the stretches is one that Spark can split at hot digests. Null ids and null or
    empty texts give no spans; rows that repeat an id are one document; an empty table gives no rows.
    """
    found = chunks(docs, chunking, doc_id, text)
    shared = found.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    # Stored, so that both sides of the join below are plain exchanges, which Spark splits at hot digests.
    shared = store(shared.where("first_doc <> last_doc").select("digest", "first_doc"))
    rows = chunks(docs, chunking, doc_id, text).join(shared, "digest")
    rows = rows.groupBy("doc_id", "start").agg(F.max(F.col("doc_id") > F.col("first_doc")).alias("again"))
    rows = rows.withColumn("end", F.col("start") + chunking.run)
    # Stretches overlap and are equally long: each adds what none before it has; what one that goes covers, goes.
    by_doc = Window.partitionBy("doc_id").orderBy("start")
    before = by_doc.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("doc_id").orderBy(F.desc("start")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "doc_id", F.col("again").alias("removed"),
        F.greatest("start", F.when(F.col("again"), F.max(F.when(F.col("again"), F.col("end"))).over(before)).otherwise(F.max("end").over(before))).alias("start"),
        F.when(F.col("again"), F.col("end")).otherwise(F.least("end", F.min(F.when(F.col("again"), F.col("start"))).over(after))).alias("end"))
    rows = rows.where("start < end")
    new = F.when(F.col("start") == F.lag("end").over(Window.partitionBy("doc_id", "removed").orderBy("start")), 0).otherwise(1)
    rows = rows.withColumn("new", new).withColumn("island", F.sum("new").over(Window.partitionBy("doc_id", "removed").orderBy("start")))
    return rows.groupBy("doc_id", "removed", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select(
        "doc_id", "start", "end", "removed")


def by_document(passages: DataFrame) -> DataFrame:
    """``(doc_id, repeated_chars, removed_chars, spans)``, a row per document with a repeated passage; spans are
    ``start:end`` of the removed ones, comma-joined in order."""
    width = F.col("end") - F.col("start")
    gone = F.sort_array(F.collect_list(F.when(F.col("removed"), F.struct("start", "end"))))
    return passages.groupBy("doc_id").agg(
        F.sum(width).cast("long").alias("repeated_chars"), F.coalesce(F.sum(F.when(F.col("removed"), width)), F.lit(0)).cast("long").alias("removed_chars"),
        F.array_join(F.transform(gone, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"))


def without_repeats(docs: DataFrame, passages: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with removed spans cut out of their texts; all rows and columns stay."""
    gone = passages.where("removed").groupBy(F.col("doc_id").alias("_doc")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_gone"))
    out = docs.join(gone, docs[doc_id] == gone["_doc"], "left")
    cut = F.aggregate(
        "_gone", F.struct(F.lit("").alias("kept"), F.lit(0).alias("at")),
        lambda a, s: F.struct(F.concat(a["kept"], F.substring(out[text], a["at"] + 1, s["start"] - a["at"])).alias("kept"), s["end"].alias("at")),
        lambda a: F.concat(a["kept"], F.substring(out[text], a["at"] + 1, F.length(out[text]))))
    return out.withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(cut)).select(docs.columns)
