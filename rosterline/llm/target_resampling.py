"""Importance resampling towards a target: bucket histograms of word runs, summed gains, and the highest noisy scores."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.llm.common import columns_as, map_batches, process_object, store
from rosterline.operators.ranking import with_global_rank

#: What stands between words (fixed value): ASCII other than digits and lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Features:
    """All runs of 1 to ``longest`` consecutive words, each in one of ``buckets`` by its CRC-32."""

    longest: int = 3
    buckets: int = 10_000


def splitter() -> Callable[[str], list[tuple[str, tuple[int, int]]]]:
    """An untrained pre-tokenizer that gives words with their offsets."""

    def make():
        from tokenizers import Regex, pre_tokenizers

        return pre_tokenizers.Split(Regex(BETWEEN), "removed")

    return process_object("word splitter", make).pre_tokenize_str


#: Longer texts are split piece by piece, cut between words.
PIECE = 1 << 20
_CUT = re.compile(BETWEEN)


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE:
        gap = _CUT.search(text, at + PIECE)
        end = gap.end() if gap else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def word_buckets(text: str | None, features: Features, split: Callable) -> tuple[int, np.ndarray]:
    """Number of words of the whole text, A-Z lower-cased, and the buckets of all runs, in no particular order."""
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass") if text else ""
    crc, words, held = zlib.crc32, 0, []
    last: list[str] = []  # words before a piece that its first runs begin with
    for piece in _pieces(low):
        found = split(piece) if piece else []
        if not found:
            continue
        old, known = len(last), [*last, *[w for w, _ in found]]
        # The words' offsets where one space stands between any two, in UTF-8 bytes.
        line = " ".join(known).encode("utf-8", "surrogatepass")
        width = np.array([*map(len, last), *[b - a for _, (a, b) in found]])
        if len(line) != width.sum() + len(known) - 1:
            width = np.array([len(w.encode("utf-8", "surrogatepass")) for w in known])
        ends = np.cumsum(width + 1) - 1
        starts, ends = (ends - width).tolist(), ends.tolist()
        view, out = memoryview(line), []
        for run in range(1, features.longest + 1):
            out += [crc(view[a:b]) for a, b in zip(starts[max(0, old - run + 1) :], ends[max(old, run - 1) :])]
        held.append((np.array(out, np.uint32) % np.uint32(features.buckets)).astype("<u2"))
        words += len(found)
        last = known[-(features.longest - 1) :] if features.longest > 1 else []
    return words, np.concatenate(held) if held else np.zeros(0, "<u2")


def bucketed(texts: DataFrame, features: Features, keep: list[str] | None = None) -> DataFrame:
    """``(keep, n_words, runs)``: the buckets of all runs of ``text`` as little-endian 16-bit numbers."""
    keep = keep or []
    if not 0 < features.buckets <= 1 << 16:
        raise ValueError("buckets are 16-bit numbers")

    def run(batch: dict):
        split = splitter()
        # Outputs are cut by size, not by rows: texts may be long.
        out: dict[str, list] = {name: [] for name in (*keep, "n_words", "runs")}
        size = 0
        for k, t in enumerate(batch["text"]):
            words, runs = word_buckets(t, features, split)
            for name in keep:
                out[name].append(batch[name][k])
            out["n_words"].append(words)
            out["runs"].append(runs.tobytes())
            size += len(runs)
            if size > 1 << 22:
                yield out
                out, size = {name: [] for name in out}, 0
        yield out

    types = dict(texts.dtypes)
    schema = ", ".join([*(f"{name} {types[name]}" for name in keep), "n_words long, runs binary"])
    return map_batches(texts.select(*keep, "text"), run, schema)


def histogram(runs: DataFrame, features: Features) -> np.ndarray:
    """How many runs each bucket holds. A task sends one row per bucket, whatever it read; the result has ``buckets`` numbers."""

    def run(batches):
        total = np.zeros(features.buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(np.frombuffer(value.as_buffer(), "<u2"), minlength=features.buckets)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(total[has])], names=["bucket", "n"])

    out = np.zeros(features.buckets, np.int64)
    for r in runs.select("runs").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Thousandths of the smoothed log-ratio of each bucket's share in the target to that in the source, rounded down."""
    n = len(source)
    all_target, all_source = int(target.sum()), int(source.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(all_source + n) / (float(s + 1) * float(all_target + n))))
                     for t, s in zip(target.tolist(), source.tolist())], np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of a digest of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, features: Features = Features(), least_words: int = 20, percent: int = 5, seed: int = 42,
             doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)``, one row per input row.

    Whole texts are read once, into the stored buckets of their runs; histograms of all documents and of all texts of the
    target give every bucket's gain, ``weight`` sums them and ``score`` adds the noise of the id. Of the documents with at
    least ``least_words`` words the highest ``percent`` per cent are drawn: ``rank`` counts them from 1 by score, ties by
    smaller id (nulls last, then features and weight); all others have none. Null, empty and wordless texts have no features
    and weight 0. A null id takes the noise of an empty one. Repeated rows are ranked each on its own. An empty target leaves
    all its counts 0; an empty table gives no rows. Only rows of numbers are sorted, by range.
    """
    plain = columns_as(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    runs = store(bucketed(plain, features, ["doc_id"]))
    table = gains(histogram(bucketed(columns_as(target, text=target_text), features), features), histogram(runs, features))
    held = table.tolist()

    def weigh(batch: dict):
        gain = np.array(held, np.int64)
        ids = [np.frombuffer(r, "<u2") for r in batch["runs"]]
        yield {"doc_id": batch["doc_id"], "n_words": batch["n_words"], "n_features": [len(r) for r in ids], "weight": [int(gain[r].sum()) for r in ids]}

    scored = map_batches(runs, weigh, "doc_id long, n_words long, n_features long, weight long")
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("able", F.col("n_words") >= least_words)
    order = [F.desc("able"), F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    ranked = with_global_rank(scored, order, "place")
    drawn = (ranked.where("able").count() * percent) // 100
    rank = F.when(F.col("able") & (F.col("place") < drawn), F.col("place") + 1)
    return ranked.select("doc_id", "n_features", "weight", "score", rank.cast("long").alias("rank"))
