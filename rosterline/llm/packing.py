"""Best-fit packing under several capacities: tokens, documents and attention cost of a sequence."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterline.llm.common import columns_as, group_ends, map_batches, map_groups, store
from rosterline.llm.wordbpe import encoder


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most; the cost of a piece is its length squared. ``weights`` are those of the three."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    #: "norm": the bin whose weighted residual vector is shortest afterwards; "dot": the largest weighted dot product.
    rule: str = "norm"

    @property
    def piece(self) -> int:
        """The longest piece that an empty sequence takes."""
        return min(self.tokens, math.isqrt(self.attention))


def pieces(docs: DataFrame, tokenizer: str, capacity: Capacity, doc_id: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: every text's ids plus the end id, cut only where too long for a sequence."""
    most = capacity.piece

    def run(batch: dict):
        encode, end = encoder(tokenizer), np.array([end_id], "<u4")
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for doc, content in zip(batch["doc_id"], batch["text"]):
            ids = np.concatenate([encode(content), end])
            for k, start in enumerate(range(0, len(ids), most)):
                part = ids[start : start + most]
                for name, value in zip(out, (doc, k, start, len(part), zlib.crc32(part.tobytes()))):
                    out[name].append(value)
        yield out

    return map_batches(columns_as(docs, doc_id=doc_id, text=text), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, longest first; ties go to the oldest bin, so the result depends on the order alone."""
    full = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    weight = np.array(capacity.weights) / full**2
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    least = int(lengths.min()) if len(lengths) else 0
    left, names, count = np.empty((64, 3)), np.empty(64, np.int64), 0  # open bins, oldest first
    made = 0
    for at in order:
        need = np.array([lengths[at], 1.0, float(lengths[at]) ** 2])
        best = -1
        if count:
            rest = left[:count] - need
            fits = (rest >= 0).all(axis=1)
            if fits.any():
                score = (rest**2 * weight).sum(axis=1) if capacity.rule == "norm" else -(left[:count] * need * weight).sum(axis=1)
                best = int(np.where(fits, score, np.inf).argmin())
        if best < 0:
            if count == len(left):
                left, names = np.concatenate([left, np.empty_like(left)]), np.concatenate([names, np.empty_like(names)])
            best = count
            left[best], names[best] = full, made
            count, made = count + 1, made + 1
        bins[at], offsets[at] = names[best], capacity.tokens - left[best, 0]
        left[best] -= need
        if left[best, 0] < least or left[best, 1] < 1 or left[best, 2] < least**2:  # nothing fits any more
            left[best : count - 1], names[best : count - 1] = left[best + 1 : count], names[best + 1 : count]
            count -= 1
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, capacity: Capacity = Capacity(), group_sequences: int = 512,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack whole documents into sequences: pieces plus ``sequence_id`` and ``offset`` (gapless from 0).

    Pieces are dealt evenly to groups worth about ``group_sequences`` sequences; each group is packed in one task by
    decreasing vector best fit, so at most a part of one sequence per group stays open. Null texts are empty documents
    (the end id alone); repeated rows and null ids are packed like any others; an empty table gives no rows.
    """
    cut = store(pieces(docs, tokenizer, capacity, doc_id, text))
    total = cut.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / (group_sequences * capacity.tokens)))
    dealt = cut.withColumn("grp", F.pmod(F.monotonically_increasing_id(), F.lit(groups)))

    def run(table: pa.Table):
        grp, length = table.column("grp").to_numpy(), table.column("length").to_numpy()
        ends = group_ends(grp)
        bins, offsets = np.empty(len(grp), np.int64), np.empty(len(grp), np.int64)
        start = 0
        while start < len(grp):
            end = int(ends[start])
            bins[start:end], offsets[start:end] = best_fit(length[start:end], capacity)
            start = end
        out = {name: table.column(name).combine_chunks() for name in ("doc_id", "piece", "start", "length", "ids_crc32")}
        yield {k: v.chunk(0) if isinstance(v, pa.ChunkedArray) else v for k, v in out.items()} | {"sequence_id": (grp << 32) + bins, "offset": offsets}

    return map_groups(dealt, ["grp"], run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
