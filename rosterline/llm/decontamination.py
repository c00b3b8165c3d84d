"""Benchmark decontamination: latent semantic retrieval of passages, and of verbatim pieces of items, then longest common
subsequence and answer checks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterline.llm.common import columns_as, map_batches, process_object

#: Texts are read in parts of about so many characters, cut at white space.
PART = 1 << 20
SPACE = re.compile(r"\s")
#: Short texts are read together, up to so many characters.
TOGETHER = 1 << 15


@dataclass(frozen=True)
class Retrieval:
    """Words are hashed to ``features``, which bounds every table that is broadcast. Documents are read in windows of
    three strides of ``stride`` words; windows whose cosine to an item in the latent space reaches ``cosine`` are compared
    word by word: the longest common subsequence must hold ``common`` of the item's words and ``answer`` of its answer's,
    where it has one. So are the places of any of an item's pieces (see ``pieces``), whatever their cosine."""

    features: int = 1 << 14
    #: Least rank of a block's latent space, and how many items share a direction where that is more.
    rank: int = 64
    items_a_direction: int = 8
    oversampling: int = 32
    stride: int = 16
    cosine: float = 0.5
    #: Share of an item's own length in its latent direction that a window must reach (of what its words can hold).
    coverage: float = 0.45
    common: float = 0.7
    answer: float = 0.5
    #: Items compared with a window at a time.
    block: int = 4096

    def rank_of(self, items: int) -> int:
        return max(self.rank, -(-items // self.items_a_direction))


#: An odd multiplier and its inverse among 64-bit numbers.
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)
#: The multiplier of numbers that are mixed.
TURN = np.uint64(STEP)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For 16-bit characters 0 (white space), 1 (mark) or 2 (in a word); powers of the multiplier and of its inverse."""
    kind = np.array([0 if chr(c).isspace() else 2 if chr(c).isalnum() or c == 95 else 1 for c in range(1 << 16)], np.uint8)
    return kind, _powers(STEP, PART // 16), _powers(BACK, PART // 16)


def _read_part(low: str, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table, powers, inverse = process_object("decontamination tables", _tables)
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    high = codes >= 1 << 16
    kind = table[np.where(high, 0, codes)]
    if high.any():
        kind[high] = [2 if chr(c).isalnum() else 1 for c in codes[high].tolist()]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], kind > 0, [False]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    solid = np.append(np.flatnonzero(kind == 2), len(codes))
    first, last = np.searchsorted(solid, starts), np.searchsorted(solid, ends) - 1
    some = first <= last
    starts, ends = np.where(some, solid[first], starts), np.where(some, solid[np.maximum(last, 0)] + 1, starts)
    if not len(starts):
        return np.zeros(0, np.int64), starts, ends
    if len(codes) > len(powers):
        powers, inverse = _powers(STEP, len(codes)), _powers(BACK, len(codes))
    # A word's number is the sum of its characters, each times the power of its place in the word.
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + np.uint32(1)) * powers[: len(codes)])])
    number = (sums[ends] - sums[starts]) * inverse[starts]
    number = (number ^ (number >> np.uint64(29))) * TURN
    return ((number >> np.uint64(32)) % np.uint64(n)).astype(np.int64), starts, ends


@dataclass(frozen=True)
class Words:
    """The words of a text: lower-cased, between white space, without marks at their edges; each one's feature and place."""

    low: str
    features: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, text: str | None, n: int) -> Words:
        low, parts, at = text.lower() if text else "", [], 0
        while at < len(low):
            gap = SPACE.search(low, at + PART) if len(low) - at > PART else None
            end = gap.end() if gap else len(low)
            features, starts, ends = _read_part(low[at:end], n)
            parts.append((features, starts + at, ends + at))
            at = end
        return cls(low, *(np.concatenate(p) for p in zip(*parts))) if parts else cls(low, *[np.zeros(0, np.int64)] * 3)

    def __len__(self) -> int:
        return len(self.features)

    def between(self, lo: int, hi: int) -> list[str]:
        return [self.low[a:b] for a, b in zip(self.starts[lo:hi].tolist(), self.ends[lo:hi].tolist())]


def words_of_texts(texts: list[str | None], n: int) -> Iterator[Words]:
    """``Words.of`` each text, in order; neighbouring short texts are read in one pass, with white space between them."""
    lows: list[str] = []
    size = 0

    def held() -> Iterator[Words]:
        low = "\n".join(lows)
        features, starts, ends = _read_part(low, n)
        edges = np.cumsum([0] + [len(t) + 1 for t in lows])
        at = np.searchsorted(starts, edges).tolist()
        for a, b in zip(at, at[1:]):
            yield Words(low, features[a:b], starts[a:b], ends[a:b])

    for text in texts:
        low = text.lower() if text else ""
        if lows and size + len(low) > TOGETHER:
            yield from held()
            lows, size = [], 0
        if len(low) > TOGETHER:
            yield Words.of(text, n)
        else:
            lows.append(low)
            size += len(low) + 1
    if lows:
        yield from held()


def inverse_frequencies(docs: DataFrame, retrieval: Retrieval) -> np.ndarray:
    """Logarithmic inverse document frequency of each feature over all documents; one row per batch and feature is sent."""
    n = retrieval.features

    def run(batch: dict):
        seen, rows = np.zeros(n, np.int64), 0
        for words in words_of_texts(batch["text"], n):
            rows += 1
            seen[np.unique(words.features)] += 1
        has = np.flatnonzero(seen)
        yield {"feature": np.append(has, -1), "n": np.append(seen[has], rows)}

    counts = map_batches(docs.select("text"), run, "feature int, n long", rows=10_000).groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    out, total = np.zeros(n), 0
    for f, c in zip(counts.column("feature").to_pylist(), counts.column("n").to_pylist()):
        if f < 0:
            total = c
        else:
            out[f] = c
    # Positive for every feature: a passage that most documents hold must be found like any other.
    return np.log(1 + (1 + total) / (1 + out))


def _vectors(texts: list[Words], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse TF-IDF rows of unit length (features, values); no words: no features."""
    out = []
    for words in texts:
        ids, counts = np.unique(words.features, return_counts=True)
        values = (1 + np.log(np.maximum(counts, 1))) * idf[ids]
        out.append((ids, values / max(np.sqrt((values**2).sum()), 1e-12)))
    return out


def latent_space(vectors: list[tuple[np.ndarray, np.ndarray]], retrieval: Retrieval) -> np.ndarray:
    """Right singular vectors (features x rank) of a block's TF-IDF matrix by randomised SVD; the rank grows with its items."""
    n, rank = retrieval.features, retrieval.rank_of(len(vectors))
    vectors = [(ids, v.astype(np.float32)) for ids, v in vectors if len(ids)]
    width = min(rank + retrieval.oversampling, n)
    basis = np.random.default_rng(5).standard_normal((n, width)).astype(np.float32)

    def times(basis: np.ndarray) -> np.ndarray:
        return np.stack([v @ basis[ids] for ids, v in vectors]) if vectors else np.zeros((0, width), np.float32)

    for _ in range(2):
        y = times(basis)
        basis = np.zeros((n, width), np.float32)
        for (ids, v), row in zip(vectors, y):
            basis[ids] += v[:, None] * row
        basis = np.linalg.qr(basis)[0].astype(np.float32)
    y = times(basis).astype(np.float64)
    values, turn = np.linalg.eigh(y.T @ y)
    keep = np.argsort(-values)[:rank]
    keep = keep[values[keep] > 1e-9]
    return (basis @ turn[:, keep]).astype(np.float32)


#: Bits of the table that most places of a text are refused by.
SIEVE = 20


def piece_numbers(hashed: np.ndarray, size: int) -> np.ndarray:
    """A number for the ``size`` words from each place on."""
    most = len(hashed) - size + 1
    out = np.zeros(max(most, 0), np.uint64)
    for k in range(size if most > 0 else 0):
        out = (out + hashed[k : k + most].astype(np.uint64) + np.uint64(1)) * TURN
        out ^= out >> np.uint64(29)
    return out


def piece_size(n: int) -> int:
    """Words in a piece of an item of ``n`` words: 5 of long ones, all of those below 4."""
    return min(n, max(3, min(5, n // 3)))


def pieces(hashed: list[np.ndarray]) -> dict[int, tuple[np.ndarray, dict[int, list[tuple[int, int]]]]]:
    """By size, the items' disjoint pieces: a sieve and ``number: [(item, offset)]``. A verbatim item has all of its pieces; so
    any item is found whose passage has fewer words changed than the item has pieces (the common words then decide)."""
    out: dict = {}
    for q, words in enumerate(hashed):
        if not len(words):
            continue
        size = piece_size(len(words))
        sieve, index = out.setdefault(size, (np.zeros(1 << SIEVE, bool), {}))
        numbers = piece_numbers(words, size)
        for offset in range(0, len(words) - size + 1, size):
            sieve[int(numbers[offset]) >> (64 - SIEVE)] = True
            index.setdefault(int(numbers[offset]), []).append((q, offset))
    return out


def piece_places(hashed: np.ndarray, held: dict) -> set[tuple[int, int]]:
    """``(item, start)`` of the items that pieces of a text point to; the start may lie before the text."""
    out = set()
    for size, (sieve, index) in held.items():
        numbers = piece_numbers(hashed, size)
        for at in np.flatnonzero(sieve[numbers >> np.uint64(64 - SIEVE)]).tolist():
            for q, offset in index.get(int(numbers[at]), ()):
                out.add((q, at - offset))
    return out


def places(words: list) -> dict:
    """Where each word stands in an item, as bits."""
    where: dict = {}
    for k, w in enumerate(words):
        where[w] = where.get(w, 0) | 1 << k
    return where


def common_words(where: dict, n: int, words: list) -> int:
    """Length of the longest common subsequence of ``words`` and an item of ``n`` words at these places, bit-parallel."""
    full = v = (1 << n) - 1
    for m in filter(None, map(where.get, words)):
        u = v & m
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def contaminated(docs: DataFrame, benchmark: DataFrame, retrieval: Retrieval = Retrieval(), doc_id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text", answer: str | None = None) -> DataFrame:
    """``(doc_id, item_id, cosine, common, answer)``: each document with each item it holds, best window first.

    All windows of all whole texts are searched against all items (the stated query set, in blocks). Null or empty texts
    and items without words match nothing; a null id is kept as such; repeated rows and items give one row per pair of ids;
    empty tables give no rows. ``answer`` names a column of the benchmark; without it, and for items without an answer, the
    common words alone decide and ``answer`` is null.
    """
    plain = columns_as(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    columns = {"item_id": item_id, "text": item_text} | ({"answer": answer} if answer else {})
    items = columns_as(benchmark, **columns).withColumn("item_id", F.col("item_id").cast("long"))
    idf = inverse_frequencies(plain, retrieval)
    context = docs.sparkSession.sparkContext
    found = None
    rows = items.orderBy("item_id", "text").toLocalIterator()  # the query set, a block at a time
    for block in _blocks(rows, retrieval.block):
        queries, weighted = _queries(block, idf, retrieval)
        part = _search(plain, context.broadcast(queries), context.broadcast(weighted), retrieval)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return _search(plain.where("false"), None, None, retrieval)
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("common", "answer", "cosine")).alias("b")).select(
        "doc_id", "item_id", "b.cosine", "b.common", "b.answer")


def _blocks(rows, size: int):
    block = []
    for r in rows:
        block.append(r)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def _queries(block, idf, retrieval: Retrieval):
    read = [Words.of(r.text, retrieval.features) for r in block]
    vectors = _vectors(read, idf)
    space = latent_space(vectors, retrieval)
    latent = np.stack([v @ space[i] if len(i) else np.zeros(space.shape[1]) for i, v in vectors])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    table = space * idf[:, None]
    own = np.array([(table[w.features].sum(axis=0) * v).sum() for w, v in zip(read, latent)])
    needed = own * retrieval.coverage * np.minimum(1, 2.5 * retrieval.stride / np.maximum([len(w) for w in read], 1))
    answers = [_all(Words.of(r.answer, retrieval.features)) if "answer" in r else [] for r in block]
    hashed = [w.features for w in read]
    queries = ([r.item_id for r in block], [places(h.tolist()) for h in hashed], [_all(w) for w in read], answers, latent.astype(np.float32),
               np.maximum(needed, 1e-6).astype(np.float32), pieces(hashed))
    return queries, table.astype(np.float32)


def _all(words: Words) -> list[str]:
    return words.between(0, len(words))


def _cosine(table: np.ndarray, hashed: np.ndarray, latent: np.ndarray) -> float:
    window = table[hashed].sum(axis=0)
    return float(window @ latent / max(np.linalg.norm(window), 1e-12))


def _search(docs: DataFrame, queries, weighted, retrieval: Retrieval) -> DataFrame:
    n, stride = retrieval.features, retrieval.stride

    def run(batch: dict):
        ids, quick, items, answers, latent, needed, held = queries.value
        table = weighted.value
        out: dict[str, list] = {k: [] for k in ("doc_id", "item_id", "cosine", "common", "answer")}
        live = (table != 0).any(axis=1)

        def compare(q: int, lo: int, hi: int, cosine) -> None:
            """Keep item ``q`` if these words hold it, and better than before."""
            item, where, window = items[q], quick[q], hashed[lo:hi].tolist()
            # Features agree wherever words do; no more words are common than the item has of those that stand here.
            if sum(where[f].bit_count() for f in where.keys() & window) < retrieval.common * len(item):
                return
            if common_words(where, len(item), window) < retrieval.common * len(item):
                return
            piece = words.between(lo, hi)
            common = common_words(places(item), len(item), piece) / len(item)
            if common >= retrieval.common and common > best.get(q, (0,))[0]:
                told = common_words(places(answers[q]), len(answers[q]), piece) / len(answers[q]) if answers[q] else None
                if told is None or told >= retrieval.answer:
                    best[q] = (common, told, cosine(lo, hi) if callable(cosine) else cosine)

        for doc, words in zip(batch["doc_id"], words_of_texts(batch["text"], n)):
            if not len(words):
                continue
            hashed = words.features
            best: dict[int, tuple] = {}
            for q, start in piece_places(hashed, held):
                reach = max(len(items[q]) // 2, stride)
                compare(q, max(0, start - reach), start + len(items[q]) + reach, lambda lo, hi, q=q: _cosine(table, hashed[lo:hi], latent[q]))
            # Words that no item has have no place in the latent space and are passed over.
            telling = np.flatnonzero(live[hashed])
            for base in range(0, len(words), stride * 2048):  # long texts in parts that overlap by two strides
                most = min(len(words), base + stride * 2050)
                part = telling[np.searchsorted(telling, base) : np.searchsorted(telling, most)]
                if not len(part):
                    continue
                cell, first = np.unique((part - base) // stride, return_index=True)
                sums = np.zeros((-(-(most - base) // stride), table.shape[1]), np.float32)
                sums[cell] = np.add.reduceat(table[hashed[part]], first, axis=0)
                windows = sums.copy()
                windows[:-1] += sums[1:]
                windows[:-2] += sums[2:]
                length = np.maximum(np.linalg.norm(windows, axis=1), 1e-12)
                along = windows @ latent.T
                near = np.argwhere((along >= retrieval.cosine * length[:, None]) & (along >= needed))
                for w, q in near.tolist():
                    if items[q] and best.get(q, (0,))[0] < 1:
                        at, reach = base + w * stride, max(len(items[q]) - stride, stride)
                        compare(q, max(0, at - reach), at + 3 * stride + reach, float(along[w, q] / length[w]))
            for q, (common, told, c) in best.items():
                for name, value in zip(out, (doc, ids[q], c, common, told)):
                    out[name].append(value)
        yield out

    return map_batches(docs, run, "doc_id long, item_id long, cosine double, common double, answer double")
