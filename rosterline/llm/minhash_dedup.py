"""Near-duplicate texts: an inverted join of MinHash signature coordinates, then exact word-shingle sets."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterline.llm.common import Forest, binary_matrix, columns_as, group_ends, map_batches, map_groups, process_object, row_pairs, store, with_block_pairs
from rosterline.llm.components import components


@dataclass(frozen=True)
class Matching:
    """Words per shingle, the similarity as a fraction, and how signatures are matched.

    A pair of similarity s agrees in each coordinate with probability s. ``least`` is 3.8 standard deviations below
    the expected number of agreements at the threshold; pairs that reach it must agree in one of the first
    ``prefix`` coordinates, so only those are posted. The expected loss at the threshold itself is about one in 5,000.
    """

    words: int = 5
    numerator: int = 80
    denominator: int = 100
    coordinates: int = 48
    #: Documents of one posting list, and of one cluster, that meet in a task; larger ones are compared block by block.
    posting_block: int = 1000
    set_block: int = 100

    @property
    def least(self) -> int:
        s = self.numerator / self.denominator
        return max(1, math.floor(self.coordinates * s - 3.8 * math.sqrt(self.coordinates * s * (1 - s))))

    @property
    def prefix(self) -> int:
        return self.coordinates - self.least + 1


#: Word hashes kept per process; beyond them a word is hashed each time.
CACHE = 200_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE and len(word) < 60:
            self[word] = value
        return value


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles (A-Z lower-cased; fewer words: the whole sequence as one)."""
    cache = process_object("shingle words", _Words, grows=True)
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(cache.__getitem__, parts), np.uint64, len(parts))
    span = min(words, len(parts))
    n = len(parts) - span + 1
    out = np.full(n, span, np.uint64)
    for k in range(span):
        out = (out ^ hashed[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def _coordinates(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(1, 1 << 63, n, dtype=np.uint64)


def signature(hashes: np.ndarray, n: int) -> np.ndarray:
    """The smallest 32-bit hash of the set in each of ``n`` coordinates."""
    factor, shift = _coordinates(n)
    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        low = np.minimum(low, (hashes[at : at + 2048, None] * factor + shift).min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32)


def near_duplicates(docs: DataFrame, matching: Matching = Matching(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per input row.

    Linked are documents whose shingle sets reach the similarity; a component's id is its smallest ``doc_id``. Equal sets
    are folded first. Each folded document is posted under its first coordinates; documents of a list are matched in
    blocks inside tasks on all coordinates and send a spanning forest. The clusters found this way are then checked on
    their full sets, again in blocks that send forests, so no task holds a whole group and no pair table exists.
    Null, empty and blank texts have no shingles and link with nothing, nor do rows with a null id; repeated ids
    share a component if their texts link. An empty table gives no rows.
    """
    words, size = matching.words, matching.coordinates
    plain = columns_as(docs, doc_id=doc_id, text=text)
    plain = plain.withColumn("doc_id", F.col("doc_id").cast("long"))

    def sketch(batch: dict):
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_shingles", "digest", "sig")}
        for doc, content in zip(batch["doc_id"], batch["text"]):
            hashes = shingle_set(content, words)
            out["doc_id"].append(doc)
            out["n_shingles"].append(len(hashes))
            out["digest"].append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
            out["sig"].append(signature(hashes, size).tobytes() if len(hashes) else None)
        yield out

    sketches = store(map_batches(plain, sketch, "doc_id long, n_shingles long, digest binary, sig binary"))
    folded = sketches.where("digest is not null and doc_id is not null").groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    folded = store(folded)

    def postings(batch: dict):
        sigs = np.frombuffer(b"".join(batch["sig"]), np.uint32).reshape(-1, size)
        rep, n = np.array(batch["rep"], np.int64), np.array(batch["n"], np.int64)
        short = sigs.astype(np.uint8)  # one byte a coordinate is enough to match; the sets decide
        for k in range(matching.prefix):
            key = (np.int64(k) << 32) | sigs[:, k].astype(np.int64)
            yield {"key": key, "rep": rep, "n": n, "short": [s.tobytes() for s in short]}

    posted = map_batches(folded, postings, "key long, rep long, n long, short binary")
    sizes = posted.groupBy("key").agg(F.count("rep").alias("size")).where("size > 1")
    lists = with_block_pairs(posted.join(sizes, "key"), F.col("size"), matching.posting_block, F.col("rep"))

    def match(table: pa.Table):
        column = lambda name: table.column(name).to_numpy()
        key, bi, bj, rep, n = (column(c) for c in ("key", "bi", "bj", "rep", "n"))
        short = binary_matrix(table.column("short"), np.uint8, size)
        forest, a, b = Forest(len(rep)), [], []
        for i, j in row_pairs(group_ends(key, bi, bj), column("side"), bi != bj, 1 << 15):
            low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            use = low * matching.denominator >= high * matching.numerator
            i, j = forest.apart(i[use], j[use])
            use = np.count_nonzero(short[i] == short[j], axis=1) >= matching.least
            for x, y in zip(i[use].tolist(), j[use].tolist()):
                if forest.join(x, y):
                    a.append(rep[x])
                    b.append(rep[y])
        yield {"a": a, "b": b}

    matched = map_groups(lists.select("key", "bi", "bj", "side", "rep", "n", "short"), ["key", "bi", "bj"], match, "a long, b long")
    clusters = store(components(matched))
    # Sets of clustered documents only; the ids of the texts whose set stands for all equal ones.
    wanted = clusters.select(F.col("node").alias("doc_id"), "root")
    # Alike at every size: texts meet the cluster list by a sort-merge join, once.
    full = plain.where("doc_id is not null").join(wanted.hint("merge"), "doc_id").select("doc_id", "root", "text")

    def sets(batch: dict):
        hashed = [shingle_set(t, words) for t in batch["text"]]
        sigs = [signature(h, size).astype(np.uint8).tobytes() if len(h) else bytes(size) for h in hashed]
        yield {"rep": batch["doc_id"], "root": batch["root"], "hashes": [h.tobytes() for h in hashed], "short": sigs}

    members = map_batches(full, sets, "rep long, root long, hashes binary, short binary")
    many = clusters.groupBy("root").agg(F.count("node").alias("size"))
    blocks = with_block_pairs(members.join(many, "root"), F.col("size"), matching.set_block, F.col("rep"))

    def confirm(table: pa.Table):
        column = lambda name: table.column(name).to_numpy()
        root, bi, bj, rep = (column(c) for c in ("root", "bi", "bj", "rep"))
        short = binary_matrix(table.column("short"), np.uint8, size)
        hashes = [np.frombuffer(h, np.uint64) for h in table.column("hashes").to_pylist()]
        n = np.array([len(h) for h in hashes], np.int64)
        forest, a, b = Forest(len(rep)), [], []
        for i, j in row_pairs(group_ends(root, bi, bj), column("side"), bi != bj, 1 << 15):
            low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            use = (low * matching.denominator >= high * matching.numerator) & (low > 0)
            i, j = forest.apart(i[use], j[use])
            use = np.count_nonzero(short[i] == short[j], axis=1) >= matching.least
            for x, y in zip(i[use].tolist(), j[use].tolist()):
                if forest.root(x) == forest.root(y):
                    continue
                both = len(np.intersect1d(hashes[x], hashes[y], assume_unique=True))
                if matching.denominator * both >= matching.numerator * (n[x] + n[y] - both):
                    forest.join(x, y)
                    a.append(rep[x])
                    b.append(rep[y])
        yield {"a": a, "b": b}

    linked = map_groups(blocks.select("root", "bi", "bj", "side", "rep", "hashes", "short"), ["root", "bi", "bj"], confirm, "a long, b long")
    roots = components(linked)
    by_set = folded.select("digest", "rep").join(roots, F.col("rep") == F.col("node"), "left").select(
        "digest", F.coalesce("root", "rep").alias("component"))
    own = sketches.drop("sig").withColumn("linked", F.when(F.col("doc_id").isNotNull(), F.col("digest")))
    out = own.join(by_set, F.col("linked") == by_set["digest"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
