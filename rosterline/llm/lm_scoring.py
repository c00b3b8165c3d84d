"""Masked pseudo-likelihood: a bidirectional window network, trained in numpy over the whole corpus, scores documents."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import cached_property
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterline.llm.common import columns_as, map_batches, one_blas_thread, store


@dataclass(frozen=True)
class Network:
    """Each side's ``reach`` words go through an embedding and one hidden layer to the word's class; the word follows from
    its class by frequency. The ``own`` most frequent words are classes of their own, the others share classes by ending."""

    vocabulary: int = 4096
    own: int = 31
    shared: int = 32
    reach: int = 2
    width: int = 16
    hidden: int = 32
    #: Share of positions that are masked and learned in a pass, passes over the corpus, and the step size.
    masked: float = 0.15
    passes: int = 2
    rate: float = 0.5
    batch: int = 256

    @property
    def classes(self) -> int:
        return self.own + self.shared

    @property
    def shapes(self) -> list[tuple[int, ...]]:
        """Embedding (vocabulary, a row per shared class for rare words, and the text's edge), two layers."""
        return [(self.vocabulary + self.classes + 1, self.width), (2 * self.reach * self.width, self.hidden), (self.hidden,),
                (self.hidden, self.classes), (self.classes,)]

    def start(self) -> np.ndarray:
        rng = np.random.default_rng(17)
        return np.concatenate([(rng.standard_normal(s) * (0.1 if k == 0 else len(s) > 1 and s[0] ** -0.5)).ravel() for k, s in enumerate(self.shapes)]).astype(np.float32)

    @property
    def stored(self) -> type:
        """What the number of a row of the embedding is stored as."""
        return np.uint16 if self.shapes[0][0] <= 1 << 16 else np.int32

    def layers(self, flat: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for s in self.shapes:
            n = math.prod(s)
            out.append(flat[at : at + n].reshape(s))
            at += n
        return out


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, n)`` over all texts, lower-cased and split at white space; tasks send one row per batch and word."""
    def run(batch: dict):
        counts: Counter = Counter()
        counts.update(chain.from_iterable(words_of(batch["text"])))
        yield {"word": list(counts), "n": list(counts.values())}

    return map_batches(docs.select("text"), run, "word string, n long", rows=10_000).groupBy("word").agg(F.sum("n").alias("n"))


def spelling(counts: DataFrame) -> list[float]:
    """Smoothed log-probabilities of each byte in the words of a table, each word once, and of a word's end."""

    def run(batch: dict):
        found = np.bincount(np.frombuffer("".join(batch["word"]).encode("utf-8"), np.uint8), minlength=257)
        found[256] = len(batch["word"])
        yield {"byte": np.arange(257), "n": found}

    total = np.ones(257)
    for r in map_batches(counts.select("word"), run, "byte int, n long", rows=10_000).groupBy("byte").agg(F.sum("n").alias("n")).collect():
        total[r.byte] += r.n
    return np.log(total / total.sum()).tolist()


@dataclass
class Lexicon:
    """Of each frequent word its row, class and log-probability within the class; of each class that of one count.

    Every other word of the corpus has its own count in ``counts``, a table that is joined to the tokens at scoring. Of a class
    one count more than seen is left to all unseen words together, divided by their spelling: ``spelling`` holds the
    log-probabilities of the bytes in the corpus's words and, last, of a word's end.
    """

    words: dict[str, tuple[int, int, float]]
    rare: list[float]
    net: Network
    counts: DataFrame | None = None
    spelling: list[float] | None = None

    @classmethod
    def fit(cls, docs: DataFrame, net: Network) -> Lexicon:
        counts = store(word_counts(docs))
        top = counts.orderBy(F.desc("n"), "word").limit(net.vocabulary).collect()  # the model's vocabulary: a fixed size
        lexicon = cls({}, [], net)
        by_word = {r.word: (k, lexicon.class_of(r.word) if k >= net.own else k, r.n) for k, r in enumerate(top)}
        ending = F.pmod(F.crc32(F.substring("word", -2, 2).cast("binary")), F.lit(net.shared)) + net.own
        total = {r.c: r.n for r in counts.groupBy(ending.alias("c")).agg(F.sum("n").alias("n")).collect()}
        for word, (k, _, n) in by_word.items():
            if k < net.own:
                total[lexicon.class_of(word)] -= n
        known = [0] * net.classes
        for _, c, n in by_word.values():
            known[c] += n
        # One count more than seen, for the unseen words, so that any word has a probability.
        mass = [max(total.get(c, 0), known[c]) + 1 if c >= net.own else known[c] for c in range(net.classes)]
        lexicon.words = {w: (k, c, math.log(n / mass[c])) for w, (k, c, n) in by_word.items()}
        lexicon.rare = [-math.log(mass[c]) if c >= net.own else 0.0 for c in range(net.classes)]
        lexicon.counts, lexicon.spelling = counts, spelling(counts)
        return lexicon

    def class_of(self, word: str) -> int:
        return self.net.own + zlib.crc32(word[-2:].encode()) % self.net.shared

    @cached_property
    def by_row(self) -> tuple[np.ndarray, np.ndarray]:
        """Class and within-class logarithm of every row of the embedding: frequent words, rare words by class, the edge."""
        net = self.net
        classes = np.full(net.vocabulary + net.classes + 1, -1, np.int32)
        logs = np.zeros(len(classes), np.float32)
        for row, c, log in self.words.values():
            classes[row], logs[row] = c, log
        classes[net.vocabulary : -1] = np.arange(net.classes)
        logs[net.vocabulary : -1] = self.rare
        return classes, logs

    def tokens(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows, classes and within-class logarithms of the words of all texts with edges between them, and each text's word count."""
        found, _, counts = self.found(texts)
        rows = _with_edges(found, counts, self.net)
        classes, logs = self.by_row
        return rows, classes[rows], logs[rows], counts

    def found(self, texts: list[list[str]]) -> tuple[np.ndarray, list[dict[str, int]], np.ndarray]:
        """The rows of all texts' words one after the other, and of each text the words without a row of their own, how often
        it has them, and its word count."""
        flat = list(chain.from_iterable(texts))
        found = np.fromiter(map(self.row_of.get, flat, repeat(-1)), np.int32, len(flat))
        counts = np.array([len(words) for words in texts], np.int64)
        at, ends = np.flatnonzero(found < 0), _Endings(self)
        rare = [flat[i] for i in at.tolist()]
        found[at] = [ends[w[-2:]] for w in rare]
        cuts = np.searchsorted(at, np.concatenate([[0], np.cumsum(counts)])).tolist()
        return found, [Counter(rare[lo:hi]) for lo, hi in zip(cuts, cuts[1:])], counts

    @cached_property
    def row_of(self) -> dict[str, int]:
        return {word: row for word, (row, _, _) in self.words.items()}


class _Endings(dict):
    """Rows of rare words by their last two letters."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, ending: str) -> int:
        row = self[ending] = self.lexicon.net.vocabulary + self.lexicon.class_of(ending)
        return row


def words_of(texts: list[str | None]) -> list[list[str]]:
    """Lower-cased words between white space; a null text has none."""
    return [t.lower().split() if t else [] for t in texts]


def _with_edges(found: np.ndarray, counts: np.ndarray, net: Network) -> np.ndarray:
    """The rows of texts of so many words, as many edges before, between and after them as the network reaches."""
    rows = np.full(len(found) + net.reach * (len(counts) + 1), net.vocabulary + net.classes, np.int32)
    # Each text lies behind as many gaps as there are texts up to it.
    rows[np.arange(len(found)) + np.repeat(net.reach * np.arange(1, len(counts) + 1), counts)] = found
    return rows


def _read_rows(binaries: list[bytes], net: Network) -> tuple[np.ndarray, np.ndarray]:
    """The rows of stored documents with edges between them, and their word counts."""
    counts = np.array([len(b) for b in binaries], np.int64) // np.dtype(net.stored).itemsize
    return _with_edges(np.frombuffer(b"".join(binaries), net.stored), counts, net), counts


def _sides(rows: np.ndarray, at: np.ndarray, reach: int) -> np.ndarray:
    return np.stack([rows[at + d] for d in range(-reach, reach + 1) if d], axis=1)


def _centred(z: np.ndarray) -> np.ndarray:
    """Logits less one number per row, in place, so that exponentials neither overflow nor all vanish: the same for all rows
    where they lie close together, else each row's largest."""
    most = z.max() if len(z) else 0.0
    z -= most if len(z) and most - z.min() < 80 else z.max(axis=1, keepdims=True)
    return z


def learn(layers: list[np.ndarray], rows: np.ndarray, classes: np.ndarray, at: np.ndarray, net: Network) -> None:
    """Stochastic gradient steps, in place, on the masked positions ``at``."""
    table, w1, b1, w2, b2 = layers
    ones = np.ones(net.classes, np.float32)
    for lo in range(0, len(at), net.batch):
        part = at[lo : lo + net.batch]
        sides = _sides(rows, part, net.reach)
        x = table[sides].reshape(len(part), -1)
        h = np.maximum(x @ w1 + b1, 0)
        p = np.exp(_centred(h @ w2 + b2))
        p /= (p @ ones)[:, None]
        p[np.arange(len(part)), classes[part]] -= 1
        p *= net.rate / len(part)
        back = (p @ w2.T) * (h > 0)
        into = (back @ w1.T).reshape(-1, net.width)
        w2 -= h.T @ p
        b2 -= p.sum(axis=0)
        w1 -= x.T @ back
        b1 -= back.sum(axis=0)
        # An embedding is met by few positions of a batch, so its step is that of a small batch.
        order = np.argsort(flat := sides.ravel())
        first = np.flatnonzero(np.diff(flat[order], prepend=-1))
        table[flat[order[first]]] -= np.add.reduceat(into[order], first, axis=0) * np.float32(0.1 * net.batch)


def conditional_logs(layers: list[np.ndarray], rows: np.ndarray, classes: np.ndarray, logs: np.ndarray, net: Network) -> np.ndarray:
    """log P(token | both sides) of every token; 0 at edges."""
    table, w1, b1, w2, b2 = layers
    at = np.flatnonzero(classes >= 0)
    out = np.zeros(len(rows), np.float64)
    ones = np.ones(net.classes, np.float32)
    # What a word at one place adds to the hidden layer is the same wherever it stands.
    places = [d for d in range(-net.reach, net.reach + 1) if d]
    added = [table @ w1[k * net.width : (k + 1) * net.width] for k in range(len(places))]
    added[0] = added[0] + b1
    for lo in range(0, len(at), 1024):
        part = at[lo : lo + 1024]
        h = added[0].take(rows[part + places[0]], axis=0)
        for d, one in zip(places[1:], added[1:]):
            h += one.take(rows[part + d], axis=0)
        np.maximum(h, 0, out=h)
        z = h @ w2
        z += b2
        _centred(z)
        own = z[np.arange(len(part)), classes[part]]
        out[part] = own - np.log(np.exp(z, out=z) @ ones) + logs[part]
    return out


@dataclass
class Corpus:
    """Documents split into words once, for learning and scoring: ``table`` holds of each ``(row, doc_id, rows, words, times)``,
    its number, its words' rows in the embedding, two or four bytes each, and its other words with their numbers."""

    lexicon: Lexicon
    table: DataFrame

    @classmethod
    def of(cls, docs: DataFrame, net: Network = Network(), doc_id: str = "doc_id", text: str = "text") -> Corpus:
        """Counts the words of all texts, then looks each of them up."""
        lexicon = Lexicon.fit(columns_as(docs, text=text), net)
        return cls(lexicon, looked_up(docs, lexicon, doc_id, text))


def looked_up(docs: DataFrame, lexicon: Lexicon, doc_id: str | None = "doc_id", text: str = "text") -> DataFrame:
    """The table of a ``Corpus``, stored, so that a row's number is the same in every read. Without ``doc_id`` it serves for
    learning only and leaves out the words that have no row of their own."""
    net = lexicon.net
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.words, lexicon.rare))

    def run(batch: dict):
        held = Lexicon(*shared.value, net)
        for lo in range(0, len(batch["text"]), 500):
            found, rare, counts = held.found(words_of(batch["text"][lo : lo + 500]))
            binary, ends = found.astype(net.stored), np.cumsum(counts).tolist()
            ids = batch.get("doc_id", [None] * len(batch["text"]))[lo : lo + 500]
            if doc_id is None:
                rare = [{}] * len(rare)
            yield {"doc_id": ids, "rows": [binary[a:b].tobytes() for a, b in zip([0, *ends], ends)],
                   "words": [list(r) for r in rare], "times": [list(r.values()) for r in rare]}

    plain = columns_as(docs, text=text)
    if doc_id is not None:
        plain = columns_as(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    found = map_batches(plain, run, "doc_id long, rows binary, words array<string>, times array<int>")
    return store(found.withColumn("row", F.monotonically_increasing_id()))


def train(docs: DataFrame | Corpus, net: Network = Network()) -> tuple[Lexicon, np.ndarray]:
    """Lexicon and weights. In each pass every task learns from the masked positions of its own documents, starting from the
    common weights; the weights are then averaged, by numbers of positions, in one aggregate by weight index.
    A corpus brings its own lexicon and network."""
    if isinstance(docs, Corpus):
        lexicon, table = docs.lexicon, docs.table
    else:
        lexicon = Lexicon.fit(columns_as(docs, text="text"), net)
        table = looked_up(docs, lexicon, None)
    net, flat = lexicon.net, lexicon.net.start()
    context = table.sparkSession.sparkContext
    for step in range(net.passes):
        shared = context.broadcast((lexicon.by_row[0], flat))

        def run(batches, step=step):
            one_blas_thread()
            class_of, start = shared.value
            own, seen = start.astype(np.float32).copy(), 0
            layers = net.layers(own)
            for batch in (b.slice(lo, 500) for b in batches for lo in range(0, b.num_rows, 500)):
                rows, _ = _read_rows(batch.column(0).to_pylist(), net)
                classes = class_of[rows]
                at = np.flatnonzero(classes >= 0)
                rng = np.random.default_rng([step, len(at)])
                at = at[rng.random(len(at)) < net.masked]
                rng.shuffle(at)
                learn(layers, rows, classes, at, net)
                seen += len(at)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own), dtype=np.int32)), pa.array(own.astype(np.float64) * seen), pa.array(np.full(len(own), seen, np.int64))], names=["i", "v", "n"])

        sums = table.select("rows").mapInArrow(run, "i int, v double, n long").groupBy("i").agg((F.sum("v") / F.sum("n")).alias("v")).toArrow()
        if sums.num_rows:
            flat = np.empty(len(flat), np.float32)
            flat[sums.column("i").to_numpy()] = sums.column("v").to_numpy()
    return lexicon, flat


def score(docs: DataFrame | Corpus, lexicon: Lexicon, flat: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, pseudo_log_likelihood, per_token)``, one row per input row: each token of the whole text given
    both its sides. Texts without words (null, empty, blank) have 0 tokens, a sum of 0 and no mean; repeated rows get
    equal scores; an empty table gives no rows. A corpus is scored by its own lexicon.

    What the network and the frequent words say is summed in each text's task; the text's other words go, once each, to the
    table of counts. Such a word, at most as frequent as the frequent ones, is no hot key of that join.
    """
    if isinstance(docs, Corpus) and docs.lexicon is not lexicon:
        raise ValueError("the corpus was looked up in another lexicon")
    table = docs.table if isinstance(docs, Corpus) else looked_up(docs, lexicon, doc_id, text)
    net = lexicon.net
    shared = table.sparkSession.sparkContext.broadcast((*lexicon.by_row, flat))

    def run(batch: dict):
        class_of, log_of, weights = shared.value
        layers = net.layers(weights)
        for lo in range(0, len(batch["rows"]), 500):
            rows, counts = _read_rows(batch["rows"][lo : lo + 500], net)
            sums = np.concatenate([[0.0], np.cumsum(conditional_logs(layers, rows, class_of[rows], log_of[rows], net))])
            ends = net.reach + np.cumsum(counts + net.reach) - net.reach
            yield {"row": batch["row"][lo : lo + 500], "doc_id": batch["doc_id"][lo : lo + 500], "n_tokens": counts, "total": sums[ends] - sums[ends - counts]}

    base = store(map_batches(table.select("row", "doc_id", "rows"), run, "row long, doc_id long, n_tokens long, total double"))
    rare = table.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    spelled = F.aggregate(
        F.regexp_extract_all(F.hex(F.col("word").cast("binary")), F.lit("(..)")), F.lit(lexicon.spelling[256]),
        lambda a, b: a + F.element_at(F.array(*map(F.lit, lexicon.spelling[:256])), F.conv(b, 16, 10).cast("int") + 1))
    own = F.when(F.col("n").isNotNull(), F.log("n")).otherwise(spelled)
    more = rare.join(lexicon.counts.hint("merge"), "word", "left").groupBy("row").agg(F.sum(F.col("times") * own).alias("more"))
    out = base.select("row", "doc_id", "n_tokens", "total").join(more, "row", "left")
    out = out.withColumn("pseudo_log_likelihood", F.col("total") + F.coalesce("more", F.lit(0.0)))
    return out.select("doc_id", "n_tokens", "pseudo_log_likelihood", F.expr("if(n_tokens > 0, pseudo_log_likelihood / n_tokens, null)").alias("per_token"))
