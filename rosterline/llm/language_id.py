"""Language identification with interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterline.llm.common import map_batches, process_object, release_memory, store

ORDER = 4
#: Bits per symbol: 0 is any non-letter, 1 to 26 are a-z, other letters share the 37 classes above. A gram is the 24-bit
#: hash of its four symbols, so a language has at most 2^24 of them; this bounds what the driver and each worker hold.
BITS = 6
UNKNOWN = "und"
#: Batches of texts are cut at about so many characters for the counting and lookups.
CHARS = 1 << 18


def _symbols() -> np.ndarray:
    """Symbol of each 16-bit character; code points above them are looked up one by one where they occur."""
    table = np.zeros(1 << 16, np.uint32)
    for code in range(1 << 16):
        if chr(code).isalpha():
            low = ord(chr(code).lower()[0])
            table[code] = low - 96 if 97 <= low <= 122 else 27 + (low * 40503 >> 4) % 37
    return table


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Grams of the texts and where each text's begin. Runs of non-letters count as three at most; a text starts after three.

    A gram predicts its last symbol; non-letters after a non-letter aren't predicted.
    """
    table = process_object("language symbols", _symbols)
    joined = "\n\n\n" + "\n\n\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    if codes.max() >= 1 << 16:
        high = codes >= 1 << 16
        symbol = table[np.where(high, 0, codes)]
        symbol[high] = [27 + (c * 40503 >> 4) % 37 if chr(c).isalpha() else 0 for c in codes[high].tolist()]
    else:
        symbol = table[codes]
    zero = symbol == 0
    drop = np.zeros(len(symbol), bool)
    drop[3:] = zero[3:] & zero[2:-1] & zero[1:-2] & zero[:-3]
    starts = np.concatenate([[3], 3 + np.cumsum([len(t) + 3 for t in texts])[:-1]]).astype(np.int64)
    left = np.cumsum(~drop)
    symbol = symbol[~drop]
    starts = left[starts - 1]
    gram = (symbol[:-3] << 18) | (symbol[1:-2] << 12) | (symbol[2:-1] << 6) | symbol[3:]
    use = (symbol[3:] != 0) | (symbol[2:-1] != 0)
    counted = np.concatenate([[0], np.cumsum(use)])
    return gram[use], counted[np.minimum(np.maximum(starts - 3, 0), len(use))]


def _cut(texts: list[str]) -> list[tuple[int, int]]:
    out, at, size = [], 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= CHARS:
            out.append((at, k + 1))
            at, size = k + 1, 0
    return out + [(at, len(texts))] * (at < len(texts))


def gram_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """``(lang, gram, n)`` over all rows with a text and a language; tasks send one row per batch, language and gram."""
    known = docs.select(docs[text].alias("text"), docs[lang].cast("string").alias("lang")).where("text is not null and lang is not null")

    def run(batch: dict):
        by_lang: dict[str, list[str]] = {}
        for t, name in zip(batch["text"], batch["lang"]):
            by_lang.setdefault(name, []).append(t)
        for name, texts in by_lang.items():
            parts = [np.unique(grams(texts[lo:hi])[0], return_counts=True) for lo, hi in _cut(texts)]
            keys, row = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            counts = np.bincount(row, weights=np.concatenate([c for _, c in parts])).astype(np.int64)
            yield {"lang": [name] * len(keys), "gram": keys.astype(np.int64), "n": counts}

    return map_batches(known, run, "lang string, gram long, n long", rows=10_000).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class KneserNey:
    """Per order the sorted grams and contexts of all languages, with counts by language; order 4 also has its logarithms."""

    langs: list[str]
    keys: list[np.ndarray]
    counts: list[np.ndarray]
    contexts: list[np.ndarray]
    totals: list[np.ndarray]
    kinds: list[np.ndarray]
    discounts: list[np.ndarray]
    logs: np.ndarray | None = None

    @classmethod
    def fit(cls, lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> KneserNey:
        """From the 4-gram counts; lower orders count the distinct symbols before a gram, as Kneser-Ney asks."""
        langs = sorted(set(lang.tolist()))
        column = np.searchsorted(np.array(langs), lang) if langs else np.zeros(0, np.int64)
        keys, row = np.unique(gram, return_inverse=True)
        counts = np.zeros((len(keys), len(langs)))
        counts[row, column] = n
        model = cls(langs, [], [], [], [], [], [])
        for order in range(ORDER, 0, -1):
            once, twice = (counts == 1).sum(axis=0), (counts == 2).sum(axis=0)
            discount = np.where(once + twice > 0, once / np.maximum(once + 2 * twice, 1), 0.5)
            contexts, of = np.unique(keys >> BITS, return_inverse=True)
            totals, kinds = np.zeros((len(contexts), len(langs))), np.zeros((len(contexts), len(langs)))
            np.add.at(totals, of, counts)
            np.add.at(kinds, of, counts > 0)
            for where, value in ((model.keys, keys), (model.counts, counts), (model.contexts, contexts), (model.totals, totals),
                                 (model.kinds, kinds), (model.discounts, np.clip(discount, 0.05, 0.95))):
                where.insert(0, value)
            lower, of = np.unique(keys & ((1 << BITS * (order - 1)) - 1), return_inverse=True)
            before = np.zeros((len(lower), len(langs)))
            np.add.at(before, of, counts > 0)
            keys, counts = lower, before
        if langs:
            model.logs = np.log(model.probability(model.keys[-1])).astype(np.float32)
        return model

    def probability(self, gram: np.ndarray, order: int = ORDER) -> np.ndarray:
        """P(last symbol | the ones before) of each gram in each language."""
        if order == 0:
            return np.full((len(gram), len(self.langs)), 1 / (1 << BITS))
        lower = self.probability(gram & ((1 << BITS * (order - 1)) - 1), order - 1)

        def look(keys, values, at):
            where = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
            return np.where((keys[where] == at)[:, None], values[where], 0)

        k = order - 1
        count = look(self.keys[k], self.counts[k], gram)
        total = look(self.contexts[k], self.totals[k], gram >> BITS)
        kinds = look(self.contexts[k], self.kinds[k], gram >> BITS)
        d = self.discounts[k]
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(total > 0, (np.maximum(count - d, 0) + d * kinds * lower) / total, lower)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in nats per predicted symbol, by text and language, and the number of predicted symbols."""
        gram, starts = grams(texts)
        gram = gram.astype(np.int64)
        where = np.minimum(np.searchsorted(self.keys[-1], gram), len(self.keys[-1]) - 1)
        log = self.logs[where]
        missing = self.keys[-1][where] != gram
        if missing.any():
            rare, back = np.unique(gram[missing], return_inverse=True)
            log[missing] = np.log(self.probability(rare))[back]
        sums = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(log, axis=0, dtype=np.float64)])
        ends = np.concatenate([starts[1:], [len(gram)]])
        n = ends - starts
        return -(sums[ends] - sums[starts]) / np.maximum(n, 1)[:, None], n


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> KneserNey:
    """Fit one model per language on every row that has a text and a language."""
    table = gram_counts(docs, text, lang).toArrow()
    return KneserNey.fit(np.asarray(table.column("lang").to_pylist(), str), table.column("gram").to_numpy(), table.column("n").to_numpy())


def identify(docs: DataFrame, model: KneserNey, text: str = "text", sharpness: float = 20.0) -> DataFrame:
    """Input rows plus ``lang_pred``, ``score`` and ``lang_entropy``.

    The language of lowest cross-entropy per symbol over the whole text; ties go to the first name. ``score`` is its share
    when entropies are turned into odds. Null texts, texts without a letter, and any text under a model of no language are
    ``und`` with score 0 and no entropy. Only the text is sent to Python; other columns ride along untouched.
    """
    # Plain arrays: a broadcast class would have to be importable where the workers are.
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def one(held: KneserNey, texts: list[str]) -> list[tuple]:
        entropy, n = held.entropies(texts)
        best = entropy.argmin(axis=1)
        lowest = entropy[np.arange(len(best)), best]
        share = 1 / np.exp((lowest[:, None] - entropy) * sharpness).sum(axis=1)
        return [(held.langs[b], float(s), float(h)) if k else (UNKNOWN, 0.0, None) for b, s, h, k in zip(best, share, lowest, n)]

    @F.pandas_udf("struct<lang string, score double, entropy double>")
    def predict(texts):
        import pandas as pd

        plain = [t if t is not None else "" for t in texts]
        rows = [(UNKNOWN, 0.0, None)] * len(plain)
        held = KneserNey(**shared.value)
        if held.langs:
            rows = [r for lo, hi in _cut(plain) for r in one(held, plain[lo:hi])]
        release_memory()
        return pd.DataFrame(rows, columns=["lang", "score", "entropy"])

    own = [c for c in docs.columns if c not in ("lang_pred", "score", "lang_entropy")]
    out = docs.select(*own, predict(docs[text]).alias("_predicted"))
    return out.select(*own, F.col("_predicted.lang").alias("lang_pred"), F.col("_predicted.score").alias("score"),
                      F.col("_predicted.entropy").alias("lang_entropy"))


def with_rejection(predicted: DataFrame, deviations: float = 8.0, least_sd: float = 0.05) -> DataFrame:
    """``predicted`` (stored) plus ``rejected``: true without a language, or with an entropy further above the mean of the
    documents of that prediction than ``deviations`` standard deviations (each at least ``least_sd``); never null. An empty table gives none."""
    facts = predicted.where("lang_entropy is not null").groupBy(F.col("lang_pred").alias("_lang")).agg(
        (F.avg("lang_entropy") + deviations * F.greatest(F.stddev_pop("lang_entropy"), F.lit(least_sd))).alias("_most"))
    # A row per language of the model, which every task holds anyway.
    out = predicted.join(F.broadcast(facts), F.col("lang_pred") == F.col("_lang"), "left")
    rejected = (F.col("lang_pred") == UNKNOWN) | F.col("lang_entropy").isNull() | (F.col("lang_entropy") > F.col("_most"))
    return out.withColumn("rejected", F.coalesce(rejected, F.lit(True))).drop("_lang", "_most")


def known_languages(docs: DataFrame, text: str = "text", lang: str = "lang", deviations: float = 8.0) -> DataFrame:
    """The documents whose language is accepted, unchanged. Models and calibration come from these documents alone."""
    predicted = store(identify(docs, fit(docs, text, lang), text))
    return with_rejection(predicted, deviations).where(~F.col("rejected")).select(docs.columns)
