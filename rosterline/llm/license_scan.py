"""License scan: an exact set-similarity join of text blocks with license templates, beside fixed phrases."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterline.llm.common import columns_as, map_batches, store

#: A word (fixed value): digits, lower-case letters and all that is not ASCII.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Base phrases and their labels (fixed values).
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Opening words of public license notices, with our labels for them.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


def words_of(text: str | None) -> list[str]:
    """Words of a whole text, A-Z lower-cased."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")) if text else []


@dataclass(frozen=True)
class Scan:
    """A block holds a template where it has ``numerator`` of ``denominator`` of the template's distinct words.

    Templates of up to s words, s a power of two and ``shortest`` at least, are sought in blocks of 2s words that begin every
    s words, so that any passage of s words lies within one block. Templates are parameters and few: they are sent to all tasks.
    """

    templates: tuple[tuple[str, str], ...] = TEMPLATES
    numerator: int = 85
    denominator: int = 100
    shortest: int = 8
    #: Distinct words of each template, and the size s of its blocks.
    sets: list[tuple[str, list[str], int]] = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        found = [(label, words_of(text)) for label, text in self.templates]
        object.__setattr__(self, "sets", [(label, sorted(set(w)), max(self.shortest, 1 << (len(w) - 1).bit_length())) for label, w in found if w])

    def least(self, words: int) -> int:
        """Of so many distinct words of a template, those that a block must have."""
        return max(1, -(-words * self.numerator // self.denominator))


def word_frequencies(texts: DataFrame, words: list[str]) -> dict[str, int]:
    """How often each of the given words occurs in all texts; tasks send a row per batch and word."""

    def run(batch: dict):
        wanted, total = {w: k for k, w in enumerate(words)}, np.zeros(len(words), np.int64)
        for t in batch["text"]:
            found = np.fromiter((wanted.get(w, -1) for w in words_of(t)), np.int64)
            total += np.bincount(found[found >= 0], minlength=len(words))
        has = np.flatnonzero(total)
        yield {"word": has, "n": total[has]}

    counts = map_batches(texts, run, "word int, n long", rows=10_000).groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {words[r.word]: r.n for r in counts}
    return {w: found.get(w, 0) for w in words}


def _blocks(ids: np.ndarray, size: int, keys: np.ndarray, least: int) -> list[dict]:
    """Blocks with at least ``least`` of the templates' words, among them one of ``keys``: their number and sorted words."""
    at = np.flatnonzero(ids >= 0)
    if not len(at) or not keys[ids[at]].any():
        return []
    where, own = at // size, ids[at].astype(np.int64)
    block, word = np.concatenate([where, where[where > 0] - 1]), np.concatenate([own, own[where > 0]])
    pairs = np.unique(block * np.int64(len(keys)) + word)
    block, word = pairs // len(keys), pairs % len(keys)
    numbers, start, many = np.unique(block, return_index=True, return_counts=True)
    use = (many >= least) & np.logical_or.reduceat(keys[word], start)
    return [{"size": size, "block": int(b), "words": word[s : s + n].tolist()} for b, s, n in zip(numbers[use], start[use], many[use])]


def scan_licenses(docs: DataFrame, scan: Scan = Scan(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches)``, one row per input row.

    ``n_base`` counts the places of the base phrases, ``first_word`` and ``last_word`` are the smallest and the largest start.
    ``matches`` lists (label, template, size, block, share) of every block that holds a template, in order; ``labels`` has the
    base labels and theirs. ``score`` is 1 where a base phrase stands, else the largest share found, 0 without any.

    Words of templates are numbered by their frequency in all texts, rarest first (ties by the word); words of no template
    come before them and match nothing. A block and a template that have ``o`` words in common share one of the block's
    first n - o + 1 and the template's first m - o + 1 (prefix filter); blocks of fewer than ``o`` words are left out (length),
    as are meetings after which too few words follow (positions); all others are counted exactly. Templates are few, so
    postings are joined to broadcast ones, and a phrase that a third of all rows hold stays where its rows are. Null, empty
    and wordless texts have no words, no labels and score 0; repeated rows and null ids are scanned like any others; whole
    texts are read; an empty table gives no rows.
    """
    session = docs.sparkSession
    plain = columns_as(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    known = sorted({w for _, ws, _ in scan.sets for w in ws})
    frequency = word_frequencies(plain.select("text"), known) if known else {}
    rank = {w: k for k, w in enumerate(sorted(known, key=lambda w: (frequency[w], w)))}
    templates = [(t, label, size, sorted(rank[w] for w in ws)) for t, (label, ws, size) in enumerate(scan.sets)]
    sizes = sorted({s for _, _, s, _ in templates})
    # Words that a template of a size can be met by, and the fewest it asks for.
    prefixes = {s: {w for _, _, z, ws in templates if z == s for w in ws[: len(ws) - scan.least(len(ws)) + 1]} for s in sizes}
    fewest = {s: min(scan.least(len(ws)) for _, _, z, ws in templates if z == s) for s in sizes}

    def read(batch: dict):
        own = dict(rank)
        for words, _ in PHRASES:
            for w in words.split():
                own.setdefault(w, len(own))
        phrases = [([own[w] for w in words.split()], label) for words, label in PHRASES]
        keys = {s: np.isin(np.arange(len(rank)), list(prefixes[s])) for s in sizes}
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "blocks")}
        for doc, content in zip(batch["doc_id"], batch["text"]):
            words = words_of(content)
            ids = np.fromiter((own.get(w, -1) for w in words), np.int32, len(words))
            places, labels = [], set()
            for phrase, label in phrases:
                hit = np.ones(max(0, len(ids) - len(phrase) + 1), bool)
                for k, w in enumerate(phrase):
                    hit &= ids[k : k + len(hit)] == w
                if hit.any():
                    places.append(np.flatnonzero(hit))
                    labels.add(label)
            starts = np.concatenate(places) if places else np.zeros(0, np.int64)
            ids[ids >= len(rank)] = -1
            out["doc_id"].append(doc)
            out["n_words"].append(len(words))
            out["n_base"].append(len(starts))
            out["first_word"].append(int(starts.min()) if len(starts) else None)
            out["last_word"].append(int(starts.max()) if len(starts) else None)
            out["base_labels"].append(sorted(labels))
            out["blocks"].append([b for s in sizes for b in _blocks(ids, s, keys[s], fewest[s])])
        yield out

    schema = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
              "blocks array<struct<size int, block long, words array<int>>>")
    # Stored, so that a row's number is the same in both reads.
    rows = store(map_batches(plain, read, schema).withColumn("row", F.monotonically_increasing_id()))
    posted = [(t, label, size, len(ws), scan.least(len(ws)), k, ws[k], ws) for t, label, size, ws in templates
              for k in range(len(ws) - scan.least(len(ws)) + 1)]
    postings = session.createDataFrame(posted, "template int, label string, t_size int, m int, least int, t_at int, word int, t_words array<int>")
    blocks = rows.select("row", F.inline("blocks")).withColumn("n", F.size("words"))
    shortest = F.element_at(F.create_map(*[F.lit(x) for s in sizes or [0] for x in (s, fewest.get(s, 1))]), F.col("size"))
    met = blocks.select("row", "size", "block", "words", "n", F.posexplode(F.slice("words", F.lit(1), F.col("n") - shortest + 1)).alias("at", "word"))
    # Length, then positions: from a meeting on, both sides need enough words, which also ends the prefix that this template asks for.
    near = (F.col("size") == F.col("t_size")) & (F.col("n") >= F.col("least")) & (F.least(F.col("n") - F.col("at"), F.col("m") - F.col("t_at")) >= F.col("least"))
    pairs = met.join(F.broadcast(postings), "word").where(near).withColumn("both", F.size(F.array_intersect("words", "t_words")))
    # Of the words in which the two meet, the first counts.
    first = F.element_at(F.array_intersect("words", "t_words"), 1) == F.col("word")
    pairs = pairs.where(first & (F.col("both") >= F.col("least")))
    match = F.struct("label", "template", "size", "block", (F.col("both") / F.col("m")).alias("share"))
    found = pairs.groupBy(F.col("row").alias("of")).agg(F.collect_list(match).alias("matches"))
    out = rows.drop("blocks").join(found, F.col("row") == F.col("of"), "left")
    matches = F.coalesce(F.array_sort("matches"), F.array().cast("array<struct<label:string,template:int,size:int,block:bigint,share:double>>"))
    labels = F.array_sort(F.array_union("base_labels", F.transform(matches, lambda m: m["label"])))
    best = F.coalesce(F.array_max(F.transform(matches, lambda m: m["share"])), F.lit(0.0))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
                      F.array_join(labels, ",").alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(best).alias("score"), matches.alias("matches"))
