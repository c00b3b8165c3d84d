"""Embedding and MinHash near-dedup against brute force, on a whole small table and on awkward rows."""

import itertools
import os
from collections import defaultdict

import numpy as np
import pytest

from rosterline.llm import embedding_dedup
from rosterline.llm.components import components
from rosterline.llm.embedding_dedup import similar_vectors
from rosterline.llm.minhash_dedup import Matching, near_duplicates

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def closure(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute_vectors(rows, threshold):
    links = []
    for (a, v, x), (b, w, y) in itertools.combinations(rows, 2):
        sound = lambda u: u is not None and all(c is not None and np.isfinite(c) for c in u) and any(u)
        if x is None or x != y or not sound(v) or not sound(w) or len(v) != len(w):
            continue
        v64, w64 = np.array(v, float), np.array(w, float)
        if v64 @ w64 / np.sqrt((v64 @ v64) * (w64 @ w64)) >= threshold:
            links.append((a, b))
    count = defaultdict(int)
    for pair in links:
        for k in pair:
            count[k] += 1
    roots = closure([r[0] for r in rows], links)
    return {(k, count[k], roots[k], roots[k] == k) for k in roots}


def shingles(text, n):
    words = []
    for word in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" "):
        if word:
            words.append(word)
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def brute_texts(rows, words, num, den):
    sets = {k: shingles(t, words) for k, t in rows}
    links = []
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            links.append((a, b))
    roots = closure(sets, links)
    return {(k, len(sets[k]), roots[k], roots[k] == k) for k in roots}


def test_components_of_paths_stars_and_cycles(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(500, k) for k in range(501, 560)]
    ring = [(900 + i, 900 + (i + 1) % 7) for i in range(7)] + [(5, 5)]
    edges = path + star + ring
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == set(closure({x for e in edges for x in e} - {5}, edges[:-1]).items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_vectors_of_the_small_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    assert {tuple(r) for r in similar_vectors(table, 0.93).collect()} == brute_vectors(rows, 0.93)


def test_awkward_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal(16)
    rows = [(k, (base + rng.standard_normal(16) * 0.12 * (k % 7)).tolist(), k % 2) for k in range(60)]
    rows += [(100 + k, base.tolist(), 0) for k in range(40)]
    rows += [(200, (base * 1e100).tolist(), 0), (201, None, 0), (202, [], 0), (203, [0.0] * 16, 0), (204, [float("nan")] * 16, 0),
             (205, base.tolist(), None), (206, [None] + base.tolist()[1:], 0), (207, base.tolist()[:8], 0), (208, (-base).tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS rep", "2 AS key", "3 AS n")
    assert {tuple(r) for r in similar_vectors(df, 0.93).collect()} == brute_vectors(rows, 0.93)
    nothing = df.where("vec_id < 0")
    assert similar_vectors(nothing, 0.93).count() == 0
    doubled = spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (None, [1.0, 2.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(tuple(r) for r in similar_vectors(doubled).fillna(-1, ["vec_id", "component_id"]).collect()) == [
        (-1, 0, -1, False), (1, 1, 1, True), (1, 1, 1, True)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("words,num", [(3, 85), (5, 80)])
def test_texts_of_the_small_table(spark, words, num):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    assert {tuple(r) for r in near_duplicates(table, Matching(words=words, numerator=num)).collect()} == brute_texts(rows, words, num, 100)


def test_awkward_texts(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(500)]
    base = list(rng.choice(vocabulary, 120))
    rows = []
    for k in range(80):  # a large group of near copies that differ from each other more than from their source
        copy = list(base)
        for at in rng.choice(120, k % 6, replace=False):
            copy[at] = f"new{k}-{at}"
        rows.append((k, " ".join(copy)))
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, "One"), (104, "one"), (105, "one two"), (106, "ONE\x0btwo"), (107, "É a b c"), (108, "é a b c"),
             (109, "x " * 60000 + "y"), (110, "x " * 60000 + "y z"), (111, "a b c d"), (112, "a b c d")]
    rows += [(200 + k, " ".join(base)) for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS sig", "1 AS root", "2 AS n", "3 AS key")
    matching = Matching(words=3, numerator=85, posting_block=10, set_block=7)
    assert {tuple(r) for r in near_duplicates(df, matching).collect()} == brute_texts(rows, 3, 85, 100)
    assert near_duplicates(df.where("doc_id < 0")).count() == 0
    odd = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_duplicates(odd).collect()) == [(0, 0, False), (1, 1, True), (1, 1, True)]


@pytest.mark.parametrize("dim", [16, 64])
def test_cells_keep_planted_vectors_together(dim):
    """Of 100,000 pairs at cosine 0.93 to 0.94, at most one in 10,000 shares no cell."""
    hashing, rng, n = embedding_dedup.Hashing(), np.random.default_rng(1), 100_000
    left, other = (embedding_dedup._units(rng.standard_normal((n, dim))) for _ in range(2))
    other = embedding_dedup._units(other - (other * left).sum(axis=1, keepdims=True) * left)
    c = rng.uniform(0.93, 0.94, (n, 1))
    cells = [embedding_dedup.cells(v, hashing) for v in (left, c * left + np.sqrt(1 - c * c) * other)]
    assert (cells[0] != cells[1]).all(axis=1).mean() <= 1e-4
