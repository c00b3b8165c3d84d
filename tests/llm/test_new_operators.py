"""Merkle manifest, license scan and target resampling against brute force, with awkward rows."""

from __future__ import annotations

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import pytest

import oracle_check
from rosterline.llm import license_scan, merkle_manifest, queries, target_resampling

SF = f"{oracle_check.DATA}/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word und mehr, " * 120_000
ROWS = [
    (3, "All rights reserved.\nCC BY cc\tby", "en", "b", 5), (1, None, None, None, None), (2, "", "", "", 0), (None, "x\ny", "en", None, 3), (None, None, None, None, None),
    (4, "Released under the MIT License\n", "en", "a", 31), (4, "Released under the MIT License\n", "en", "a", 31), (4, "other text of the same id", "en", "a", 2),
    (5, "Permission is hereby granted free of charge to any person obtaining a copy of this\nsoftware and associated documentation", "en", "a", 9),
    (6, "ÀÉ Größe 漢字 😀 x\x00y ", "de", "é", 12), (7, LONG, "en", "a", len(LONG)), (8, " \n\t.,", "en", "a", 6), (9, "GENERAL public\nlicense " * 3, "en", "a", 1),
    *[(100 + k, f"line {k}\nof a source that fills the table with many rows\n" * (1 + k % 3), "en", "hot", k) for k in range(60)],
]


def frame(spark, rows=ROWS):
    """The documents, with further columns whose names the operators use inside."""
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS grp", "2 AS id", "3 AS leaf", "4 AS pos", "5 AS row", "6 AS words", "7 AS n", "8 AS at",
                                                          "9 AS score", "'x' AS rank", "10 AS label", "11 AS weight", "12 AS runs", "13 AS block")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])])


def tree(nodes, fanout):
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, path in enumerate(paths):
            start = at[k] // fanout * fanout
            path.append(("".join(nodes[start : at[k]]), "".join(nodes[at[k] + 1 : start + fanout])))
            at[k] //= fanout
        nodes = [H(*nodes[k : k + fanout]) for k in range(0, len(nodes), fanout)]
    return nodes[0], paths


def brute_manifest(rows, fanout=3):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fanout) for g in names}
    root, over = tree([subs[g][0] for g in names], fanout)
    out = []
    for g, up in zip(names, over):
        for (_, _, own, r), path in zip(sorted(groups[g], key=lambda x: x[:3]), subs[g][1]):
            altered = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            h = leaf((r[0], r[1].replace("\n", ""), *r[2:])) if altered else own
            for before, after in path + up:
                h = H(before, h, after)
            out.append((r[0], own, subs[g][0], root, H(*[b + a for b, a in path + up]), h, h == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("shape", [merkle_manifest.Shape(), merkle_manifest.Shape(levels=1), merkle_manifest.Shape(levels=2), merkle_manifest.Shape(fanout=2, levels=1)])
def test_manifest_equals_brute_force(spark, shape):
    got = sorted(map(tuple, merkle_manifest.verified_documents(frame(spark), shape).collect()), key=str)
    assert got == brute_manifest(ROWS, shape.fanout)
    assert {r[0] for r in got if not r[-1]} == {r[0] for r in ROWS if r[0] and r[1] and "\n" in r[1] and zlib.crc32(str(r[0]).encode()) % 2 == 0}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 29, 82])
def test_manifest_of_any_size(spark, n):
    rows = [(k, str(k), None, "s", k) for k in range(n)]
    got = merkle_manifest.verified_documents(spark.createDataFrame(rows, SCHEMA), merkle_manifest.Shape(levels=1))
    assert sorted(map(tuple, got.collect()), key=str) == brute_manifest(rows)


def test_shape_needs_children_and_levels():
    with pytest.raises(ValueError):
        merkle_manifest.Shape(levels=0)


def brute_licenses(rows, scan):
    out = []
    for doc, text, *_ in rows:
        w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        starts, base, found = [], set(), []
        for phrase, label in license_scan.PHRASES:
            p = phrase.split()
            starts += [k for k in range(len(w)) if w[k : k + len(p)] == p]
            base |= {label for k in range(len(w)) if w[k : k + len(p)] == p}
        for t, (label, words, s) in enumerate(scan.sets):
            for b in range(-(-len(w) // s)):
                both = len(set(w[b * s : b * s + 2 * s]) & set(words))
                if both * scan.denominator >= scan.numerator * len(words):
                    found.append((label, t, s, b, both / len(words)))
        labels = base | {m[0] for m in found}
        score = 1.0 if starts else max([m[-1] for m in found], default=0.0)
        out.append((doc, len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("numerator", [85, 40, 100])
def test_licenses_equal_brute_force(spark, numerator):
    scan = license_scan.Scan(numerator=numerator)
    rows = ROWS + [(50, " ".join(license_scan.words_of(t)[:: -1 if k % 2 else 1]) + " x" * k, "en", "a", 1) for k, (_, t) in enumerate(license_scan.TEMPLATES)]
    got = [(*r[:8], [tuple(m) for m in r.matches]) for r in license_scan.scan_licenses(frame(spark, rows), scan).collect()]
    assert sorted(got, key=str) == brute_licenses(rows, scan)
    assert any(g[6] and not g[5] for g in got)


def test_block_at_any_place_holds_its_template(spark):
    text = license_scan.TEMPLATES[1][1]
    rows = [(k, "fill " * k + text + " more" * 40, "en", "a", 1) for k in range(70)]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.labels == "mit" and r.score == 1.0 for r in got)


def test_scan_without_templates_keeps_base_labels(spark):
    got = license_scan.scan_licenses(spark.createDataFrame([(1, "all rights reserved", "en", "a", 1)], SCHEMA), license_scan.Scan(templates=()))
    assert [tuple(r)[:8] for r in got.collect()] == [(1, 3, 1, 0, 0, "reserved", "reserved", 1.0)]


def runs_of(text):
    w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return len(w), [zlib.crc32(" ".join(w[k : k + n]).encode()) % 10_000 for n in (1, 2, 3) for k in range(len(w) - n + 1)]


def brute_resampling(rows, targets):
    have, want, docs = Counter(), Counter(), [(r[0], *runs_of(r[1])) for r in rows]
    for _, _, b in docs:
        have.update(b)
    for t in targets:
        want.update(runs_of(t)[1])
    s, t = sum(have.values()), sum(want.values())
    gain = [math.floor(1000 * math.log((want[b] + 1) * (s + 10_000) / ((have[b] + 1) * (t + 10_000)))) for b in range(10_000)]
    scored = []
    for doc, words, b in docs:
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in b)
        scored.append((words >= 20, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), doc, len(b), weight))
    able = sorted([x for x in scored if x[0]], key=lambda x: (-x[1], x[2] is None, x[2] or 0, *x[3:]))
    rest = [x for x in scored if not x[0]]
    drawn = 5 * len(able) // 100
    return sorted([(x[2], x[3], x[4], x[1], k + 1 if k < drawn else None) for k, x in enumerate(able)] + [(x[2], x[3], x[4], x[1], None) for x in rest], key=str)


def test_resampling_equals_brute_force(spark):
    targets = ["a source that fills the table", None, "", "word und mehr"]
    got = target_resampling.resample(frame(spark), spark.createDataFrame([(t, 1) for t in targets], "text string, n int"))
    assert sorted(map(tuple, got.collect()), key=str) == brute_resampling(ROWS, targets)


def test_resampling_without_target(spark):
    got = target_resampling.resample(frame(spark), spark.createDataFrame([], "text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute_resampling(ROWS, [])


def test_runs_cross_the_pieces_of_a_long_text(monkeypatch):
    text = "Ab cd, éf gh\nij " * 50
    monkeypatch.setattr(target_resampling, "PIECE", 7)
    words, runs = target_resampling.word_buckets(text, target_resampling.Features(), target_resampling.splitter())
    assert (words, Counter(runs.tolist())) == (runs_of(text)[0], Counter(runs_of(text)[1]))


def test_empty_tables(spark):
    none = frame(spark, [])
    assert merkle_manifest.verified_documents(none).count() == 0
    assert license_scan.scan_licenses(none).count() == 0
    assert target_resampling.resample(none, none).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("key", sorted(queries.SQL))
def test_query_matches_sql(spark, key):
    assert oracle_check.compare(spark, SF, key, queries.QUERIES, queries.SQL)[0] == "ok"
