"""Token histogram, packing and archives: exact round trips and brute force."""

import base64
import functools
import hashlib
import os
import zlib
from collections import defaultdict

import numpy as np
import pytest

from rosterline.llm import queries, token_counts, warc, wordbpe
from rosterline.llm.packing import Capacity, best_fit, pack

SF = "/root/testdata/sf0.001"
ODD = ["", None, "a", "Ça va\xa0L'ÉTÉ don't We'LL <|endoftext|>a b", "é İstanbul ΣΑΣ \x1c a\x1fb", "日本語 テキスト 123", "a\x85b ﬁ Å '́ áb", "wörd " * 9000, "y" * 5000]


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(wordbpe.default_path())


def plain_ids(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


def odd_docs(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, ODD[3]), (None, "no id")]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS length", "2 AS grp", "3 AS n_tokens")


def test_ids_are_the_tokenizers(spark):
    encode = wordbpe.encoder(wordbpe.default_path())
    for text in ODD:
        assert encode(text).tolist() == plain_ids(text)


def test_report_against_brute_force(spark):
    docs = odd_docs(spark)
    lengths = np.array([len(plain_ids(r.text)) for r in docs.collect()])
    report = token_counts.length_report(token_counts.length_histogram(docs, wordbpe.default_path()), limits=[7, 2048])
    rows = report.collect()
    assert {r.n_tokens for r in rows} == set(lengths) | {7, 2048}
    for r in rows:
        n = r.n_tokens
        assert (r.n_docs, r.docs_at_most, r.docs_at_least, r.tokens_at_least, r.truncated_tokens, r.docs_cut) == (
            (lengths == n).sum(), (lengths <= n).sum(), (lengths >= n).sum(), lengths[lengths >= n].sum(), np.minimum(lengths, n).sum(), (lengths > n).sum())
    median = token_counts.quantiles(report, [0.5]).first()[0]
    assert (lengths <= median).mean() >= 0.5 > (lengths < median).mean()
    assert token_counts.length_report(token_counts.length_histogram(docs.where("false"), wordbpe.default_path())).count() == 0


def check_packing(rows, texts, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc, parts in by_doc.items():
        ids = np.array([*plain_ids(texts[doc]), 0], "<u4")
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(-(-len(ids) // capacity.piece)))
        for r in parts:
            part = ids[r.start : r.start + r.length]
            assert r.start == r.piece * capacity.piece and len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
        assert sum(r.length for r in parts) == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity.tokens and len(parts) <= capacity.documents and sum(r.length**2 for r in parts) <= capacity.attention
    return len(by_sequence)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_packing_of_the_small_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = pack(docs, wordbpe.default_path()).collect()
    n = check_packing(rows, {r.doc_id: r.text for r in docs.collect()}, Capacity())
    assert n <= 1.02 * -(-sum(r.length for r in rows) // 2048) + 1


@pytest.mark.parametrize("capacity", [Capacity(64, 3, 2000), Capacity(64, 100, 4096, (1.0, 0.5, 0.5), "dot")])
def test_packing_of_awkward_rows(spark, capacity):
    docs = odd_docs(spark).where("doc_id is null or doc_id <> 3 or length = 1").dropDuplicates(["doc_id"])
    rows = pack(docs, wordbpe.default_path(), capacity, group_sequences=20).collect()
    check_packing(rows, {r.doc_id: r.text for r in docs.collect()}, capacity)
    assert pack(docs.where("false"), wordbpe.default_path()).count() == 0


def test_best_fit_choices():
    bins, offsets = best_fit(np.array([6, 5, 4, 3, 2]), Capacity(10, 9, 100))
    assert bins.tolist() == [0, 1, 0, 1, 1] and offsets.tolist() == [0, 0, 6, 5, 8]
    assert best_fit(np.zeros(0, np.int64), Capacity())[0].tolist() == []


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected_captures(rows):
    largest = defaultdict(int)
    for page, html in rows:
        largest[html or ""] = max(largest[html or ""], page)
    out = set()
    for page, html in rows:
        first = largest[html or ""]
        out.add((page, len((html or "").encode()), digest(html), "response" if page == first else "revisit", None if page == first else first))
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_archives_of_the_small_table(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries.op10_warc(spark, SF).collect()}
    assert got == expected_captures(rows)


def test_awkward_archives(spark, tmp_path):
    tricky = "a\r\n\r\nWARC/1.0\r\nContent-Length: 5\r\n\r\né"
    rows = [(1, "x"), (2, "x"), (3, None), (4, ""), (5, tricky), (6, tricky), (7, "x" * 300_000), (9, "퟿\U0001f600"), (8, "x")]
    pages = spark.createDataFrame([(k, f"http://h/{k}\nX: y" if k != 2 else None, h) for k, h in rows], "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS name")
    path = str(tmp_path / "archives")
    warc.write_archives(warc.capture_records(pages), path, 300_000)
    done = warc.transactions(warc.read_records(spark, path)).collect()
    by_id = {int(r.response.record_id[5:].split(".")[0]): r for r in done}
    assert len(done) == len(rows) and all(r.request and r.metadata for r in done)
    for page, html in rows:
        r = by_id[page].response
        revisits = {1: "page:8", 2: "page:8", 3: "page:4", 5: "page:6"}.get(page)
        assert r.refers_to == revisits and r.kind == ("revisit" if revisits else "response") and r.digest == digest(html)
        assert revisits or bytes(r.payload).decode() == (html or "")
    twice = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, None, "a")], "page_id long, url string, html string")
    warc.write_archives(warc.capture_records(twice), str(tmp_path / "twice"), 10)
    assert [r.response.kind for r in warc.transactions(warc.read_records(spark, str(tmp_path / "twice"))).collect()] == ["response"] * 3
    small = spark.createDataFrame([(1, None, "a"), (2, None, "a")], "page_id long, url string, html string")
    warc.write_archives(warc.capture_records(small, min_bytes=2), str(tmp_path / "small"), 10)
    assert {r.kind for r in warc.read_records(spark, str(tmp_path / "small")).collect()} == {"request", "response", "metadata"}
    warc.write_archives(warc.capture_records(small.where("false")), str(tmp_path / "none"), 0)
    assert warc.read_records(spark, str(tmp_path / "none")).count() == 0
