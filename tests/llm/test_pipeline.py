"""Pipeline stages on awkward rows, and queries whose package workers can't import."""

from __future__ import annotations

import os
import subprocess
import sys
import textwrap

import pytest

import corpus_pipeline
import oracle_check

SF = f"{oracle_check.DATA}/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def awkward(spark):
    """Documents of the smallest table, and rows with null ids, shared ids, repeats, a long text and further columns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r.text.split()) > 30)
    clean = docs.where("length(text) between 500 and 3000").orderBy("doc_id").limit(1).first().text
    rows = [(None, item, "en", "a", 1), (10**9, f"{item} ", "en", "a", 1), (10**9, f"{clean} clean words of the same id", "en", "a", 1), (None, f"{clean} without an id", "en", None, None),
            (10**9 + 1, None, None, None, None), (10**9 + 2, "", "en", "a", 0), (10**9 + 3, "1234 !!", "en", "a", 7),
            (10**9 + 4, (clean + " ") * 300, "en", "a", 2), (10**9 + 5, clean.upper() + " mail me@x.org", "en", "a", 2), (10**9 + 5, clean.upper() + " mail me@x.org", "en", "a", 2)]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.unionByName(more).selectExpr("*", "1 AS _key", "2 AS digest", "3 AS rejected"), item


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stage_takes_awkward_rows(spark, awkward, stage):
    docs, item = awkward
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, SF)
    if stage == "best_fit_packing":
        assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").distinct().collect()}
        return
    assert out.columns == corpus_pipeline.COLUMNS
    texts = [(r.doc_id, r.text) for r in out.collect()]
    if stage == "pii":
        assert len(texts) == docs.count() and (10**9 + 1, None) in texts and not any(t and "me@x.org" in t for _, t in texts)
    if stage == "language_id":
        assert not {10**9 + 1, 10**9 + 2, 10**9 + 3} & {d for d, _ in texts}
    if stage == "benchmark_decontamination":
        assert not any(t and item in t for _, t in texts)
        # Rows without an id, or with a contaminated row's id, stay if their own text is clean.
        assert any(d is None and t.endswith("without an id") for d, t in texts)
        assert any(d == 10**9 and t.endswith("clean words of the same id") for d, t in texts)
        assert (10**9 + 1, None) in texts and (10**9 + 2, "") in texts


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stage_takes_an_empty_table(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    assert dict(corpus_pipeline.STAGES)[stage](spark, docs, SF).count() == 0


def test_workers_need_no_package(tmp_path):
    """A driver in another folder, which alone has the package on its path."""
    code = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        import __spark_entry__ as entry
        from rosterline.session import build_session
        spark = build_session("local-cluster[1,2,2048]", "scratch", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4",
            "spark.executor.memory": "1g", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": {str(tmp_path / 'shared')!r}}})
        for key in ("op3_lm_scoring", "op9_language_id", "op12_license_scans", "op13_target_resampling"):
            print(key, entry.queries()[key](spark, {SF!r}).count())
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert [line.split()[1] for line in done.stdout.splitlines() if line.startswith("op")] == ["200"] * 4
