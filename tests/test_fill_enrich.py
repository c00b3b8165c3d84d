import hashlib
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rosterline.operators import enrich as E
from rosterline.operators import fill
from rosterline.operators.schema import PERSON, RecordSchema
from rosterline.operators.skew import skew_join

KEY = lambda name, url: hashlib.sha256(f"{name}_{url}".encode()).hexdigest()[:16]


def test_prompt_and_normalize(spark):
    schema = RecordSchema.of({"name": "str", "age": "int?"})
    df = spark.createDataFrame([("x" * 4001, " y ", None)], "t string, a string, n string")
    row = df.select(fill.build_prompt("t", schema, 4000).alias("p"), fill.normalize_field("t", "a").alias("v"),
                    fill.normalize_field("a", "n").alias("w")).first()
    assert row.p.startswith('SCHEMA (JSON keys/types):\n{\n  "name": "str",\n  "age": "int?"\n}\n\nEXTRACT')
    assert "x" * 4000 + "...\n" in row.p and row.p.endswith("Return ONLY JSON with the schema keys.")
    assert (row.v, row.w) == ("y", " y ")


def test_parse_response(spark):
    cases = {
        'Here: ```json\n{"a": "1"}\n``` ok': {"a": "1"}, '```\n{"a": {"b": 2}}\n```': {"a": '{"b":2}'},
        '{"a": null, "n": 3}': {"a": None, "n": "3"}, '{"a": "x"': None, "nope": None, "": None, "{}": {}, "[1]": None}
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    got = [r.m for r in df.select("i", fill.parse_response_json("c").alias("m")).orderBy("i").collect()]
    assert got == list(cases.values())


def test_llm_records_budget_and_fill(spark):
    rows = [(0, "u0", "bad"), (1, "u1", '{"name": "N1", "page_url": "x"}'), (2, "u2", '{"name": ""}'),
            (3, "u3", '{"name": "N3"}')]
    responses = spark.createDataFrame(rows, "seq int, url string, response string")
    answers = fill.llm_records(responses, budget=2)
    assert {r.url: r.answer for r in answers.collect()} == {
        "u1": {"name": "N1", "page_url": "u1"}, "u2": {"name": "", "page_url": "u2"}}
    assert fill.llm_records(responses, None, enabled=False).count() == 0
    records = spark.createDataFrame(
        [("u1", "", "", "T"), ("u2", None, "p", ""), ("u3", "Have", "p", ""), ("u9", "", "p", "")],
        "url string, name string, page_url string, title string")
    got = {r.url: (r.name, r.page_url, r.title) for r in fill.hybrid_fill(records, answers, "url", PERSON).collect()}
    assert got == {"u1": ("N1", "u1", "T"), "u2": (None, "p", ""), "u3": ("Have", "p", ""), "u9": ("", "p", "")}
    assert fill.needs_fill(records, PERSON).count() == 3


def test_provider_runs_after_the_budget(spark):
    def fake(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"seq": batch["seq"], "response": '{"name": "' + batch["url"] + '"}'})

    df = spark.range(10).select(F.col("id").alias("seq"), F.concat(F.lit("u"), "id").alias("url"))
    out = fill.call_provider(df, fake, "seq long, response string", budget=3)
    assert sorted(r.response for r in out.collect()) == [json.dumps({"name": f"u{i}"}) for i in range(3)]


def test_requests(spark):
    df = spark.createDataFrame(
        [("A", "", "Org2", "https://h.org:8/x", None, "T"), (None, "O", "P", "", "a@b.c", None)],
        "name string, org string, organization string, page_url string, email string, title string")
    got = E.enrich_request(df).collect()
    assert [tuple(r) for r in got] == [("A", "Org2", "h.org:8", None, None), (None, "O", None, None, "a@b.c")]
    infos = [json.loads(r.j) for r in df.select(E.lead_info(df, "Acme").alias("j")).collect()]
    assert infos == [
        {"name": "A", "company": "Acme", "title": "T", "location": "", "profile_url": "https://h.org:8/x"},
        {"name": "", "company": "Acme", "title": "", "location": "", "email": "a@b.c"}]
    assert [r.idempotency_key for r in E.with_idempotency_key(df).collect()] == [
        KEY("A", "https://h.org:8/x"), KEY("", "")]


STATUSES = [
    ("done", 0, "pending", None, None, None), ("done", 901, "completed", None, '{"structured_data":{"a":"1"}}', None),
    ("late", 0, "pending", None, None, None), ("late", 900, "processing", None, None, None),
    ("late", 901, "processing", None, None, None), ("late", 950, "completed", None, "{}", None),
    ("bad", 0, "pending", None, None, None), ("bad", 5, "failed", "boom", None, None),
    ("bad", 6, "completed", None, "{}", None), ("worse", 0, "failed", None, None, None),
    ("odd", 0, "weird", None, None, None), ("net", 0, None, None, None, "reset"), ("open", 0, "pending", None, None, None),
]
EXPECTED = {
    "done": (True, None), "late": (False, "Polling timeout after 900s"), "bad": (False, "Job failed: boom"),
    "worse": (False, "Job failed: Unknown error"), "odd": (False, "Unknown status: weird"),
    "net": (False, "Polling error: reset")}


@pytest.fixture(scope="module")
def statuses(spark):
    return spark.createDataFrame(
        STATUSES, "task_id string, s int, status string, error string, result_json string, fetch_error string"
    ).select("*", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"), F.col("s").cast("bigint").alias("seq"))


def test_job_outcome(statuses):
    got = {r.task_id: (r.success, r.error) for r in E.job_outcome(statuses, order="seq").collect()}
    assert got == EXPECTED
    begun = statuses.select("task_id", F.timestamp_seconds(F.lit(1_699_999_000)).alias("submitted_at"))
    early = {r.task_id: r.error for r in E.job_outcome(statuses, begun).collect()}
    assert early["open"] == "Polling timeout after 900s" == early["done"]


def first_verdict(rows, begun=None):
    """(success, error) of one task's rows (ts in s, seq, status, error, fetch_error), read one by one; None while open."""
    start = min(r[0] for r in rows) if begun is None else begun
    for ts, _, status, error, fetch in sorted(rows, key=lambda r: r[:2]):
        if fetch is not None:
            return False, f"Polling error: {fetch}"
        if status == "completed":
            return True, None
        if status == "failed":
            return False, f"Job failed: {error or 'Unknown error'}"
        if status not in ("pending", "processing"):
            return False, f"Unknown status: {status}"
        if ts - start > 900:
            return False, "Polling timeout after 900s"


@pytest.mark.parametrize("seed", range(3))
def test_job_outcome_equals_reading_rows_one_by_one(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(3000):
        # A third of the rows is one task's, which never ends by itself.
        task, waits = ("hot", True) if k % 3 == 0 else (f"t{rng.randint(0, 200)}", rng.random() < 0.8)
        status = rng.choice(["pending", "processing"]) if waits else rng.choice(["completed", "failed", "odd", None])
        rows.append((task, rng.choice([0, 450, 899, 900, 901, 902, 1800, rng.randint(0, 4000)]), k, status, rng.choice([None, "e"]),
                     None if waits or rng.random() < 0.8 else "net", "{}"))
    df = spark.createDataFrame(rows, "task_id string, s int, seq long, status string, error string, fetch_error string, result_json string")
    df = df.withColumn("ts", F.timestamp_seconds("s")).repartition(5)
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r[1:6])
    want = {t: v for t, g in groups.items() if (v := first_verdict(g))}
    assert {r.task_id: (r.success, r.error) for r in E.job_outcome(df, order="seq").collect()} == want
    begun = spark.createDataFrame([(t, 100) for t in groups if t != "t5"], "task_id string, b int").select(
        "task_id", F.timestamp_seconds("b").alias("submitted_at"))
    want = {t: v for t, g in groups.items() if (v := first_verdict(g, 100 if t != "t5" else 10**6))}
    assert {r.task_id: (r.success, r.error) for r in E.job_outcome(df, begun, order="seq").collect()} == want


def test_job_results_read_their_sources_seldom(spark, tmp_path):
    """Scans and exchanges of the plans before reuse: records are read once, statuses three times (all, waiting, late)."""
    for name, columns in (("r", "name string, page_url string, phone string"), ("s", "idempotency_key string, task_id string"),
                          ("o", "task_id string, ts timestamp, status string, error string, result_json string")):
        spark.createDataFrame([], columns).write.parquet(str(tmp_path / name))
    records, sent, seen = (spark.read.parquet(str(tmp_path / n)) for n in "rso")
    batch = E.enrich_batch(records, sent, seen)

    def plan(df):
        text = df._jdf.queryExecution().executedPlan().toString()
        return text.count("FileScan"), text.count("Exchange hash") + text.count("Exchange Single")

    scans, exchanges = plan(batch)
    assert scans <= 5 and exchanges <= 9
    more, further = plan(E.enrich_summary(batch))
    assert more == scans and further <= exchanges + 2


def test_parse_and_apply(spark):
    doc = json.dumps({"structured_data": {"title": "", "phone": "5"}, "notes": "n", "confidence_score": 8,
                      "references": {"http://a": "x", "http://b": "y"}})
    df = spark.createDataFrame([("A", "T", True, doc), ("B", "U", False, doc), ("C", "V", True, "{}")],
                               "name string, title string, success boolean, result_json string")
    enriched = E.with_enrichment(df)
    first = enriched.orderBy("name").collect()
    assert first[0].enriched == {"title": "", "phone": "5", "_enrichment_notes": "n", "_enrichment_confidence": "8.0",
                                 "_enrichment_sources": '["http://a","http://b"]'}
    assert first[1].fields == [] and len(first[2].fields) == 3
    merged = {r.name: (r.title, r.phone) for r in E.enrich_apply(enriched).collect()}
    assert merged == {"A": ("", "5"), "B": ("U", None), "C": ("V", None)}
    summary = E.enrich_summary(enriched).first()
    assert (summary.total, summary.successes) == (3, 2) and summary.success_rate == pytest.approx(200 / 3)
    assert "phone" in summary.fields and summary.fields == sorted(summary.fields)
    empty = E.enrich_summary(enriched.where("false")).first()
    assert empty.total == 0 and empty.success_rate is None


def test_batch(spark, statuses):
    records = spark.createDataFrame([(i, n, "u") for i, n in enumerate([*EXPECTED, "unsent"])],
                                    "seq int, name string, page_url string")
    sent = spark.createDataFrame([(KEY(n, "u"), n) for n in EXPECTED], "idempotency_key string, task_id string")
    got = {r.name: (r.success, r.error) for r in E.enrich_batch(records, sent, statuses).collect()}
    assert got == {**EXPECTED, "unsent": (False, "Failed to submit enrichment job")}
    merged = E.enrich_merge(records, E.enrich_batch(records, sent, statuses), fields=["a"])
    assert {r.name: r.a for r in merged.collect() if r.a} == {"done": "1"}


def test_http_outcome(spark):
    rows = [("ok", 1, 500, "x", None), ("ok", 2, 200, None, "{}"), ("bad", 1, 404, "gone", None), ("bad", 2, 200, None, "{}"),
            ("exh", 1, 429, "slow", None), ("exh", 2, 503, "down", None), ("exh", 3, 200, None, "{}"),
            ("exc", 1, None, "timeout", None)]
    df = spark.createDataFrame(rows, "idempotency_key string, attempt int, code int, error string, result_json string")
    got = {r.idempotency_key: (r.success, r.error) for r in E.http_outcome(df).collect()}
    assert got == {"ok": (True, None), "bad": (False, "HTTP 404: gone"), "exh": (False, "HTTP 503: down"),
                   "exc": (False, "timeout")}
    records = spark.createDataFrame([("A", "u"), ("B", "u")], "name string, page_url string")
    attempts = spark.createDataFrame([(KEY("A", "u"), 1, 200, None, "{}")], df.schema)
    assert {r.name: r.success for r in E.enrich_batch_sync(records, attempts).collect()} == {"A": True, "B": False}


def test_skew_join_spreads_hot_keys_and_keeps_all_rows(spark):
    big = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), "id")
    small = big.select("k").distinct().where("k % 2 != 0").withColumn("v", F.col("k") * 10)
    got = skew_join(big, small, "k")
    plain = big.join(small, "k", "left")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_several_answers_give_one_record_and_unlisted_keys_stay(spark):
    from rosterline.operators import enrich, fill, skew
    from rosterline.operators.schema import RecordSchema

    records = spark.createDataFrame([(1, None), (2, "B")], "k int, name string")
    answers = spark.createDataFrame([(1, {"name": ""}), (1, {"name": "Z"}), (1, {"name": "A"})], "k int, answer map<string,string>")
    filled = fill.hybrid_fill(records, answers, "k", RecordSchema.of({"name": "str"}))
    assert sorted((r.k, r.name) for r in filled.collect()) == [(1, "A"), (2, "B")]
    results = spark.createDataFrame([(True, {"phone": "1", "github": "g"}, "0"), (False, {"github": "h"}, "2")], "success boolean, enriched map<string,string>, phone string")
    rows = enrich.enrich_apply(results.withColumn("fields", F.lit(None))).collect()
    assert [(r.phone, r.enriched_more) for r in rows] == [("1", {"github": "g"}), ("2", None)]
    equal = spark.range(20_000).select(F.lit(7).alias("k"), F.lit("same").alias("v")).repartition(4)
    joined = skew.skew_join(equal, spark.createDataFrame([(7, "x")], "k int, w string"), "k")
    assert joined.count() == 20_000 and joined.where("w = 'x'").count() == 20_000
