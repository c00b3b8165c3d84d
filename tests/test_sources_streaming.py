import datetime as dt
import json
import random
import shutil
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rosterline.functions.sql import register_functions
from rosterline.functions.urls import url_join
from rosterline.operators import enrich as E
from rosterline.sources import pages as P
from rosterline.sources import records as R
from rosterline.sources import runlog as L
from rosterline.streaming import jobs as J
from test_fill_enrich import EXPECTED, STATUSES, statuses  # noqa: F401
from test_extract import PROFILE


@pytest.mark.parametrize("ext", ["jsonl", "csv", "parquet"])
def test_round_trip(spark, tmp_path, ext):
    df = spark.createDataFrame([("A", 'say "hi",\nthere', 1), ("B", "é", None)], "name string, bio string, n int")
    path = str(tmp_path / f"out.{ext}")
    R.write_records(df, path)
    back = R.read_records(spark, path).select("name", "bio", "n").orderBy("name").collect()
    assert [tuple(r) for r in back] == [("A", 'say "hi",\nthere', 1), ("B", "é", None)]


def test_io_rules(spark, tmp_path):
    df = spark.createDataFrame([("A", None)], "name string, x string")
    R.write_jsonl(df, str(tmp_path / "n.jsonl"))
    assert json.loads(spark.read.text(str(tmp_path / "n.jsonl")).first().value) == {"name": "A", "x": None}
    R.append_jsonl(df, str(tmp_path / "n.jsonl"))
    assert R.read_jsonl(spark, str(tmp_path / "n.jsonl"), "name string").count() == 2
    R.write_csv(df.where("false"), str(tmp_path / "e.csv"))
    assert not (tmp_path / "e.csv").exists()
    for call in (lambda: R.read_records(spark, "x.txt"), lambda: R.write_records(df, "x.xml")):
        with pytest.raises(ValueError):
            call()
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n\n{"a": \n')
    with pytest.raises(Exception):
        R.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int").collect()


def test_run_log_and_events(spark, tmp_path):
    runs, events = str(tmp_path / "runs"), str(tmp_path / "events")
    begin = spark.createDataFrame([("r1", "u")], "run_id string, start_url string")
    L.log_run(begin, runs, F.lit("2024-01-01").cast("timestamp"))
    L.log_run(spark.createDataFrame([("r1", 7)], "run_id string, pages_fetched int"), runs, F.lit("2024-01-02").cast("timestamp"))
    row = L.latest_runs(spark.read.parquet(runs)).first()
    assert (row.start_url, row.pages_fetched, row.pages_failed, row.completed_at) == ("u", 7, 0, None)
    assert L.read_events(spark, events).count() == 0
    L.log_events(L.event_rows(begin, F.col("run_id"), F.lit("page_fetched"), F.lit("task_123"), F.struct("start_url")), events)
    tasks = spark.createDataFrame([("r1", "task_123"), ("r1", "task_456"), ("r2", "task_123")], "run_id string, task_id string")
    log = L.read_events(spark, events)
    left = lambda **k: sorted(tuple(r) for r in L.skip_done(tasks, log, **k).collect())
    assert left() == [("r1", "task_456"), ("r2", "task_123")]
    assert [t for _, t in left(scope="all")] == ["task_456"] and len(left(force=True)) == 3


def _files(folder):
    return sorted(str(f.relative_to(folder)) for f in folder.rglob("*.parquet"))


def test_event_log_has_few_files_and_skips_read_those_that_match(spark, tmp_path):
    folder = tmp_path / "log"
    path = str(folder)
    rows = spark.range(100_000).select(
        F.concat(F.lit("r"), "id").alias("run_id"), F.timestamp_seconds(F.lit(1_704_100_000) + F.col("id") % 2 * 86400).alias("timestamp"),
        F.lit("page_fetched").alias("kind"), F.concat(F.lit("t"), F.col("id") % 10).alias("key"), F.lit(None).cast("string").alias("meta_json"))
    L.log_events(rows, path)
    assert len(_files(folder)) <= 2 * L.RUN_BUCKETS
    for k in range(3):
        L.log_events(rows.where(f"key = 't{k}'"), path)
    many = len(_files(folder))
    before = sorted(map(tuple, L.read_events(spark, path).groupBy("run_id", "key").count().collect()))
    L.compact_events(spark, path, "2024-01-02")
    assert sorted(map(tuple, L.read_events(spark, path).groupBy("run_id", "key").count().collect())) == before
    left = _files(folder)
    assert sum(f.startswith("day=2024-01-01") for f in left) <= L.RUN_BUCKETS and len(left) < many
    assert L.read_events(spark, path, since="2024-01-02").count() + L.read_events(spark, path).where("day(timestamp) = 1").count() == 130_000
    tasks = spark.createDataFrame([("r7", "t7"), ("r7", "t8"), ("r7", None), (None, "t7")], "run_id string, task_id string")
    open_ = L.skip_logged(tasks, path)
    assert {tuple(r) for r in open_.collect()} == {("r7", "t8"), ("r7", None), (None, "t7")}
    plan = open_._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(bucket" in plan.replace("\n", "") and "EqualTo(run_id,r7)" in plan
    # Other buckets are never opened.
    for f in _files(folder):
        if f"bucket={spark.range(1).select(L._bucket(F.lit('r7'))).first()[0]}/" not in f:
            (folder / f).write_bytes(b"broken")
    assert L.skip_logged(tasks, path).count() == 3 and L.read_events(spark, path, "r7").count() == 1
    assert L.skip_logged(tasks, path, force=True).count() == 4
    assert L.skip_logged(tasks, str(tmp_path / "none")).count() == 4


def test_skip_logged_in_any_run(spark, tmp_path):
    path = str(tmp_path / "log")
    events = spark.createDataFrame([("r1", "a"), (None, "b"), ("r2", None)], "r string, k string")
    L.log_events(L.event_rows(events, F.col("r"), F.lit("x"), F.col("k"), at=F.lit(None).cast("timestamp")), path)
    L.compact_events(spark, path, "2100-01-01")
    tasks = spark.createDataFrame([("r9", "a"), ("r1", "b"), ("r1", "a"), ("r1", "c")], "run_id string, task_id string")
    assert sorted(map(tuple, L.skip_logged(tasks, path, scope="all").collect())) == [("r1", "c")]
    assert sorted(map(tuple, L.skip_logged(tasks, path).collect())) == [("r1", "b"), ("r1", "c"), ("r9", "a")]
    assert L.skip_logged(tasks.where("false"), path).count() == 0


def test_stream_records(spark, tmp_path):
    source = str(tmp_path / "pages")
    other = PROFILE.replace("https://u.edu/people/wiel", "https://u.edu/people/bea")
    for i, (url, html) in enumerate([("https://u.edu/1", PROFILE), ("https://u.edu/2", PROFILE), ("https://u.edu/3", other)]):
        spark.createDataFrame([(url, html)], "url string, html string").coalesce(1).write.mode("append").parquet(source)
    stream = P.stream_pages(spark, source, files_per_trigger=1)
    query = J.append_records(J.stream_records(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    rows = spark.read.json(str(tmp_path / "out")).collect()
    assert sorted(r.page_url for r in rows) == ["https://u.edu/people/bea", "https://u.edu/people/wiel"]


def run_statuses(spark, tmp_path, parts, schema, name, **options):
    """The outcomes of a stream that gets one part a trigger, then a row of another task that moves the watermark past all."""
    source = str(tmp_path / name)
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.02)  # files are taken in the order of their times
    end = max(r[1] for part in parts for r in part) + dt.timedelta(days=200)
    spark.createDataFrame([("end", end, 10**9, "pending", None, None, None)], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = (J.stream_job_status(stream, lateness="100 days", **options).writeStream.format("memory").queryName(name).outputMode("append")
             .option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start())
    query.awaitTermination(300)
    if query.exception():
        raise query.exception()
    return sorted(tuple(r) for r in spark.table(name).collect())


OBSERVED = "task_id string, ts timestamp, seq long, status string, error string, result_json string, fetch_error string"


def test_stream_status_equals_batch(spark, tmp_path, statuses):  # noqa: F811
    rows = [tuple(r) for r in statuses.selectExpr("task_id", "cast(ts as timestamp)", "cast(seq as long)", "status", "error", "result_json", "fetch_error").collect()]
    got = run_statuses(spark, tmp_path, [rows[k::4] for k in range(4)], OBSERVED, "outcomes")
    assert {r[0]: (r[3], r[4]) for r in got if r[0] in EXPECTED} == EXPECTED


@pytest.mark.parametrize("seed", range(3))
def test_outcomes_do_not_hang_on_the_order_of_arrival(spark, tmp_path, seed):
    """Any order and split of the rows into triggers gives what the batch form gives; quiet tasks time out."""
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = [(f"t{rng.randint(0, 11)}", start + dt.timedelta(seconds=rng.randint(0, 2500), microseconds=rng.randint(0, 3)), k,
             rng.choice(["pending"] * 6 + ["processing", "completed", "failed", "odd", None]), rng.choice([None, "e"]), "{}",
             rng.choice([None] * 12 + ["net"])) for k in range(120)]
    rows += [("quiet", start, 1000, "pending", None, None, None), ("quiet", start + dt.timedelta(seconds=5), 1001, "processing", None, None, None)]
    want = sorted(tuple(r) for r in E.job_outcome(spark.createDataFrame(rows, OBSERVED), order="seq").collect())
    rng.shuffle(rows)
    cuts = sorted(rng.sample(range(1, len(rows)), 3))
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    got = run_statuses(spark, tmp_path, parts, OBSERVED, f"order{seed}")
    quiet = [r for r in got if r[0] == "quiet"]
    assert [r[:2] + r[3:5] for r in quiet] == [("quiet", start + dt.timedelta(days=1), False, "Polling timeout after 900s")]
    open_ = {r[0] for r in rows} - {w[0] for w in want}
    assert [r for r in got if r[0] not in open_] == want
    assert {r[0] for r in got} - {"end"} == {r[0] for r in rows}


def test_pruning_keeps_every_deciding_row():
    rng = random.Random(5)
    rows = pd.DataFrame([
        {"task_id": f"t{rng.randint(0, 5)}", "ts": pd.Timestamp(1_700_000_000 + rng.randint(0, 4000), unit="s"), "seq": i,
         "status": rng.choice(["pending"] * 40 + ["completed", "failed"]), "fetch_error": None} for i in range(3000)])
    rows = rows[(rows.task_id != "t0") | (rows.status == "pending")]

    def verdict(g):
        start = g.ts.min()
        g = g.sort_values(["ts", "seq"])
        return g[(g.status != "pending") | (g.ts > start + pd.Timedelta(seconds=900))].iloc[0].seq

    parts = [J.prune_observations(p.reset_index(drop=True)) for p in (rows.iloc[:1000], rows.iloc[1000:2200], rows.iloc[2200:])]
    kept = pd.concat(parts)
    assert len(kept) < len(rows)
    assert ({k: verdict(g) for k, g in kept.groupby("task_id")} == {k: verdict(g) for k, g in rows.groupby("task_id")})


def test_stream_skip_done(spark, tmp_path):
    source, log = str(tmp_path / "tasks"), str(tmp_path / "log")
    for batch in (["a", "b"], ["b", "c"], ["a", "d"]):
        spark.createDataFrame([(t,) for t in batch], "task_id string").coalesce(1).write.mode("append").parquet(source)
    worked = []
    stream = spark.readStream.schema("task_id string").option("maxFilesPerTrigger", 1).parquet(source)
    J.stream_skip_done(stream, "r", log, lambda df, _: worked.extend(r.task_id for r in df.collect()),
                       str(tmp_path / "cp3")).awaitTermination(120)
    assert sorted(worked) == ["a", "b", "c", "d"]
    assert L.read_events(spark, log).count() == 4


def test_stream_skip_done_reads_its_log_once(spark, tmp_path, monkeypatch):
    source, log, checkpoint = str(tmp_path / "tasks"), str(tmp_path / "log"), str(tmp_path / "cp4")
    L.log_events(L.event_rows(spark.createDataFrame([("r", "old"), ("other", "a")], "r string, t string"), F.col("r"), F.lit("page_fetched"), F.col("t")), log)
    reads, worked, read = [], [], L.read_events
    monkeypatch.setattr(J, "read_events", lambda *a: reads.append(a) or read(*a))

    def offer(*batches):
        for batch in batches:
            spark.createDataFrame([(t, "x") for t in batch], "task_id string, more string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("task_id string, more string").option("maxFilesPerTrigger", 1).parquet(source)
        return J.stream_skip_done(stream, "r", log, lambda df, _: worked.extend(r.task_id for r in df.collect()), checkpoint)

    offer(["a", "old", "a"], ["b", "old"], ["c"]).awaitTermination(120)
    assert sorted(worked) == ["a", "b", "c"] and len(reads) == 1
    # A restart goes on with its state, even where the log lost its rows.
    shutil.rmtree(log)
    offer(["a", "b", "old", "d"]).awaitTermination(120)
    assert sorted(worked) == ["a", "b", "c", "d"]


def test_sql_functions(spark):
    register_functions(spark)
    spark.createDataFrame([(PROFILE,)], "html string").createOrReplaceTempView("p")
    row = spark.sql("""
        SELECT clean_text(' a\t#b ') c, extract_emails('x a@b.org') e, email_valid('a@b.org') v,
               url_join('https://e.com/p', '?q=1') u, size(page_dom(html).nodes) n FROM p""").first()
    assert (row.c, row.e, row.v, row.u) == ("a b", ["a@b.org"], True, "https://e.com/p?q=1") and row.n > 20
    names = spark.sql("SELECT t.text FROM p, LATERAL html_nodes(html) t WHERE t.tag = 'h1'").collect()
    assert [r.text for r in names] == ["Prof. Tomas Wiel"]


def test_pages_with_status(spark):
    df = spark.createDataFrame([("https://E.com", "<p>", 404)], "link string, body string, status int")
    row = P.as_pages(df, "link", "body").first()
    assert row.status == 404 and len(row.task_id) == 64


def test_sql_url_join_equals_the_native_one(spark):
    register_functions(spark)
    bases = ["https://e.org/a/b?x=1#f", "http://E.org", "mailto:x@y", "", "https://e.org/a/b/../c/", None, "file:///a/b", " https://e.org/x;p=1"]
    refs = ["../c", "/d?q", "?z=1", "#g", "//h.org/x", "https://o.org/a b", "x/./y/../z", "", "mailto:a@b", None, ";p", "..", ".", "a//b", "g;x=1/../y"]
    spark.createDataFrame([(b, r) for b in bases for r in refs], "b string, r string").createOrReplaceTempView("joined")
    both = spark.sql("SELECT b, r, url_join(b, r) AS j FROM joined").withColumn("k", url_join("b", "r"))
    assert both.where("not (j <=> k)").collect() == []
    plan = spark.sql("SELECT n.tag FROM joined, LATERAL html_nodes(b) n")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
