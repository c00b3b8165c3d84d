"""Record tables: sources and sinks, schemas, quality, dedup, ranks. Records are customers and orders."""

from pyspark.sql import functions as F

from registry import query, scratch, table
from rosterline.operators import dedup, quality, ranking
from rosterline.operators.schema import RecordSchema, apply_schema, column_types, missing_required, validate_records
from rosterline.sources import records as files
from rosterline.sources import runlog

# The same text serves Spark and the oracle.
PEOPLE = {
    "seq": "c_custkey",
    "name": "CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_name END",
    "email": "CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 5 = 0 THEN 'bad-email' ELSE "
             "concat(lower(c_mktsegment), '.', CAST(c_custkey % 400 AS string), '@mail.example.org') END",
    "title": "CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN '  ' ELSE c_mktsegment END",
    "page_url": "CASE WHEN c_custkey % 17 = 0 THEN '' WHEN c_custkey % 19 = 0 THEN 'ftp://dir.example.org' ELSE "
                "concat('https://dir.example.org/people/', CAST(c_custkey - c_custkey % 2 AS string)) END",
    "org": "c_mktsegment",
    "age": "CASE WHEN c_custkey % 4 = 0 THEN 'n/a' ELSE CAST(c_nationkey AS string) END",
}
PEOPLE_SQL = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in PEOPLE.items()) + " FROM customer"
FIELDS = ["name", "email", "title", "page_url", "org", "age"]


def people(spark, d):
    return table(spark, d, "customer").selectExpr(*[f"{e} AS {c}" for c, e in PEOPLE.items()])


# --- sources and sinks -----------------------------------------------------------------------

ROUND_TRIP_SQL = f"SELECT seq, name, nullif(email, '') AS email, org FROM ({PEOPLE_SQL})"


def _plain(spark, d):
    return people(spark, d).select("seq", "name", F.nullif("email", F.lit("")).alias("email"), "org")


def _round_trip(spark, d, fmt):
    path = scratch(spark, f"people.{fmt}")
    files.write_records(_plain(spark, d), path)
    return files.read_records(spark, path, schema="seq bigint, name string, email string, org string")


@query("read_jsonl", ROUND_TRIP_SQL)
def read_jsonl(spark, d):
    path = scratch(spark, "people.jsonl")
    files.write_jsonl(_plain(spark, d), path)
    return files.read_jsonl(spark, path).select("seq", "name", "email", "org")


@query("read_csv", f"SELECT seq, nullif(name, '') AS name, email, org FROM ({ROUND_TRIP_SQL})")
def read_csv(spark, d):
    path = scratch(spark, "people.csv")
    files.write_csv(_plain(spark, d), path)
    back = files.read_csv(spark, path)
    return back.select(F.col("seq").cast("bigint"), F.nullif("name", F.lit("")).alias("name"), "email", "org")


@query("read_parquet", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def read_parquet(spark, d):
    return files.read_parquet(spark, f"{d}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment")


@query("write_jsonl", ROUND_TRIP_SQL)
def write_jsonl(spark, d):
    return _round_trip(spark, d, "jsonl")


@query("append_jsonl", f"SELECT seq, count(*) AS n FROM ({PEOPLE_SQL}) CROSS JOIN (SELECT unnest([1, 2])) GROUP BY seq")
def append_jsonl(spark, d):
    path = scratch(spark, "people.jsonl")
    for _ in range(2):
        files.append_jsonl(_plain(spark, d), path)
    return files.read_jsonl(spark, path, "seq bigint").groupBy("seq").agg(F.count("*").alias("n"))


@query("write_csv", f"SELECT seq, nullif(name, '') AS name, email, org FROM ({ROUND_TRIP_SQL})")
def write_csv(spark, d):
    return _round_trip(spark, d, "csv").withColumn("name", F.nullif("name", F.lit("")))


@query("write_parquet", ROUND_TRIP_SQL)
def write_parquet(spark, d):
    return _round_trip(spark, d, "parquet")


@query("records_io", f"SELECT org, count(*) AS n, count(email) AS mails FROM ({ROUND_TRIP_SQL}) GROUP BY org")
def records_io(spark, d):
    return _round_trip(spark, d, "parquet").groupBy("org").agg(F.count("*").alias("n"), F.count("email").alias("mails"))


SCHEMA = RecordSchema.of({"fields": [
    {"name": "name", "type": "str", "pattern": "^Customer"}, {"name": "email", "type": "email?"},
    {"name": "page_url", "type": "url"}, {"name": "age", "type": "int?"}, {"name": "phone", "type": "str?"},
]})


@query("apply_schema", f"""
    SELECT seq, name, email, page_url, try_cast(age AS BIGINT) AS age, '' AS phone FROM ({PEOPLE_SQL})""")
def apply_schema_query(spark, d):
    return apply_schema(people(spark, d), SCHEMA).select("seq", "name", "email", "page_url", "age", "phone")


MAIL_OK = r"regexp_matches(email, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\n?\z')"


@query("validate_records", f"""
    SELECT seq, concat_ws('; ', CASE WHEN name = '' THEN 'name: missing' END,
        CASE WHEN email <> '' AND NOT {MAIL_OK} THEN 'email: not email' END,
        CASE WHEN page_url = '' THEN 'page_url: missing' WHEN page_url NOT LIKE 'http%' THEN 'page_url: not url' END,
        CASE WHEN try_cast(age AS BIGINT) IS NULL THEN 'age: not int' END) AS violations FROM ({PEOPLE_SQL})""")
def validate(spark, d):
    return validate_records(people(spark, d), SCHEMA).select("seq", F.array_join("violations", "; ").alias("violations"))


@query("missing_required", f"""
    SELECT seq, concat_ws(',', CASE WHEN name = '' THEN 'name' END, CASE WHEN page_url = '' THEN 'page_url' END) AS missing
    FROM ({PEOPLE_SQL})""")
def missing(spark, d):
    records = people(spark, d)
    return records.select("seq", F.array_join(missing_required(SCHEMA, column_types(records)), ",").alias("missing"))


# --- run history -----------------------------------------------------------------------------

DAY = "yyyy-MM-dd HH:mm:ss"


@query("run_log", """
    SELECT user_id::VARCHAR AS run_id, arg_max(event_id, (ts, event_id)) AS pages_fetched,
        arg_max('https://dir.example.org/' || event_id, ts) FILTER (WHERE event_type = 'view') AS start_url,
        0::BIGINT AS pages_failed FROM events GROUP BY user_id""")
def run_log(spark, d):
    updates = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("run_id"), F.col("ts").cast("timestamp").alias("at"),
        F.col("event_id").alias("pages_fetched"),
        F.when(F.col("event_type") == "view", F.concat(F.lit("https://dir.example.org/"), "event_id")).alias("start_url"))
    path = scratch(spark, "runs")
    runlog.log_run(updates, path, F.col("at"))
    return runlog.latest_runs(spark.read.parquet(path)).select("run_id", "pages_fetched", "start_url", "pages_failed")


@query("event_log", """
    SELECT event_type AS run_id, user_id::VARCHAR AS key, count(*) AS n, max('{"value":' || event_id || '}') AS meta
    FROM events GROUP BY event_type, user_id""")
def event_log(spark, d):
    path = scratch(spark, "log")
    runlog.log_events(runlog.event_rows(
        table(spark, d, "events"), F.col("event_type"), F.lit("page_fetched"), F.col("user_id").cast("string"),
        F.struct(F.col("event_id").alias("value")), F.col("ts").cast("timestamp")), path)
    log = runlog.read_events(spark, path)
    return log.groupBy("run_id", "key").agg(F.count("*").alias("n"), F.max("meta_json").alias("meta"))


def _event_log(spark, d, run_id):
    return table(spark, d, "events").select(run_id.alias("run_id"), F.col("user_id").cast("string").alias("key"))


@query("skip_done", """
    SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)""")
def skip_done(spark, d):
    tasks = table(spark, d, "customer").select(
        F.lit("run").alias("run_id"), F.col("c_custkey").cast("string").alias("task_id"), "c_custkey")
    return runlog.skip_done(tasks, _event_log(spark, d, F.lit("run"))).select("c_custkey")


RUN_OF = "array('view', 'click', 'purchase', 'error', 'signup')[CAST(c_custkey % 5 AS int)]"


@query("done_antijoin", """
    SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = c.c_custkey
        AND e.event_type = ['view', 'click', 'purchase', 'error', 'signup'][(c.c_custkey % 5 + 1)::INT])""")
def done_antijoin(spark, d):
    tasks = table(spark, d, "customer").select(
        F.expr(RUN_OF).alias("run_id"), F.col("c_custkey").cast("string").alias("task_id"), "c_custkey")
    return runlog.skip_done(tasks, _event_log(spark, d, F.col("event_type"))).select("c_custkey")


@query("skip_logged", """
    SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = c.c_custkey
        AND e.event_id % 100 = c.c_custkey % 7)""")
def skip_logged(spark, d):
    """Tasks of seven of a hundred runs, against a stored log whose closed days were compacted."""
    path = scratch(spark, "log")
    runlog.log_events(runlog.event_rows(
        table(spark, d, "events"), (F.col("event_id") % 100).cast("string"), F.lit("page_fetched"), F.col("user_id").cast("string"),
        at=F.col("ts").cast("timestamp")), path)
    runlog.compact_events(spark, path, "2024-01-10")
    tasks = table(spark, d, "customer").select(
        (F.col("c_custkey") % 7).cast("string").alias("run_id"), F.col("c_custkey").cast("string").alias("task_id"), "c_custkey")
    return runlog.skip_logged(tasks, path).select("c_custkey")


# --- quality ---------------------------------------------------------------------------------

KEYS = ["name", "email"]
KEY_SQL = ("CASE WHEN name <> '' OR email <> '' THEN concat_ws('|', nullif(lower(trim(name)), ''), "
           "nullif(lower(trim(email)), '')) END")


def _filled(c):
    return f"count(*) FILTER (WHERE {c} IS NOT NULL AND trim({c}) <> '')"


COMPLETENESS_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS field, {_filled(c)}::DOUBLE / count(*) * 100 AS percent FROM p" for c in FIELDS)
EMAIL_SQL = f"""SELECT 'email' AS field, count(*) FILTER (WHERE trim(email) <> '' AND {MAIL_OK})::DOUBLE
    / {_filled('email')} * 100 AS percent FROM p"""
URL_SQL = f"""SELECT 'page_url' AS field, count(*) FILTER (WHERE regexp_matches(page_url, '^https?://'))::DOUBLE
    / {_filled('page_url')} * 100 AS percent FROM p"""
P = f"WITH p AS ({PEOPLE_SQL}) "
DUPLICATES_SQL = f"""SELECT count(*) AS total_records, count(DISTINCT {KEY_SQL}) AS unique_records,
    count({KEY_SQL}) - count(DISTINCT {KEY_SQL}) AS duplicates FROM p"""
STATUS_SQL = ("CASE WHEN value >= {0} THEN '✅' WHEN value >= {1} THEN '⚠️' ELSE '❌' END")


def _records(spark, d):
    return people(spark, d).select(*FIELDS)


@query("duplicate_stats", P + DUPLICATES_SQL)
def duplicate_stats(spark, d):
    return quality.duplicate_stats(_records(spark, d), KEYS)


@query("field_completeness", P + COMPLETENESS_SQL)
def field_completeness(spark, d):
    return quality.field_completeness(_records(spark, d))


@query("email_validity", P + EMAIL_SQL)
def email_validity(spark, d):
    return quality.validity(_records(spark, d).select("email"))


@query("url_validity", P + URL_SQL)
def url_validity(spark, d):
    return quality.validity(_records(spark, d).select("page_url"))


REPORT_SQL = f"""
    d AS ({DUPLICATES_SQL}), c AS ({COMPLETENESS_SQL}), v AS ({EMAIL_SQL} UNION ALL {URL_SQL}),
    t AS (SELECT 'overview' AS section, '' AS field, 'total_records' AS metric, total_records::DOUBLE AS value FROM d
      UNION ALL SELECT 'overview', '', 'unique_records', unique_records FROM d
      UNION ALL SELECT 'overview', '', 'duplicates', duplicates FROM d
      UNION ALL SELECT 'overview', '', 'duplicate_rate', duplicates::DOUBLE / total_records FROM d
      UNION ALL SELECT 'completeness', field, 'percent', percent FROM c
      UNION ALL SELECT 'validity', field, 'percent', percent FROM v),
    r AS (SELECT *, CASE section WHEN 'completeness' THEN {STATUS_SQL.format(90, 50)}
        WHEN 'validity' THEN {STATUS_SQL.format(95, 80)} END AS status FROM t)"""


@query("quality_report", P + "," + REPORT_SQL + " SELECT section, field, metric, value, status FROM r")
def quality_report(spark, d):
    return quality.quality_report(_records(spark, d), KEYS)


@query("report_status", P + "," + REPORT_SQL + " SELECT field, section, status FROM r WHERE status IS NOT NULL")
def report_status(spark, d):
    report = quality.quality_report(_records(spark, d), KEYS)
    return report.where("status IS NOT NULL").select("field", "section", "status")


@query("report_table", P + "," + REPORT_SQL + " SELECT section, field, metric, value, status FROM r")
def report_table(spark, d):
    path = scratch(spark, "report.parquet")
    files.write_records(quality.quality_report(_records(spark, d), KEYS), path)
    return files.read_records(spark, path)


@query("quality_warnings", P + "," + f"""
    d AS ({DUPLICATES_SQL}), c AS ({COMPLETENESS_SQL}), v AS ({EMAIL_SQL}),
    n AS (SELECT {_filled('email')} AS mails, count(*) FILTER (WHERE trim(email) <> '' AND {MAIL_OK}) AS good FROM p)
    SELECT 0::BIGINT AS ord, 'Found ' || duplicates || ' duplicates (' || printf('%.1f', duplicates::DOUBLE / total_records
        * 100) || '%) based on [''name'', ''email'']' AS warning FROM d WHERE duplicates > 0
    UNION ALL SELECT CASE field WHEN 'name' THEN 1 ELSE 2 END, 'Low completeness for ''' || field || ''': '
        || printf('%.1f', percent) || '%' FROM c WHERE field IN ('name', 'page_url') AND percent < 90
    UNION ALL SELECT 3, 'Email validity: ' || printf('%.1f', percent) || '% (' || good || '/' || mails || ')'
        FROM v, n WHERE percent < 95
    UNION ALL SELECT 4, 'Very low record count: ' || total_records || ' (expected more for directory scraping)'
        FROM d WHERE total_records < 10
    UNION ALL SELECT 5, 'Record count ' || total_records || ' is below expected minimum 1000000 (difference: '
        || (1000000 - total_records) || ', ' || printf('%.1f', (1000000 - total_records)::DOUBLE / 1000000 * 100) || '%)'
        FROM d WHERE total_records < 1000000
    UNION ALL SELECT 6, 'Record count ' || total_records || ' is above expected maximum 100 (difference: '
        || (total_records - 100) || ', ' || printf('%.1f', (total_records - 100)::DOUBLE) || '%)'
        FROM d WHERE total_records > 100""")
def quality_warnings(spark, d):
    return quality.quality_warnings(_records(spark, d), KEYS, 1_000_000, 100)


@query("count_within_tolerance", """
    SELECT count(*) AS n, 14250::BIGINT AS low, 15750::BIGINT AS high, count(*) BETWEEN 14250 AND 15750 AS passed
    FROM orders""")
def count_within_tolerance(spark, d):
    return quality.count_within_tolerance(table(spark, d, "orders"), 15_000)


# --- dedup, ranks, sets ----------------------------------------------------------------------


@query("dedup_by_keys", f"""
    WITH p AS ({PEOPLE_SQL}), k AS (SELECT *, {KEY_SQL} AS key FROM p)
    SELECT seq, name, email FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM k)
    WHERE key IS NULL OR n = 1""")
def dedup_by_keys(spark, d):
    return dedup.dedup_by_keys(people(spark, d), KEYS).select("seq", "name", "email")


@query("dedup_record_id", f"""
    WITH p AS ({PEOPLE_SQL}), k AS (SELECT *, substr(sha256(CASE WHEN page_url <> '' THEN page_url
        WHEN name <> '' OR email <> '' THEN {KEY_SQL} ELSE 'https://dir.example.org' END), 1, 16) AS record_id FROM p)
    SELECT seq, record_id FROM k QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY seq) = 1""")
def dedup_record_id(spark, d):
    records = people(spark, d).withColumn("source_url", F.lit("https://dir.example.org"))
    return dedup.dedup_record_id(records).select("seq", "record_id")


@query("top_k_links", """
    SELECT o_custkey, o_orderkey FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 5""")
def top_k_links(spark, d):
    links = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return ranking.top_k_links(links, "o_custkey", "o_orderkey", 5)


@query("call_budget", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 1000")
def call_budget(spark, d):
    return ranking.call_budget(table(spark, d, "orders").select("o_orderkey", "o_custkey"), 1000, "o_orderkey")


@query("sort_by_score", """
    SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS place FROM customer""")
def sort_by_score(spark, d):
    scored = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return ranking.with_global_rank(scored, [F.desc("c_acctbal"), "c_custkey"], "place").select("c_custkey", "place")


@query("sample_n", "SELECT o_orderkey FROM orders ORDER BY sha256('7' || chr(31) || o_orderkey), o_orderkey LIMIT 500")
def sample_n(spark, d):
    return ranking.sample_n(table(spark, d, "orders").select("o_orderkey"), 500, ["o_orderkey"], 7)


@query("first_names", "SELECT c_name, c_custkey FROM customer ORDER BY c_name, c_custkey LIMIT 100")
def first_names(spark, d):
    return ranking.first_n(table(spark, d, "customer").select("c_name", "c_custkey"), ["c_name", "c_custkey"], 100)


@query("union_records", """
    SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer
    UNION ALL SELECT s_name, s_nationkey, NULL FROM supplier""")
def union_records(spark, d):
    customers = table(spark, d, "customer").selectExpr("c_name AS name", "c_nationkey AS nation", "c_mktsegment AS segment")
    suppliers = table(spark, d, "supplier").selectExpr("s_name AS name", "s_nationkey AS nation")
    return dedup.union_records(customers, suppliers)


@query("distinct_values", "SELECT DISTINCT o_custkey FROM orders")
def distinct_values(spark, d):
    return dedup.distinct_values(table(spark, d, "orders"), "o_custkey")
