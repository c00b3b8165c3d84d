"""Second-source filling, enrichment and streams. Events play status observations, conversations play answers."""

import pandas as pd
from pyspark.sql import functions as F

from registry import directory, query, scratch, table
from registry.records import PEOPLE_SQL, SCHEMA, people
from registry.scalars import EMAIL_SQL, clean_sql
from rosterline.functions.sql import register_functions
from rosterline.operators import enrich, fill
from rosterline.operators.schema import PERSON, RecordSchema
from rosterline.sources import runlog
from rosterline.sources.pages import stream_pages
from rosterline.streaming import jobs as streams

# --- second source ---------------------------------------------------------------------------

PROMPT_SCHEMA = RecordSchema.of({"name": "str", "email": "email?"})


@query("build_prompt", """
    SELECT doc_id, 'SCHEMA (JSON keys/types):' || chr(10) || '{' || chr(10) || '  "name": "str",' || chr(10)
        || '  "email": "email?"' || chr(10) || '}' || chr(10) || chr(10) || 'EXTRACT from this TEXT (already DOM-cleaned):'
        || chr(10) || '\"\"\"' || chr(10) || CASE WHEN length(text) <= 4000 THEN text ELSE substring(text, 1, 4000) || '...' END
        || chr(10) || '\"\"\"' || chr(10) || chr(10) || 'Return ONLY JSON with the schema keys.' AS prompt FROM documents""")
def build_prompt(spark, d):
    return table(spark, d, "documents").select("doc_id", fill.build_prompt("text", PROMPT_SCHEMA, 4000).alias("prompt"))


ANSWER = """CASE (conv_id + turn) % 4
    WHEN 0 THEN concat('Sure: ```json\\n{"name": "n', conv_id, '", "role": "', role, '"}\\n``` done')
    WHEN 1 THEN concat('```\\n{"name": "n', conv_id, '", "role": null}\\n```')
    WHEN 2 THEN concat('{"name": "n', conv_id, '", "role": {"is": "', role, '"}}')
    ELSE concat('{"name": "n', conv_id) END"""
PARSED_SQL = """SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 4 < 3 THEN 'n' || conv_id END AS name,
    CASE (conv_id + turn) % 4 WHEN 0 THEN role WHEN 2 THEN '{"is":"' || role || '"}' END AS role FROM conversations"""


def answers(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
        F.concat(F.lit("https://dir.example.org/c/"), "conv_id").alias("url"), F.expr(ANSWER).alias("response"))


@query("parse_response_json", PARSED_SQL)
def parse_response_json(spark, d):
    parsed = answers(spark, d).withColumn("m", fill.parse_response_json("response"))
    return parsed.select("conv_id", "turn", F.col("m")["name"].alias("name"), F.col("m")["role"].alias("role"))


@query("llm_records", f"""
    SELECT conv_id, turn, name, 'https://dir.example.org/c/' || conv_id AS page_url FROM ({PARSED_SQL})
    WHERE name IS NOT NULL ORDER BY conv_id * 1000 + turn LIMIT 200""")
def llm_records(spark, d):
    found = fill.llm_records(answers(spark, d), budget=200)
    return found.select("conv_id", "turn", F.col("answer")["name"].alias("name"), F.col("answer")["page_url"].alias("page_url"))


@query("normalize_field", """
    SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'role ' || role ELSE role END AS role, 'Normalize this role field value:'
        || chr(10) || '        ' || chr(10) || 'Input: "' || role || '"' || chr(10) || chr(10)
        || 'Return only the cleaned/normalized value, nothing else.' AS prompt FROM conversations""")
def normalize_field(spark, d):
    asked = table(spark, d, "conversations").withColumn(
        "answer", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("\n role "), "role", F.lit(" "))))
    return asked.select("conv_id", "turn", fill.normalize_field("role", "answer").alias("role"),
                        fill.normalize_prompt("role", "role").alias("prompt"))


FILL_SCHEMA = RecordSchema.of({"title": "str", "org": "str", "lang": "str?"})


def _gaps(spark, d):
    records = table(spark, d, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("source")).alias("title"),
        F.when(F.col("lang") == "en", F.lit(None)).otherwise(F.col("lang")).alias("org"))
    offered = table(spark, d, "labels").select("doc_id", F.create_map(
        F.lit("title"), F.concat(F.lit("q"), "quality"),
        F.lit("org"), F.when(F.col("toxic") == 1, F.lit("")).otherwise("t0")).alias("answer"))
    return records, offered


FILLED_SQL = """
    WITH r AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS title,
        CASE WHEN lang = 'en' THEN NULL ELSE lang END AS org FROM documents)
    SELECT r.doc_id, CASE WHEN title <> '' THEN title WHEN quality IS NOT NULL THEN 'q' || quality ELSE title END AS title,
        CASE WHEN org <> '' THEN org WHEN toxic = 0 THEN 't0' ELSE org END AS org
    FROM r LEFT JOIN labels l ON l.doc_id = r.doc_id"""


@query("hybrid_fill", FILLED_SQL)
def hybrid_fill(spark, d):
    return fill.hybrid_fill(*_gaps(spark, d), "doc_id", FILL_SCHEMA).select("doc_id", "title", "org")


@query("fill_missing", f"SELECT title, org, count(*) AS n FROM ({FILLED_SQL}) GROUP BY title, org")
def fill_missing(spark, d):
    filled = fill.hybrid_fill(*_gaps(spark, d), "doc_id", FILL_SCHEMA)
    return filled.groupBy("title", "org").agg(F.count("*").alias("n"))


def _fake_provider(batch: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"seq": batch["seq"], "response": '{"name": "p' + batch["seq"].astype(str) + '"}'})


@query("provider_udf", f"""
    SELECT seq, 'p' || seq AS name FROM ({PEOPLE_SQL}) WHERE name = '' OR page_url = '' ORDER BY seq LIMIT 100""")
def provider_udf(spark, d):
    lacking = fill.needs_fill(people(spark, d), SCHEMA).select("seq")
    replies = fill.call_provider(lacking, _fake_provider, "seq long, response string", budget=100)
    return replies.select("seq", fill.parse_response_json("response")["name"].alias("name"))


# --- enrichment ------------------------------------------------------------------------------

KEY_SQL = "substr(sha256(name || '_' || page_url), 1, 16)"


@query("enrich_request", f"""
    SELECT seq, name, org AS company, nullif(regexp_extract(page_url, '^[a-z]+://([^/]*)', 1), '') AS domain,
        NULL::VARCHAR AS linkedin_url, email FROM ({PEOPLE_SQL})""")
def enrich_request(spark, d):
    return enrich.enrich_request(people(spark, d), "seq")


@query("lead_info", f"""
    SELECT seq, '{{"name":"' || name || '","company":"Acme","title":"' || coalesce(title, '') || '","location":""'
        || CASE WHEN email <> '' THEN ',"email":"' || email || '"' ELSE '' END
        || CASE WHEN page_url <> '' THEN ',"profile_url":"' || page_url || '"' ELSE '' END || '}}' AS lead
    FROM ({PEOPLE_SQL})""")
def lead_info(spark, d):
    records = people(spark, d)
    return records.select("seq", enrich.lead_info(records, "Acme").alias("lead"))


@query("idempotency_key", f"SELECT seq, {KEY_SQL} AS key FROM ({PEOPLE_SQL})")
def idempotency_key(spark, d):
    return enrich.with_idempotency_key(people(spark, d)).select("seq", F.col("idempotency_key").alias("key"))


# One submission per customer outside MACHINERY; keys of records without a name and URL coincide.
SENT_SQL = f"""sent AS (SELECT {KEY_SQL} AS k, max((seq % 150)::VARCHAR) AS task_id
    FROM ({PEOPLE_SQL}) WHERE org <> 'MACHINERY' GROUP BY 1)"""


def _sent(spark, d):
    return enrich.with_idempotency_key(people(spark, d)).where("org <> 'MACHINERY'").select(
        "idempotency_key", (F.col("seq") % 150).cast("string").alias("task_id"))


@query("submit_outcome", f"""WITH {SENT_SQL} SELECT seq, task_id,
    CASE WHEN task_id IS NULL THEN 'Failed to submit enrichment job' END AS error
    FROM ({PEOPLE_SQL}) p LEFT JOIN sent ON sent.k = {KEY_SQL}""")
def submit_outcome(spark, d):
    return enrich.submit_outcome(people(spark, d), _sent(spark, d)).select("seq", "task_id", "error")


RESULT = ("concat('{\"structured_data\":{\"phone\":\"', event_id, '\",\"title\":\"\"},\"notes\":\"n\",\"confidence_score\":',"
          "event_id % 10, '.5,\"references\":{\"https://a.example.org\":\"x\",\"https://b.example.org\":\"y\"}}')")
STATUS = ("CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' "
          "WHEN 'error' THEN 'failed' ELSE event_type END")
OUTCOME_SQL = """
    s AS (SELECT *, min(ts) OVER (PARTITION BY user_id) AS t0 FROM events),
    decided AS (SELECT * FROM s WHERE event_type NOT IN ('view', 'click') OR epoch_us(ts) - epoch_us(t0) > 900000000),
    outcome AS (SELECT user_id::VARCHAR AS task_id, event_id, ts, event_type,
        event_type = 'purchase' AS success, CASE event_type WHEN 'purchase' THEN NULL
            WHEN 'error' THEN 'Job failed: ' || coalesce('e' || nullif(event_id % 3, 0), 'Unknown error')
            WHEN 'signup' THEN 'Unknown status: signup' ELSE 'Polling timeout after 900s' END AS error
        FROM decided QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1)"""


def statuses(spark, d):
    return table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("task_id"), "ts", F.col("event_id").alias("seq"),
        F.expr(STATUS).alias("status"),
        F.when((F.col("event_type") == "error") & (F.col("event_id") % 3 > 0), F.concat(F.lit("e"), F.col("event_id") % 3))
        .alias("error"),
        F.when(F.col("event_type") == "purchase", F.expr(RESULT)).alias("result_json"))


STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


@query("job_outcome", f"""WITH {OUTCOME_SQL} SELECT task_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at, success, error
    FROM outcome""")
def job_outcome(spark, d):
    return enrich.job_outcome(statuses(spark, d), order="seq").select(
        "task_id", F.date_format("ts", STAMP).alias("at"), "success", "error")


@query("parse_result", """
    SELECT event_id, event_id::VARCHAR AS phone, '' AS title, 'n' AS notes, (event_id % 10) || '.5' AS confidence,
        '["https://a.example.org","https://b.example.org"]' AS sources, 5::BIGINT AS n_fields FROM events""")
def parse_result(spark, d):
    parsed = table(spark, d, "events").select("event_id", enrich.parse_result(F.expr(RESULT)).alias("m"))
    return parsed.select(
        "event_id", *[F.col("m")[k].alias(n) for n, k in (
            ("phone", "phone"), ("title", "title"), ("notes", "_enrichment_notes"),
            ("confidence", "_enrichment_confidence"), ("sources", "_enrichment_sources"))],
        F.size(F.map_keys("m")).cast("bigint").alias("n_fields"))


BATCH_SQL = f"""WITH {SENT_SQL}, {OUTCOME_SQL},
    batch AS (SELECT p.*, {KEY_SQL} AS k, coalesce(o.success, false) AS success, o.event_id,
        CASE WHEN sent.task_id IS NULL THEN 'Failed to submit enrichment job' ELSE o.error END AS error
        FROM ({PEOPLE_SQL}) p LEFT JOIN sent ON sent.k = {KEY_SQL} LEFT JOIN outcome o USING (task_id))"""


def _batch(spark, d):
    return enrich.enrich_batch(people(spark, d), _sent(spark, d), statuses(spark, d), order="seq")


@query("enrich_batch", f"{BATCH_SQL} SELECT seq, success, error, CASE WHEN success THEN event_id::VARCHAR END AS phone FROM batch")
def enrich_batch(spark, d):
    return _batch(spark, d).select("seq", "success", "error", F.col("enriched")["phone"].alias("phone"))


APPLIED_SQL = """SELECT seq, CASE WHEN success THEN '' ELSE title END AS title, email,
    CASE WHEN success THEN event_id::VARCHAR END AS phone,
    CASE WHEN success THEN (event_id % 10) || '.5' END AS confidence FROM batch"""


@query("enrich_apply", f"{BATCH_SQL} {APPLIED_SQL}")
def enrich_apply(spark, d):
    merged = enrich.enrich_apply(_batch(spark, d))
    return merged.select("seq", "title", "email", "phone", F.col("_enrichment_confidence").alias("confidence"))


@query("enrich_merge", f"{BATCH_SQL} {APPLIED_SQL}")
def enrich_merge(spark, d):
    merged = enrich.enrich_merge(people(spark, d), _batch(spark, d))
    return merged.select("seq", "title", "email", "phone", F.col("_enrichment_confidence").alias("confidence"))


@query("enrich_summary", f"""{BATCH_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE success) AS successes,
    count(*) FILTER (WHERE success) * 100.0::DOUBLE / count(*) AS success_rate,
    '_enrichment_confidence,_enrichment_notes,_enrichment_sources,phone,title' AS fields FROM batch""")
def enrich_summary(spark, d):
    return enrich.enrich_summary(_batch(spark, d)).withColumn("fields", F.array_join("fields", ","))


@query("http_outcome", """
    WITH a AS (SELECT event_id // 2 AS k, event_id % 2 + 1 AS attempt, CASE event_type WHEN 'view' THEN 200
        WHEN 'click' THEN 429 WHEN 'purchase' THEN 503 WHEN 'error' THEN 404 END AS code FROM events),
    r AS (SELECT *, coalesce(code = 429 OR code >= 500, false) AS retry FROM a)
    SELECT k::VARCHAR AS key, coalesce(code = 200, false) AS success, CASE WHEN code = 200 THEN NULL WHEN code IS NULL
        THEN 'timeout' ELSE 'HTTP ' || code || ': timeout' END AS error FROM r
    QUALIFY row_number() OVER (PARTITION BY k ORDER BY retry, CASE WHEN retry THEN -attempt ELSE attempt END) = 1""")
def http_outcome(spark, d):
    attempts = table(spark, d, "events").select(
        F.floor(F.col("event_id") / 2).cast("string").alias("idempotency_key"),
        (F.col("event_id") % 2 + 1).cast("int").alias("attempt"),
        F.expr("CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 429 WHEN 'purchase' THEN 503 WHEN 'error' THEN 404 END")
        .alias("code"),
        F.lit("timeout").alias("error"), F.lit("{}").alias("result_json"))
    return enrich.http_outcome(attempts).select(F.col("idempotency_key").alias("key"), "success", "error")


# --- streams ---------------------------------------------------------------------------------


def _drain(stream, spark, name, schema):
    out = scratch(spark, name)
    run = (stream.writeStream.format("parquet").outputMode("append").option("path", out)
           .option("checkpointLocation", scratch(spark, "progress")).trigger(availableNow=True).start())
    run.awaitTermination()
    if run.exception():
        raise run.exception()
    return spark.read.schema(schema).parquet(out)


@query("stream_pages_to_records", f"{directory.DETAIL} SELECT {directory.RECORD}, substr(sha256(url), 1, 16) AS record_id FROM d")
def stream_pages_to_records(spark, d):
    source = scratch(spark, "pages")
    directory.detail_pages(spark, d).write.parquet(source)
    out = scratch(spark, "records.jsonl")
    run = streams.append_records(streams.stream_records(stream_pages(spark, source)), out, scratch(spark, "progress"))
    run.awaitTermination()
    if run.exception():
        raise run.exception()
    return spark.read.schema(", ".join(f"{c} string" for c in [*PERSON.names, "record_id"])).json(out)


# A verdict is out once the watermark has passed it; a task that had none a day after its start has timed out then.
@query("stream_job_status", f"""WITH {OUTCOME_SQL},
    begun AS (SELECT user_id::VARCHAR AS task_id, min(ts) + INTERVAL 1 DAY AS silent FROM events GROUP BY 1),
    closed AS (SELECT task_id, least(coalesce(ts, silent), silent) AS fin, coalesce(ts, silent) > silent OR ts IS NULL AS quiet, success, error
        FROM begun LEFT JOIN outcome USING (task_id))
    SELECT task_id, strftime(fin, '%Y-%m-%d %H:%M:%S.%f') AS at, CASE WHEN quiet THEN false ELSE success END AS success,
        CASE WHEN quiet THEN 'Polling timeout after 900s' ELSE error END AS error
    FROM closed WHERE fin <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_job_status(spark, d):
    source = scratch(spark, "statuses")
    observed = statuses(spark, d).withColumns({
        "ts": F.col("ts").cast("timestamp"), "fetch_error": F.lit(None).cast("string")})
    observed.write.parquet(source)
    stream = spark.readStream.schema(observed.schema).parquet(source)
    closed = _drain(streams.stream_job_status(stream), spark, "outcomes", streams.OUTCOME_TYPE)
    return closed.select("task_id", F.date_format("ts", STAMP).alias("at"), "success", "error")


@query("stream_skip_done", "SELECT DISTINCT user_id::VARCHAR AS key FROM events")
def stream_skip_done(spark, d):
    log, source = scratch(spark, "log"), scratch(spark, "tasks")
    table(spark, d, "events").select(F.col("user_id").cast("string").alias("task_id")).write.parquet(source)
    tasks = spark.readStream.schema("task_id string").option("maxFilesPerTrigger", 1).parquet(source)
    done = scratch(spark, "worked")
    run = streams.stream_skip_done(
        tasks, "run", log, lambda batch, _: batch.select("task_id").write.mode("append").parquet(done),
        scratch(spark, "progress"))
    run.awaitTermination()
    if run.exception():
        raise run.exception()
    return spark.read.schema("task_id string").parquet(done).withColumnRenamed("task_id", "key")


# --- SQL surface -----------------------------------------------------------------------------


@query("sql_functions", f"""
    SELECT doc_id, {clean_sql('text')} AS cleaned, len(regexp_extract_all(text, '{EMAIL_SQL}'))::BIGINT AS mails,
        'https://dir.example.org/d/' || doc_id AS link FROM documents""")
def sql_functions(spark, d):
    register_functions(spark)
    return spark.sql(
        "SELECT doc_id, clean_text(text) AS cleaned, CAST(size(extract_emails(text)) AS BIGINT) AS mails, "
        "url_join('https://dir.example.org/d/', CAST(doc_id AS STRING)) AS link FROM {documents}",
        documents=table(spark, d, "documents"))


@query("sql_nodes", f"{directory.LISTED} SELECT lists.url, name AS text, 4 AS depth FROM m JOIN lists USING (n, p)")
def sql_nodes(spark, d):
    """Names on cards, by a lateral join of pages with their own nodes."""
    register_functions(spark)
    return spark.sql("SELECT url, t.text, t.depth FROM {pages} p, LATERAL html_nodes(p.html) t WHERE t.tag = 'h3'", pages=directory.list_pages(spark, d))


@query("sql_scalars", """
    SELECT c_custkey, sha256(c_name) AS hash, c_custkey % 2 = 0 AS valid, '555-010-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS phone,
        'https://dir.example.org/a/' || c_custkey || '?x=1' AS link FROM customer""")
def sql_scalars(spark, d):
    register_functions(spark)
    return spark.sql(
        "SELECT c_custkey, content_hash(c_name) AS hash, email_valid(concat('c', c_custkey, if(c_custkey % 2 = 0, '@mail.example.org', '@mail'))) AS valid, "
        "extract_phones(concat('call 555-010-', lpad(c_custkey % 10000, 4, '0'), ' now'))[0] AS phone, "
        "url_join('https://dir.example.org/a/b/../c#d', concat('./', c_custkey, '?x=1')) AS link FROM {customer}", customer=table(spark, d, "customer"))
