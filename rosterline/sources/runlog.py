"""Run history and event log as append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from rosterline.session import materialize

# What a run row holds besides its id and time.
RUN_FIELDS = {
    "started_at": "timestamp", "completed_at": "timestamp", "start_url": "string", "schema_json": "string",
    "pages_fetched": "bigint", "pages_failed": "bigint", "records_extracted": "bigint", "records_valid": "bigint",
    "records_invalid": "bigint", "llm_calls": "bigint", "llm_cost": "double", "duration_ms": "bigint",
    "params_json": "string", "errors_json": "string",
}
COUNTERS = ["pages_fetched", "pages_failed", "records_extracted", "records_valid", "records_invalid", "llm_calls",
            "llm_cost"]
EVENT_COLUMNS = ["run_id", "timestamp", "kind", "key", "meta_json"]
#: Folders of a day. A layout setting: a log is read with the number it was written with.
RUN_BUCKETS = 16


def run_rows(df: DataFrame, at: Column | None = None) -> DataFrame:
    """(run_id, seq_ts, every run field); absent fields are null, meaning unchanged."""
    fields = [
        (F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in RUN_FIELDS.items()
    ]
    return df.select("run_id", (at if at is not None else F.current_timestamp()).alias("seq_ts"), *fields)


def log_run(df: DataFrame, path: str, at: Column | None = None) -> None:
    """Append a start or an update of runs."""
    run_rows(df, at).write.mode("append").parquet(path)


def latest_runs(log: DataFrame) -> DataFrame:
    """One row per run: the newest non-null value of each field; counters start at 0."""
    newest = log.groupBy("run_id").agg(
        *[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("seq_ts"))).alias(n) for n in RUN_FIELDS]
    )
    return newest.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast(RUN_FIELDS[c]) for c in COUNTERS})


def event_rows(df: DataFrame, run_id: Column, kind: Column, key: Column, meta: Column | None = None,
               at: Column | None = None) -> DataFrame:
    """Events in the log's shape; ``meta`` is a struct or map, stored as JSON."""
    return df.select(
        run_id.alias("run_id"), (at if at is not None else F.current_timestamp()).alias("timestamp"),
        kind.alias("kind"), key.alias("key"),
        (F.to_json(meta) if meta is not None else F.lit(None).cast("string")).alias("meta_json"),
    )


def _bucket(run_id: Column) -> Column:
    return F.pmod(F.xxhash64(run_id), F.lit(RUN_BUCKETS)).cast("int")


def _placed(events: DataFrame) -> DataFrame:
    """Events with their day and bucket, dealt so that a folder gets one file, or several if a run is large."""
    placed = events.select(*EVENT_COLUMNS, F.to_date("timestamp").alias("day"), _bucket(F.col("run_id")).alias("bucket"))
    return placed.hint("rebalance", "day", "bucket").sortWithinPartitions("day", "bucket", "run_id", "key")


def _write(placed: DataFrame, path: str, mode: str) -> None:
    writer = placed.write.mode(mode).partitionBy("day", "bucket").option("partitionOverwriteMode", "dynamic")
    for name in ("run_id", "key"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    writer.parquet(path)


def log_events(events: DataFrame, path: str) -> None:
    """Append events by day and hash of the run id, so files grow with days and appends, never with runs.

    Rows are sorted by run and key within a file, and files carry Bloom filters of both. Rows without a time lie in a
    folder of their own.
    """
    _write(_placed(events), path, "append")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    schema = "timestamp timestamp, kind string, key string, meta_json string, run_id string, day date, bucket int"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_events(spark: SparkSession, path: str, run_id: str | None = None, since: str | None = None) -> DataFrame:
    """The log, empty before the first event; of one run only, or from a time on, by reading the folders that can hold it."""
    stored = _stored(spark, path)
    if run_id is not None:
        stored = stored.where((F.col("run_id") == run_id) & (F.col("bucket") == _bucket(F.lit(run_id))))
    if since is not None:
        at = F.lit(since).cast("timestamp")
        # A day was told in its writer's time zone, which may differ from the reader's by more than a day.
        stored = stored.where((F.col("timestamp") >= at) & (F.col("day") >= F.date_sub(F.to_date(at), 2)))
    return stored.select(*EVENT_COLUMNS)


def compact_events(spark: SparkSession, path: str, before: str) -> None:
    """Rewrite the folders of the days before ``before`` (a date), each as few files as its size asks for.

    These days should get no more appends meanwhile. Rows are checkpointed first, and only the folders rewritten are
    replaced. Should the driver die while folders are replaced, their rows are in the checkpoint and the job's staging folder.
    """
    closed = _stored(spark, path).where(F.col("day") < F.lit(before).cast("date"))
    _write(_kept_days(materialize(closed)), path, "overwrite")


def _kept_days(closed: DataFrame) -> DataFrame:
    """Rows keep the folder they are in, whatever the time zone of this session."""
    return closed.hint("rebalance", "day", "bucket").sortWithinPartitions("day", "bucket", "run_id", "key").select(
        *EVENT_COLUMNS, "day", "bucket")


def _between(name: str, low: object, high: object) -> Column:
    """Within the bounds; one value is an equality, which can use a Bloom filter."""
    return F.col(name) == low if low == high else F.col(name).between(low, high)


def skip_logged(tasks: DataFrame, path: str, run_id: str = "run_id", task: str = "task_id", force: bool = False,
                scope: str = "run") -> DataFrame:
    """``skip_done`` against a stored log, of which only what can hold the tasks is read.

    One row about the tasks is fetched first: the buckets of their runs (at most ``RUN_BUCKETS``), the least and greatest run
    and key. Other buckets' folders are not listed, and row groups outside the bounds are skipped. Tasks without a run
    or key are never done.
    """
    if force:
        return tasks
    events = _stored(tasks.sparkSession, path)
    named = tasks.where(F.col(task).isNotNull())
    bounds = [F.min(task).alias("k0"), F.max(task).alias("k1")]
    if scope == "run":
        named = named.where(F.col(run_id).isNotNull())
        bounds += [F.min(run_id).alias("r0"), F.max(run_id).alias("r1"), F.collect_set(_bucket(F.col(run_id))).alias("buckets")]
    b = named.agg(*bounds).first()
    if b.k0 is None:
        return tasks
    events = events.where(_between("key", b.k0, b.k1))
    if scope == "run":
        events = events.where(F.col("bucket").isin(b.buckets) & _between("run_id", b.r0, b.r1))
    return skip_done(tasks, events, run_id, task, scope=scope)


def skip_done(tasks: DataFrame, events: DataFrame, run_id: str = "run_id", task: str = "task_id",
              force: bool = False, scope: str = "run") -> DataFrame:
    """Tasks without any event of their key, in the same run or (``scope='all'``) in any run."""
    if force:
        return tasks
    keys = [run_id, task] if scope == "run" else [task]
    done = events.select(F.col("run_id").alias(run_id), F.col("key").alias(task)).select(*keys).distinct()
    return tasks.join(done, keys, "left_anti").select(*tasks.columns)
