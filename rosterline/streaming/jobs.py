"""Pages to records, job statuses to outcomes, and skipping what is done, as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from rosterline.functions.nodes import with_dom
from rosterline.operators.dedup import with_record_id
from rosterline.operators.enrich import MAX_WAIT_S
from rosterline.operators.extract import resolve_all_fields
from rosterline.sources.runlog import event_rows, log_events, read_events

OUTCOME_TYPE = "task_id string, ts timestamp, status string, success boolean, error string, result_json string"
CLOSED_TYPE = "task_id string, us long, status string, success boolean, error string, result_json string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OBSERVATION_TYPE = (
    "task_id string, ts timestamp, seq long, status string, error string, result_json string, fetch_error string"
)
OPEN_STATUSES = ["pending", "processing"]


def stream_records(pages: DataFrame, event_time: str | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """Detail records of arriving pages, one per record id.

    Without ``event_time`` ids are remembered for the whole run. With it (after a
    watermark) they are forgotten once the watermark has passed, which bounds the state.
    """
    keys = [url, *([event_time] if event_time else [])]
    dom = with_dom(pages.select(*keys, html), html)
    records = resolve_all_fields(dom, *[F.col(url).alias("source_url"), *keys[1:]], url=url)
    keyed = with_record_id(records)
    if event_time:
        return keyed.dropDuplicatesWithinWatermark(["record_id"])
    return keyed.dropDuplicates(["record_id"])


def append_records(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to JSON lines, exactly once, until the input present now is used up."""
    return (
        records.writeStream.format("json").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _failure(status: str | None, error: str | None, fetch_error: str | None, max_wait: int) -> str | None:
    """Error of a deciding observation, None for a success; a waiting one decides by being late."""
    if fetch_error is not None:
        return f"Polling error: {fetch_error}"
    if status == "completed":
        return None
    if status == "failed":
        return f"Job failed: {'Unknown error' if error is None else error}"
    if status in OPEN_STATUSES:
        return f"Polling timeout after {max_wait}s"
    return f"Unknown status: {status}"


def prune_observations(batch: pd.DataFrame, max_wait: int = MAX_WAIT_S) -> pd.DataFrame:
    """The rows of a batch that can still decide their task.

    The first verdict and the first late waiting row of a task make all later ones
    irrelevant. What is late here is late for good: a start seen elsewhere can only be
    earlier. A busy task thus leaves a batch with at most ``max_wait`` seconds of rows.
    """
    ordered = batch.sort_values(["ts", "seq"])
    waiting = ordered["status"].isin(OPEN_STATUSES) & ordered["fetch_error"].isna()
    late = ordered["ts"] > ordered.groupby("task_id")["ts"].transform("min") + pd.Timedelta(seconds=max_wait)
    decides = ordered[~waiting].drop_duplicates("task_id").index
    expires = ordered[waiting & late].drop_duplicates("task_id").index
    keep = (waiting & ~late) | ordered.index.isin(decides) | ordered.index.isin(expires)
    return ordered[keep]


class _Verdicts(StatefulProcessor):
    """Per task: its start, the first observation that decides, and the waiting ones that may turn out to be the first late one.

    Whatever the order of arrival, a verdict is final once the watermark has passed it: no earlier row can come, and no
    earlier start. A timer at that time tells it.
    """

    STATE = ("start long, closed boolean, timer long, best struct<us: long, seq: long, status: string, error: string, result: string, fetch_error: string>, "
             "waiting array<struct<us: long, seq: long, status: string>>")

    def __init__(self, max_wait: int, keep_closed_s: int, silence_s: int):
        self.max_wait, self.keep_closed_s, self.silence_s = max_wait, keep_closed_s, silence_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", self.STATE)

    def _timer(self, at_us: int, old: int | None) -> int:
        at = -(-at_us // 1000)
        if old != at:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)
        return at

    def _verdict(self, start: int, best, waiting: list) -> tuple | None:
        """The first deciding observation, or None."""
        late = next((w for w in waiting if w[0] > start + self.max_wait * 1_000_000), None)
        found = [x for x in (best, late and (*late, None, None, None)) if x]
        return min(found, key=lambda x: (x[0], x[1])) if found else None

    def _closes(self, start: int, verdict: tuple | None) -> int:
        """When a task is decided: by its verdict, or by silence."""
        silent = start + self.silence_s * 1_000_000
        return min(verdict[0], silent) if verdict else silent

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        start, closed, timer, best, waiting = held if held else (None, False, None, None, [])
        if closed:
            return
        best, waiting = best and tuple(best), [tuple(w) for w in waiting or []]
        for chunk in rows:
            values = chunk.astype(object).where(chunk.notna(), None)
            for us, seq, status, error, result, fetch_error in zip(*(values[c] for c in ("us", "seq", "status", "error", "result_json", "fetch_error"))):
                start = us if start is None else min(start, us)
                if status in OPEN_STATUSES and fetch_error is None:
                    waiting.append((us, seq, status))
                elif best is None or (us, seq) < best[:2]:
                    best = (us, seq, status, error, result, fetch_error)
        waiting = sorted(set(waiting), key=lambda w: w[:2])
        verdict = self._verdict(start, best, waiting)
        # Later rows may still bring an earlier start, but none before the watermark.
        lowest = min(start, timerValues.getCurrentWatermarkInMs() * 1000) + self.max_wait * 1_000_000
        waiting = [w for w in waiting if w[0] > lowest and (verdict is None or w[:2] <= verdict[:2])]
        self.state.update((start, False, self._timer(self._closes(start, verdict), timer), best, waiting))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start, closed, _, best, waiting = self.state.get()
        if closed:
            self.state.clear()
            return
        verdict = self._verdict(start, best and tuple(best), [tuple(w) for w in waiting or []])
        at = self._closes(start, verdict)
        if verdict is None or verdict[0] > at:  # nothing came in time
            verdict = (at, None, None, None, None, None)
            failure = f"Polling timeout after {self.max_wait}s"
        else:
            failure = _failure(verdict[2], verdict[3], verdict[5], self.max_wait)
        self.state.update((start, True, self._timer(at + self.keep_closed_s * 1_000_000 + 1000, None), None, []))
        yield pd.DataFrame({
            "task_id": [key[0]], "us": [at], "status": [verdict[2]], "success": [failure is None], "error": [failure],
            "result_json": [verdict[4] if failure is None else None]})


def _rocksdb(df: DataFrame) -> None:
    """State with timers and several columns is kept by this provider only; it holds for streams started from now on."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def stream_job_status(
    statuses: DataFrame, max_wait: int = MAX_WAIT_S, lateness: str = "10 minutes", keep_closed_s: int = 86_400,
    silence_s: int = 86_400,
) -> DataFrame:
    """One outcome per task, from task_id, ts, seq, status, error, result_json, fetch_error.

    The outcome is that of ``job_outcome`` over all observations within ``lateness``, however they arrive: it goes out once the
    watermark has passed the deciding one. A task without a verdict ``silence_s`` after its start has timed out then. A closed
    task is forgotten ``keep_closed_s`` of event time later; until then further observations change nothing. Rows that
    can decide nothing are dropped before the shuffle, so a busy task does not flood its state.
    """

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield prune_observations(batch.reset_index(drop=True), max_wait)

    _rocksdb(statuses)
    kept = (
        statuses.withColumn("task_id", F.col("task_id").cast("string"))
        .select("task_id", "ts", "seq", "status", "error", "result_json", "fetch_error")
        .mapInPandas(prune, OBSERVATION_TYPE)
        # Microseconds, so that no time zone comes between rows and watermark.
        .withColumn("us", F.unix_micros("ts"))
        .withWatermark("ts", lateness)
    )
    closed = kept.groupBy("task_id").transformWithStateInPandas(
        _Verdicts(max_wait, keep_closed_s, silence_s), CLOSED_TYPE, "Append", "EventTime")
    return closed.select("task_id", F.timestamp_micros("us").alias("ts"), "status", "success", "error", "result_json")


class _FirstOffer(StatefulProcessor):
    """Lets the first row of each task pass that is not known to be done."""

    def __init__(self, ttl_s: int | None):
        self.ttl_s = ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "done boolean", self.ttl_s and self.ttl_s * 1000)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.known.update((True,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not self.known.exists():
            self.known.update((True,))
            yield next(rows).head(1)


def stream_skip_done(
    tasks: DataFrame, run_id: str, log_path: str, work: Callable[[DataFrame, int], None], checkpoint: str,
    kind: str = "page_fetched", ttl_s: int | None = None,
) -> StreamingQuery:
    """Hand each trigger's new tasks (task_id, …) to ``work``, then log them as done.

    What is done is the stream's state: a new checkpoint starts with the run's log, which is read that once; afterwards, and
    after a restart, the state knows. ``ttl_s`` forgets a task so long after its offer. ``work`` runs before the log
    is written and the batch is committed, so after a failure a batch is offered again rather than lost; write with the
    batch id if that must not repeat output.
    """
    _rocksdb(tasks)
    log = read_events(tasks.sparkSession, log_path, run_id)
    done = log.select(F.col("key").alias("task_id")).where("task_id is not null").distinct().groupBy("task_id")
    fresh = tasks.groupBy("task_id").transformWithStateInPandas(
        _FirstOffer(ttl_s), tasks.schema, "Append", "ProcessingTime" if ttl_s else "None", initialState=done)

    def handle(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        work(held, batch_id)
        log_events(event_rows(held, F.lit(run_id), F.lit(kind), F.col("task_id")), log_path)
        held.unpersist()

    return (
        fresh.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
