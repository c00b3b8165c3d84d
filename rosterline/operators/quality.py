"""Data-quality report: duplicates, completeness, validity, warnings.

Two aggregates do all the work: one wide pass over every column, and one distinct
count that reads the key columns only. Both leave a single row, which is reshaped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.functions.text import dedup_key, email_valid, present, py_strip
from rosterline.operators.schema import column_types

# Thresholds of the warnings and of the status tags.
LOW_COMPLETENESS = 90.0
LOW_EMAIL_VALIDITY = 95.0
FEW_RECORDS = 10
COMPLETENESS_TAGS = [(90.0, "✅"), (50.0, "⚠️")]
VALIDITY_TAGS = [(95.0, "✅"), (80.0, "⚠️")]
LAST_TAG = "❌"

KEY_FIELDS = ["name", "page_url"]
URL_FIELDS = ["page_url", "linkedin_url"]
REPORT_COLUMNS = ["section", "field", "metric", "value", "status"]


def _filled(name: str, types: dict) -> Column:
    c = F.col(f"`{name}`")
    return present(c, types[name]) & (py_strip(c.cast("string")) != "")


def _percent(part: Column, whole: Column) -> Column:
    """Null when there is nothing to count."""
    return F.when(whole > 0, part.cast("double") / whole * 100)


def duplicate_stats(records: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row: total_records, unique_records, duplicates; keyless records take no part."""
    key = dedup_key(column_types(records), keys or ["name", "email"])
    return records.select(key.alias("k")).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_distinct("k").alias("unique_records"),
        (F.count("k") - F.count_distinct("k")).alias("duplicates"),
    )


def _profile(records: DataFrame) -> DataFrame:
    """One row: n, f<i> = filled per column, and the validity counts."""
    types = column_types(records)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, name in enumerate(records.columns):
        aggs.append(F.count_if(_filled(name, types)).alias(f"f{i}"))
        text = F.col(f"`{name}`").cast("string")
        if name == "email":
            aggs.append(F.count_if(_filled(name, types) & email_valid(text)).alias(f"v{i}"))
        elif name in URL_FIELDS:
            aggs.append(F.count_if(_filled(name, types) & text.rlike("^https?://")).alias(f"v{i}"))
    return records.agg(*aggs)


def _row(section: str, field: str, metric: str, value: Column) -> Column:
    return F.struct(
        F.lit(section).alias("section"), F.lit(field).alias("field"), F.lit(metric).alias("metric"),
        value.cast("double").alias("value"),
    )


def _tall(one_row: DataFrame, rows: list[Column]) -> DataFrame:
    return one_row.select(F.inline(F.array(*rows)))


def _checked_fields(columns: list[str]) -> list[tuple[int, str]]:
    return [(i, c) for i, c in enumerate(columns) if c == "email" or c in URL_FIELDS]


def _completeness_rows(columns: list[str]) -> list[Column]:
    return [_row("completeness", c, "percent", _percent(F.col(f"f{i}"), F.col("n"))) for i, c in enumerate(columns)]


def _validity_rows(columns: list[str]) -> list[Column]:
    return [
        _row("validity", c, "percent", _percent(F.col(f"v{i}"), F.col(f"f{i}"))) for i, c in _checked_fields(columns)
    ]


def _overview_rows() -> list[Column]:
    rate = F.when(F.col("total_records") > 0, F.col("duplicates") / F.col("total_records")).otherwise(0.0)
    values = {c: F.col(c) for c in ("total_records", "unique_records", "duplicates")} | {"duplicate_rate": rate}
    return [_row("overview", "", metric, value) for metric, value in values.items()]


def field_completeness(records: DataFrame) -> DataFrame:
    """field, percent of records where it is filled; no rows for an empty input."""
    tall = _tall(_profile(records), _completeness_rows(records.columns))
    return tall.where(F.col("value").isNotNull()).select("field", F.col("value").alias("percent"))


def validity(records: DataFrame) -> DataFrame:
    """field, percent of filled e-mails and URLs that are well formed."""
    checked = records.select(*[f"`{c}`" for _, c in _checked_fields(records.columns)])
    if not checked.columns:
        return records.sparkSession.createDataFrame([], "field string, percent double")
    tall = _tall(_profile(checked), _validity_rows(checked.columns))
    return tall.where(F.col("value").isNotNull()).select("field", F.col("value").alias("percent"))


def status_of(section: Column, value: Column) -> Column:
    def tag(levels: list[tuple[float, str]]) -> Column:
        (high, first), (low, second) = levels
        return F.when(value >= high, first).when(value >= low, second).otherwise(LAST_TAG)

    return F.when(section == "completeness", tag(COMPLETENESS_TAGS)).when(section == "validity", tag(VALIDITY_TAGS))


def _one_decimal(value: Column) -> Column:
    return F.format_string("%.1f", F.bround(value, 1))


def _key_list(keys: list[str]) -> str:
    return "[" + ", ".join(f"'{k}'" for k in keys) + "]"


def quality_warnings(
    records: DataFrame, keys: list[str] | None = None, expected_min: int | None = None,
    expected_max: int | None = None,
) -> DataFrame:
    """ord, warning: what the report complains about, in report order."""
    keys = keys or ["name", "email"]
    columns = records.columns

    def message(order: int, condition: Column, *parts: Column | str) -> Column:
        text = F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
        return F.when(condition, F.struct(F.lit(order).cast("bigint").alias("ord"), text.alias("warning")))

    dup, total, n = F.col("duplicates"), F.col("total_records"), F.col("n")
    about_keys = [message(
        0, dup > 0, "Found ", dup, " duplicates (", _one_decimal(dup / F.nullif(total, F.lit(0)) * 100), "%) based on ",
        _key_list(keys),
    )]
    about_fields = []
    for i, c in enumerate(columns):
        filled = _percent(F.col(f"f{i}"), n)
        if c in KEY_FIELDS:
            about_fields.append(message(
                1 + KEY_FIELDS.index(c), filled < LOW_COMPLETENESS, f"Low completeness for '{c}': ",
                _one_decimal(filled), "%"))
        if c == "email":
            good = _percent(F.col(f"v{i}"), F.col(f"f{i}"))
            about_fields.append(message(
                3, good < LOW_EMAIL_VALIDITY, "Email validity: ", _one_decimal(good), "% (", F.col(f"v{i}"), "/",
                F.col(f"f{i}"), ")"))
    about_fields.append(message(
        4, n < FEW_RECORDS, "Very low record count: ", n, " (expected more for directory scraping)"))
    for order, bound, side, outside in (
        (5, expected_min, "below expected minimum", n < F.lit(expected_min)),
        (6, expected_max, "above expected maximum", n > F.lit(expected_max)),
    ):
        if bound:
            gap = F.abs(n - F.lit(bound))
            about_fields.append(message(
                order, outside, "Record count ", n, f" is {side} {bound} (difference: ", gap, ", ",
                _one_decimal(gap / F.lit(bound) * 100), "%)"))

    def listed(one_row: DataFrame, messages: list[Column]) -> DataFrame:
        return one_row.select(F.inline(F.filter(F.array(*messages), lambda m: m.isNotNull())))

    return listed(duplicate_stats(records, keys), about_keys).unionByName(listed(_profile(records), about_fields))


def quality_report(records: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The whole report as (section, field, metric, value, status) rows."""
    columns = records.columns
    profile_rows = _completeness_rows(columns) + _validity_rows(columns)
    tall = _tall(duplicate_stats(records, keys), _overview_rows()).unionByName(
        _tall(_profile(records), profile_rows)
    )
    return tall.where(F.col("value").isNotNull()).withColumn("status", status_of(F.col("section"), F.col("value")))


def quality_summary(report: DataFrame) -> DataFrame:
    """One row from a report: totals plus the two maps, by falling completeness.

    Collects one entry per field of the schema, never per record.
    """

    def metric(name: str) -> Column:
        return F.max(F.when(F.col("metric") == name, F.col("value")))

    def entries(section: str, key: Column) -> Column:
        pairs = F.collect_list(F.when(F.col("section") == section, F.struct(key.alias("o"), "field", "value")))
        return F.map_from_entries(F.transform(F.array_sort(pairs), lambda p: F.struct(p["field"], p["value"])))

    return report.agg(
        metric("total_records").cast("bigint").alias("total_records"),
        metric("unique_records").cast("bigint").alias("unique_records"),
        metric("duplicates").cast("bigint").alias("duplicates"),
        metric("duplicate_rate").alias("duplicate_rate"),
        entries("completeness", -F.col("value")).alias("field_completeness"),
        entries("validity", F.lit(0.0)).alias("field_validity"),
    )


def count_within_tolerance(records: DataFrame, expected: int, tolerance_pct: float = 5.0) -> DataFrame:
    """One row: n, low, high, passed."""
    tolerance = int(expected * tolerance_pct / 100)
    low, high = expected - tolerance, expected + tolerance
    return records.agg(F.count(F.lit(1)).alias("n")).select(
        "n", F.lit(low).cast("bigint").alias("low"), F.lit(high).cast("bigint").alias("high"),
        F.col("n").between(low, high).alias("passed"),
    )
