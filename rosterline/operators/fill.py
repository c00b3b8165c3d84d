"""Filling missing fields from a second source: prompts go out and answers come in as tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterline.functions.text import ColumnLike, as_column, present, py_strip, truncate_text
from rosterline.operators.ranking import call_budget
from rosterline.operators.schema import RecordSchema, column_types, missing_required

# The wording around schema, text and value.
PROMPT_HEAD = "SCHEMA (JSON keys/types):\n{schema}\n\nEXTRACT from this TEXT (already DOM-cleaned):\n\"\"\"\n"
PROMPT_TAIL = "\n\"\"\"\n\nReturn ONLY JSON with the schema keys."
NORMALIZE_HEAD = "Normalize this {field} field value:\n        \nInput: \""
NORMALIZE_TAIL = "\"\n\nReturn only the cleaned/normalized value, nothing else."


def build_prompt(text: ColumnLike, schema: RecordSchema, limit: int | None) -> Column:
    """The extraction prompt of a text, cut to ``limit`` characters; ``None`` takes it whole."""
    head = PROMPT_HEAD.format(schema=json.dumps(schema.types(), indent=2))
    return F.concat(F.lit(head), as_column(text) if limit is None else truncate_text(text, limit), F.lit(PROMPT_TAIL))


def normalize_prompt(field: str, value: ColumnLike) -> Column:
    return F.concat(F.lit(NORMALIZE_HEAD.format(field=field)), as_column(value), F.lit(NORMALIZE_TAIL))


def normalize_field(value: ColumnLike, answer: ColumnLike) -> Column:
    """The stripped answer, or the value itself where none came."""
    return F.coalesce(py_strip(answer), as_column(value))


def parse_response_json(c: ColumnLike, fenced: bool = True) -> Column:
    """An answer's JSON object as a map; null when it is not one whole JSON object."""
    c = as_column(c)
    body = c
    if fenced:
        body = (
            F.when(c.contains("```json"), F.split_part(F.split_part(c, F.lit("```json"), F.lit(2)), F.lit("```"), F.lit(1)))
            .when(c.contains("```"), F.split_part(c, F.lit("```"), F.lit(2)))
            .otherwise(c)
        )
    body = py_strip(body)
    # from_json keeps what it could read of a broken object, hence the strict parse first.
    return F.when(F.try_parse_json(body).isNotNull(), F.from_json(body, "map<string,string>"))


def needs_fill(records: DataFrame, schema: RecordSchema) -> DataFrame:
    """The records that lack a required field; only these are worth a call."""
    return records.where(F.size(missing_required(schema, column_types(records))) > 0)


def llm_records(
    responses: DataFrame, budget: int | None, response: str = "response", url: str = "url",
    order: str = "seq", enabled: bool = True, fenced: bool = True,
) -> DataFrame:
    """Parsed answers within the budget of successful ones (``None``: all of them), as column ``answer``.

    The page's own URL replaces whatever the answer says about ``page_url``.
    """
    parsed = responses.withColumn("answer", parse_response_json(response, fenced)).where(F.size("answer") > 0)
    if not enabled:
        parsed = parsed.where(F.lit(False))
    own = F.create_map(F.lit("page_url"), F.col(url))
    rest = F.map_filter("answer", lambda k, _: k != "page_url")
    within = parsed if budget is None else call_budget(parsed, budget, order)
    return within.withColumn("answer", F.map_concat(rest, own)).drop(response)


def hybrid_fill(records: DataFrame, answers: DataFrame, on: str, schema: RecordSchema, order: str | None = None) -> DataFrame:
    """Fill missing required fields from ``answers`` (``on``, ``answer``), giving one record per record.

    Of several answers for a key the first by ``order`` (else by content) that offers a required value is used. Only
    records with a gap take part in the join; complete ones pass by it.
    """
    types = column_types(records)
    required = [f.name for f in schema.fields if f.required]
    gaps = F.size(missing_required(schema, types)) > 0
    columns = records.columns

    def filled(name: str) -> Column:
        have = F.col(f"`{name}`") if name in columns else F.lit(None).cast("string")
        offered = F.col("answer")[name]
        kind = types.get(name, T.StringType())
        offer = F.when(present(offered), offered.try_cast(kind))
        return F.when(present(have, kind), have).otherwise(F.coalesce(offer, have)).alias(name)

    extra = [n for n in required if n not in columns]
    offers = F.exists(F.array(*[F.lit(n) for n in required]), lambda n: present(F.col("answer")[n]))
    first = F.struct(*([order] if order else []), F.to_json("answer"))
    single = answers.where(offers).groupBy(on).agg(F.min_by("answer", first).alias("answer"))
    joined = records.where(gaps).join(single, on, "left").select(
        *[filled(c) if c in required else F.col(f"`{c}`") for c in columns], *[filled(n) for n in extra])
    whole = records.where(~gaps).withColumns({n: F.lit(None).cast("string") for n in extra})
    return joined.unionByName(whole)


def call_provider(
    requests: DataFrame, provider: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType,
    budget: int | None = None, order: str = "seq",
) -> DataFrame:
    """Run a user's provider over batches of requests, on the executors.

    The budget is cut before any call is made.
    """
    if budget is not None:
        requests = call_budget(requests, budget, order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield provider(batch)

    return requests.mapInPandas(run, schema)
