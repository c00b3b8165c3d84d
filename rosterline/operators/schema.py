"""Record schemas: declared fields, conforming records to them, validating records."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterline.functions.text import email_valid, present

# The declared field types; a trailing "?" makes each optional.
FIELD_TYPES = ["str", "email", "url", "int", "bool"]
SPARK_TYPES = {"int": T.LongType(), "bool": T.BooleanType()}


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    pattern: str | None = None
    synonyms: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.base_type not in FIELD_TYPES:
            raise ValueError(f"unknown field type {self.type!r}")

    @property
    def base_type(self) -> str:
        return self.type.removesuffix("?")

    @property
    def required(self) -> bool:
        return not self.type.endswith("?")


@dataclass(frozen=True)
class RecordSchema:
    fields: tuple[Field, ...] = field(default_factory=tuple)

    @classmethod
    def of(cls, spec: dict | str) -> RecordSchema:
        """From ``{name: type}`` or ``{"fields": [{name, type, pattern, synonyms}]}``, or their JSON."""
        if isinstance(spec, str):
            spec = json.loads(spec)
        if "fields" in spec:
            return cls(tuple(
                Field(f["name"], f["type"], f.get("pattern"), tuple(f.get("synonyms", ()))) for f in spec["fields"]
            ))
        return cls(tuple(Field(name, kind) for name, kind in spec.items()))

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def get(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def is_required(self, name: str) -> bool:
        found = self.get(name)
        return bool(found and found.required)

    def types(self) -> dict[str, str]:
        return {f.name: f.type for f in self.fields}

    def struct(self) -> T.StructType:
        """Spark types, with semantics, patterns and synonyms in the field metadata."""
        return T.StructType([
            T.StructField(
                f.name, SPARK_TYPES.get(f.base_type, T.StringType()), not f.required,
                {"semantic": f.base_type, "required": f.required, "pattern": f.pattern or "",
                 "synonyms": list(f.synonyms)},
            )
            for f in self.fields
        ])


PERSON = RecordSchema.of({
    "name": "str", "title": "str?", "email": "email?", "phone": "str?",
    "page_url": "url", "bio": "str?", "org": "str?", "location": "str?",
})


def column_types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def apply_schema(records: DataFrame, schema: RecordSchema, keep_extra: bool = True) -> DataFrame:
    """Every schema field becomes a column; missing text becomes ``''``, typed fields are cast or null."""
    have = column_types(records)
    shaped = []
    for declared in schema.struct().fields:
        value = F.col(f"`{declared.name}`") if declared.name in have else F.lit(None)
        text = isinstance(declared.dataType, T.StringType)
        value = F.coalesce(value.cast("string"), F.lit("")) if text else value.cast("string").try_cast(
            declared.dataType
        )
        shaped.append(value.alias(declared.name, metadata=declared.metadata))
    extra = [F.col(f"`{c}`") for c in records.columns if c not in schema.names] if keep_extra else []
    return records.select(*shaped, *extra)


def missing_required(schema: RecordSchema, types: dict[str, T.DataType]) -> Column:
    """Names of the required fields a record lacks."""
    gaps = [
        F.when(~present(F.col(f"`{f.name}`"), types[f.name]), F.lit(f.name)) if f.name in types else F.lit(f.name)
        for f in schema.fields if f.required
    ]
    if not gaps:
        return F.array().cast("array<string>")
    return F.filter(F.array(*gaps), lambda g: g.isNotNull())


def _violation(f: Field, types: dict[str, T.DataType]) -> Column:
    if f.name not in types:
        return F.lit(f"{f.name}: missing") if f.required else F.lit(None).cast("string")
    value = F.col(f"`{f.name}`")
    text = value.cast("string")
    given = present(value, types[f.name])
    malformed = {
        "email": ~email_valid(text),
        "url": ~text.rlike("^https?://"),
        "int": text.try_cast("bigint").isNull(),
        "bool": text.try_cast("boolean").isNull(),
    }.get(f.base_type, F.lit(False))
    off_pattern = ~text.rlike(f.pattern) if f.pattern else F.lit(False)
    return (
        F.when(~given, F.lit(f"{f.name}: missing") if f.required else F.lit(None).cast("string"))
        .when(malformed, F.lit(f"{f.name}: not {f.base_type}"))
        .when(off_pattern, F.lit(f"{f.name}: pattern"))
    )


def validate_records(records: DataFrame, schema: RecordSchema) -> DataFrame:
    """Add ``violations``; a record is valid when the array is empty."""
    types = column_types(records)
    checks = F.array(*[_violation(f, types) for f in schema.fields])
    return records.withColumn("violations", F.filter(checks, lambda v: v.isNotNull()))
