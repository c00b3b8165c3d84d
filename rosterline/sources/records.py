"""Record files: JSON lines, CSV and Parquet, by extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FORMATS = {".jsonl": "jsonl", ".csv": "csv", ".parquet": "parquet"}


def format_of(path: str, fmt: str | None = None) -> str:
    found = fmt or next((f for ext, f in FORMATS.items() if path.rstrip("/").endswith(ext)), None)
    if found not in FORMATS.values():
        raise ValueError(f"unsupported record format: {fmt or path}")
    return found


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One object per line; blank lines are skipped, a broken one fails the job. Give a schema to skip inference."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = True) -> DataFrame:
    """CSV with a header; types are inferred, by one more pass, unless a schema is given.

    Quoted line breaks make each file one task. Where values hold none, ``multi_line=False`` lets Spark split large files.
    """
    reader = spark.read.options(header=True, multiLine=multi_line, escape='"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Overwrite; null fields stay in the objects."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Overwrite with a header; an empty input writes nothing."""
    if not df.isEmpty():
        df.write.mode("overwrite").options(header=True, escape='"', encoding="UTF-8").csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    """Overwrite; an empty input writes nothing."""
    if not df.isEmpty():
        df.write.mode("overwrite").parquet(path)


def read_records(
    spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | str | None = None
) -> DataFrame:
    kind = format_of(path, fmt)
    if kind == "parquet":
        return read_parquet(spark, path)
    return (read_jsonl if kind == "jsonl" else read_csv)(spark, path, schema)


def write_records(df: DataFrame, path: str, fmt: str | None = None) -> None:
    {"jsonl": write_jsonl, "csv": write_csv, "parquet": write_parquet}[format_of(path, fmt)](df, path)
