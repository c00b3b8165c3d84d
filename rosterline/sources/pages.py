"""Stored pages, in place of fetching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterline.functions.urls import task_id


def spread(scan: DataFrame) -> DataFrame:
    """Use every core for a scan that has fewer splits than there are cores.

    Such an input is smaller than one split per core, so moving it is cheap; a larger one
    is left where it is. Only for plain scans, whose partitions are known without running.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def as_pages(df: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(task_id, url, html, status, fetched_at) of any table with a URL and its HTML.

    A page stored without a status counts as 200; ``fetched_at`` is null where it isn't stored.
    """
    status = F.coalesce(F.col("status").cast("int"), F.lit(200)) if "status" in df.columns else F.lit(200)
    fetched = (F.col("fetched_at") if "fetched_at" in df.columns else F.lit(None)).cast("timestamp")
    return df.select(task_id(url).alias("task_id"), F.col(url).alias("url"), F.col(html).alias("html"),
                     status.alias("status"), fetched.alias("fetched_at"))


def scan_pages(spark: SparkSession, path: str, url: str = "url", html: str = "html") -> DataFrame:
    stored = spark.read.parquet(path)
    columns = [c for c in (url, html, "status", "fetched_at") if c in stored.columns]
    return as_pages(spread(stored.select(*columns)), url, html)


def stream_pages(spark: SparkSession, path: str, url: str = "url", html: str = "html", files_per_trigger: int = 1000
                 ) -> DataFrame:
    """Pages as they arrive in a folder of Parquet files."""
    schema = f"`{url}` string, `{html}` string"
    return as_pages(
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path), url, html
    )
