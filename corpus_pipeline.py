"""Documents to packed training sequences: five stages, each written as Parquet and read back as the next one's input."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterline.llm import decontamination, language_id, minhash_dedup, packing, pii, wordbpe
from rosterline.llm.common import store
from rosterline.session import ensure_checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known stay: those without a letter (null and empty texts too), and those far from every
    model, go. An empty table, or one without a language, keeps none."""
    return language_id.known_languages(docs.select(COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8) stays: the smallest id.

    Documents without words or id are in no group and stay; rows that repeat an id stay or go together.
    """
    gone = store(minhash_dedup.near_duplicates(docs).where("doc_id is not null and not kept").select("doc_id"))
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of ``benchmark`` go, by their text: rows without an id too, and of rows that share
    an id only those whose own text holds one. Null and empty texts hold none."""
    key = F.xxhash64("text")
    found = decontamination.contaminated(docs.where("text is not null").withColumn("doc_id", key), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = store(found.select(F.col("doc_id").alias("_key")).distinct())
    keyed = docs.withColumn("_key", F.when(F.col("text").isNotNull(), key))
    return keyed.join(gone, "_key", "left_anti").select(COLUMNS)


def personal_data_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; personal data in its text is replaced by the name of its kind. A null text stays null, with a
    null length; an empty table stays empty."""
    out = pii.masked(docs.select(COLUMNS), pii.fit(docs))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents packed into sequences of at most 2048 tokens; null texts are empty documents."""
    return packing.pack(docs, wordbpe.default_path(), packing.Capacity(2048))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminated),
    ("pii", personal_data_masked),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the stages; tests hold each against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every intermediate table lies in the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/rosterline-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
