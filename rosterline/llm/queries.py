"""The registered queries of this subpackage. Each applies an operator to whole tables with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterline.llm import decontamination, embedding_dedup, language_id, license_scan, lm_scoring, merkle_manifest, minhash_dedup, oracle, packing, pii
from rosterline.llm import substring_dedup, target_resampling, token_counts, warc, wordbpe
from rosterline.llm.common import store
from rosterline.session import ensure_checkpoint_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_counts.length_report(token_counts.length_histogram(docs, wordbpe.default_path()))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.similar_vectors(_table(spark, sf_dir, "embeddings"), 0.93)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = lm_scoring.Corpus.of(_table(spark, sf_dir, "documents"))
    return lm_scoring.score(corpus, *lm_scoring.train(corpus))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), wordbpe.default_path(), packing.Capacity(2048))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest_columns(pii.find(docs, pii.fit(docs)))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.by_document(substring_dedup.repeated_passages(_table(spark, sf_dir, "documents")))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"), minhash_dedup.Matching(words=3, numerator=85))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    model = language_id.fit(docs.where(~held_out))
    found = language_id.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    found = language_id.with_rejection(store(found.select("doc_id", "held_out", "lang_pred", "score", "lang_entropy")))
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    folder = f"{ensure_checkpoint_dir(spark)}/rosterline-warc-{uuid.uuid4().hex}"
    largest = pages.agg(F.max(F.octet_length("html") + F.coalesce(F.octet_length("url"), F.lit(0)) * 2)).first()[0] or 0
    warc.write_archives(warc.capture_records(pages), folder, largest)
    done = warc.transactions(warc.read_records(spark, folder))
    page_id = F.expr("cast(nullif(regexp_extract(decode(metadata.payload, 'UTF-8'), 'page-id: ([0-9-]+)', 1), '') as bigint)")
    return done.select(
        page_id.alias("page_id"),
        F.regexp_extract("response.head", r"Content-Length: (\d+)", 1).cast("long").alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        F.regexp_extract("response.refers_to", r"page:(-?\d+)", 1).alias("r"),
    ).withColumn("refers_to", F.expr("cast(nullif(r, '') as bigint)")).drop("r")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.verified_documents(_table(spark, sf_dir, "documents"))


def op12_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents")).drop("matches")


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_embedding_near_dedup, op3_lm_scoring, op4_best_fit_packing, op5_pii, op6_decontamination,
                             op7_substring_dedup, op8_minhash_near_dedup, op9_language_id, op10_warc, op11_merkle_manifest,
                             op12_license_scans, op13_target_resampling)
}

SQL: dict[str, str] = oracle.SQL
