"""WARC archives written and read by Spark, and transactions assembled from their records.

An archive is a text file whose lines end in the blank line that ends a record, so Spark's text writer makes it in any
store; it is compressed as one gzip stream. Reading goes by Content-Length, so payloads may hold anything.
"""

from __future__ import annotations

import gzip

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.llm.common import map_batches, store

#: Uncompressed bytes that an archive file holds at most (or one capture).
FILE_BYTES = 32 << 20
BREAK = "\r\n"
#: RFC 4648 letters (fixed values).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(value: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's UTF-8 bytes, natively: five hex digits are four base32 letters."""
    hexed = F.sha1(value.cast("binary"))
    letters = []
    for k in range(8):
        number = F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 10).cast("long")
        letters += [F.substring(F.lit(BASE32), F.shiftright(number, 15 - 5 * j).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for j in range(4)]
    return F.concat(*letters)


def _record(kind: Column, record: Column, head: list[Column], block: Column) -> Column:
    """A record without the two line breaks that end it; null lines are left out."""
    lines = [F.lit("WARC/1.0"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: <urn:"), record, F.lit(">")), *head,
             F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(BREAK, *lines), F.lit(BREAK * 2), block)


def capture_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0,
                    date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """``(payload_bytes, record)``: request, response or revisit, and metadata of each page, concurrent to each other.

    Of equal payloads (digest and length) of at least ``min_bytes`` the one with the largest id is the response, the others
    revisit it; rows that repeat that id are responses too. A null html is empty, a null url is left out; a page with a
    null id is a response of its own and is never revisited. Record ids are the page id and a running number, so that
    repeated ids stay apart; a revisit refers to the page id of its response.
    """
    from pyspark.sql.functions import col

    page = pages.select(
        pages[page_id].cast("long").alias("page_id"), F.regexp_replace(pages[url].cast("string"), r"[\r\n]+", " ").alias("url"),
        F.coalesce(pages[html], F.lit("")).alias("html"))
    page = page.withColumn("digest", sha1_base32(col("html"))).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    # Keys and counts only: one row per payload that several pages share.
    shared = page.where(col("page_id").isNotNull() & (col("payload_bytes") >= min_bytes)).groupBy("digest", "payload_bytes").agg(
        F.max("page_id").alias("first_id"), F.min("page_id").alias("least_id"))
    shared = store(shared.where("first_id <> least_id").drop("least_id"))  # its size is known when the join is planned
    page = page.join(shared, ["digest", "payload_bytes"], "left")
    again = col("page_id").isNotNull() & (col("page_id") < col("first_id"))
    name = F.concat_ws(".", F.coalesce(col("page_id").cast("string"), F.lit("none")), F.monotonically_increasing_id().cast("string"))
    page = page.withColumn("name", name).withColumn("again", F.coalesce(again, F.lit(False)))
    common = [F.lit(f"WARC-Date: {date}"), F.when(col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), col("url")))]
    main = F.concat(F.lit("page:"), col("name"))
    beside = F.concat(F.lit("WARC-Concurrent-To: <urn:"), main, F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), col("payload_bytes").cast("string"), F.lit(BREAK * 2))
    response = _record(
        F.when(col("again"), "revisit").otherwise("response"), main,
        [*common, F.lit("Content-Type: application/http;msgtype=response"), F.concat(F.lit("WARC-Payload-Digest: sha1:"), col("digest")),
         F.when(col("again"), F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), col("first_id").cast("string"), F.lit(">")))],
        F.concat(http, F.when(col("again"), "").otherwise(col("html"))))
    request = _record(F.lit("request"), F.concat(F.lit("request:"), col("name")), [*common, beside, F.lit("Content-Type: application/http;msgtype=request")],
                      F.concat(F.lit("GET "), F.coalesce(col("url"), F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")))
    metadata = _record(F.lit("metadata"), F.concat(F.lit("metadata:"), col("name")), [*common, beside, F.lit("Content-Type: application/warc-fields")],
                       F.concat(F.lit("page-id: "), F.coalesce(col("page_id").cast("string"), F.lit("")), F.lit(BREAK)))
    return page.select("payload_bytes", F.explode(F.array(request, response, metadata)).alias("record"))


def write_archives(records: DataFrame, path: str, largest: int) -> None:
    """Write records as gzipped archives of at most FILE_BYTES, ``largest`` being the bytes of the largest record."""
    per_file = max(1, FILE_BYTES // (largest + 2000))
    (records.select("record").write.option("lineSep", BREAK * 2).option("compression", "gzip").option("maxRecordsPerFile", per_file)
     .text(path))


def read_records(spark, path: str) -> DataFrame:
    """One row per record: type, ids, digest, HTTP head and payload. Truncated or foreign bytes raise ValueError."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")

    def run(batch: dict):
        for content in batch["content"]:
            data, at = gzip.decompress(content), 0
            out: dict[str, list] = {k: [] for k in ("kind", "record_id", "concurrent_to", "refers_to", "url", "digest", "head", "payload")}
            while at < len(data):
                end = data.find(b"\r\n\r\n", at)
                if end < 0 or not data.startswith(b"WARC/1.0\r\n", at):
                    raise ValueError(f"no record at byte {at}")
                fields = dict(line.split(b": ", 1) for line in data[at:end].split(b"\r\n")[1:])
                size = int(fields[b"Content-Length"])
                block = data[end + 4 : end + 4 + size]
                at = end + 8 + size
                if len(block) < size or data[at - 4 : at] != b"\r\n\r\n":
                    raise ValueError("a record is cut off")
                text = {k.decode(): v.decode() for k, v in fields.items()}
                head, payload = None, block
                if text["Content-Type"].startswith("application/http"):
                    head, _, payload = block.partition(b"\r\n\r\n")
                inner = lambda key: (text.get(key) or "").removeprefix("<urn:").removesuffix(">") or None
                row = (text["WARC-Type"], inner("WARC-Record-ID"), inner("WARC-Concurrent-To"), inner("WARC-Refers-To"), text.get("WARC-Target-URI"),
                       (text.get("WARC-Payload-Digest") or "").removeprefix("sha1:") or None, head.decode() if head is not None else None, payload)
                for name, value in zip(out, row):
                    out[name].append(value)
            yield out

    return map_batches(files, run, "kind string, record_id string, concurrent_to string, refers_to string, url string, digest string, head string, payload binary")


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, with the requests and metadata records concurrent to it.

    Records are brought together on the capture's id, which each has once per kind; a request or metadata record without
    its response keeps a row of its own with a null response.
    """
    part = F.struct("kind", "record_id", "url", "refers_to", "digest", "head", "payload")
    main = F.col("kind").isin("response", "revisit")
    keyed = records.withColumn("capture", F.coalesce("concurrent_to", "record_id"))
    return keyed.groupBy("capture").agg(
        F.first(F.when(main, part), ignorenulls=True).alias("response"),
        F.first(F.when(F.col("kind") == "request", part), ignorenulls=True).alias("request"),
        F.first(F.when(F.col("kind") == "metadata", part), ignorenulls=True).alias("metadata"),
    )
