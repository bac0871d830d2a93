"""A content-addressed web archive: WARC headers and payloads in tables of their own.

``write_archive`` stores every payload once, under the SHA-256 of its bytes, and every record's header exactly as a WARC/1.1
reader expects it; a record whose payload an earlier one holds becomes a revisit that refers to it. ``reconstruct`` joins the two to
whole records, byte for byte as in a WARC file. ``read_archive`` parses those bytes, checks the length and the digest that each
header states against what follows it, and answers from them. Payloads are shuffled once, when they are read; a digest that many
records share is dealt over several tasks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave.plans.joins import dealt_join, frequent, looked_up
from codeweave.session import materialize, shared_folder

#: Payloads of fewer bytes are always stored as responses.
LEAST_REVISIT = 100
#: Ids that go to all executors at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
END = b"\r\n\r\n"


def _header(kind: Column) -> Column:
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    target = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")
    revisit = kind == "revisit"
    return F.concat(
        F.lit(f"{VERSION}\r\n"),
        field("WARC-Type", kind),
        field("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        field("WARC-Date", F.lit(DATE)),
        field("WARC-Target-URI", target),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(field("WARC-Profile", F.lit(PROFILE)), field("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("holder").cast("string"), F.lit(">"))))).otherwise(""),
        field("Content-Type", F.lit("text/html; charset=utf-8")),
        field("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit("\r\n"),
    )


def write_archive(pages: DataFrame, folder: str | None = None) -> str:
    """Write the records of pages(page_id, url, html, ...) below a new folder and return it.

    Of rows with equal payloads of at least LEAST_REVISIT bytes, that with the smallest page_id is a response and the others
    revisit it; rows that repeat a page_id and its payload are records of the same type. A null html is an empty payload, a null
    url an empty target; a row without a page_id has no record; other columns are ignored; an empty table gives an empty archive.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).where("page_id is not null")
    rows = pages.select("page_id", "url", F.sha2(F.col("html").cast("binary"), 256).alias("digest"), F.octet_length("html").cast("long").alias("bytes"))
    rows = materialize(rows, "digests")
    groups = materialize(rows.groupBy("digest", "bytes").agg(F.min("page_id").alias("holder"), F.count("*").alias("rows")).where("rows > 1").drop("rows"), "groups")
    few = groups.count() <= BROADCAST_IDS // 4
    named = rows.join(F.broadcast(groups), ["digest", "bytes"], "left") if few else looked_up(rows, groups, ["digest", "bytes"], frequent(rows, ["digest", "bytes"]))
    kind = F.when((F.col("bytes") >= LEAST_REVISIT) & (F.col("holder") < F.col("page_id")), "revisit").otherwise("response")
    named.withColumn("kind", kind).select("page_id", _header(F.col("kind")).alias("header")).write.parquet(f"{folder}/headers")
    others = materialize(named.where("holder < page_id").select("page_id", "digest").distinct(), "others")
    body = pages.select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest"), F.col("html").cast("binary").alias("payload"))
    body = body.join(F.broadcast(others) if others.count() <= BROADCAST_IDS else others, ["page_id", "digest"], "left_anti")
    repeated = materialize(rows.groupBy("page_id", "digest").agg(F.count("*").alias("rows")).where("rows > 1").drop("rows"), "repeated")
    if repeated.limit(1).count():
        # Only rows that repeat their page and payload are shuffled.
        again = F.broadcast(repeated) if repeated.count() <= BROADCAST_IDS else repeated
        body = body.join(again, ["page_id", "digest"], "left_anti").unionByName(body.join(again, ["page_id", "digest"], "left_semi").dropDuplicates(["page_id", "digest"]))
    body.select("digest", "payload").write.option("compression", "zstd").parquet(f"{folder}/payloads")
    return folder


def fields(header: str) -> dict[str, Column]:
    """The fields of a column of headers that records are read by."""
    get = lambda pattern: F.regexp_extract(header, pattern, 1)
    number = lambda pattern: F.nullif(get(pattern), F.lit("")).cast("long")
    return {
        "page_id": number(r"\r\nWARC-Record-ID: <urn:page:(-?[0-9]+)>\r\n"),
        "record_type": get(r"\r\nWARC-Type: ([a-z]+)\r\n"),
        "digest": get(r"\r\nWARC-Payload-Digest: sha256:([0-9a-f]{64})\r\n"),
        "refers_to": number(r"\r\nWARC-Refers-To: <urn:page:(-?[0-9]+)>\r\n"),
        "length": number(r"\r\nContent-Length: ([0-9]+)\r\n"),
    }


def headers(spark: SparkSession, folder: str) -> DataFrame:
    """The parsed headers: page_id, record_type, digest, refers_to, length of the block and the exact header."""
    raw = spark.read.schema("page_id long, header string").parquet(f"{folder}/headers")
    return raw.select(*(c.alias(k) for k, c in fields("header").items()), "header")


def reconstruct(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, record, payload): whole records as stored in a WARC file, and each page's payload, for revisits too."""
    stored = spark.read.schema("digest string, payload binary").parquet(f"{folder}/payloads")
    told = materialize(headers(spark, folder).select("page_id", "record_type", "digest", "header"), "headers")
    whole = dealt_join(told, stored, ["digest"], "left")
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return whole.select("page_id", F.concat(F.col("header").cast("binary"), block, F.lit(END)).alias("record"), "payload")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """One row a record, from its rebuilt bytes: page_id, payload_bytes and payload_digest of its full payload, record_type, refers_to.

    A record without a payload, or whose block or payload doesn't have the length or the digest that its header states, fails the query.
    """
    whole = reconstruct(spark, folder)
    # The header ends at the first empty line; what follows, but for the record's end, is the block.
    whole = whole.withColumn("head", F.concat(F.substring_index(F.col("record").cast("string"), "\r\n\r\n", 1), F.lit("\r\n\r\n")))
    size = F.octet_length("record") - F.octet_length("head") - len(END)
    whole = whole.withColumn("block", F.substring(F.col("record"), F.octet_length("head") + 1, size))
    parsed = fields("head")
    full = F.when(parsed["record_type"] == "response", F.col("block")).otherwise(F.col("payload"))
    whole = whole.select(F.col("page_id").alias("told"), *(c.alias(k) for k, c in parsed.items()), F.octet_length("block").cast("long").alias("block_bytes"), F.octet_length(full).cast("long").alias("payload_bytes"), F.sha2(full, 256).alias("found"))
    good = F.coalesce((F.col("found") == F.col("digest")) & (F.col("block_bytes") == F.col("length")), F.lit(False))
    wrong = F.raise_error(F.concat(F.lit("record doesn't match its header: page "), F.col("told").cast("string"))).cast("string")
    return whole.select("page_id", "payload_bytes", F.when(good, F.col("found")).otherwise(wrong).alias("payload_digest"), "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages WHERE page_id IS NOT NULL),
h AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS holder FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND holder < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND holder < page_id THEN holder END AS refers_to
FROM h
"""
