"""A content-addressed web archive.

``payloads`` keeps every distinct payload once, under its SHA-256; ``headers``
keeps the exact header block of each record with the digest of its payload.
Records are put together again by joining the two.  Reading hashes each stored
payload anew and compares lengths, and fails on the first that does not agree.
Payloads lie in buckets of their digest, so that a join which is told so moves
headers only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, StringType, StructType

from tallyframe.sources.files import read_bucketed
from tallyframe.sources.staging import shared_folder

LEAST = 100  # bytes from which an equal payload becomes a revisit
DATE = "1970-01-01T00:00:00Z"
END = "\r\n"
PAYLOADS = StructType().add("digest", StringType()).add("payload", BinaryType())
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def new_folder(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/{app}/archive-{uuid.uuid4().hex}"


def _line(name: str, value: Column) -> Column:
    """A header line; no line at all where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def _record_id(number: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), number.cast("string"), F.lit(">"))


def header(page_id: Column, url: Column, size: Column, digest: Column, refers_to: Column,
           revisit: Column, date: str) -> Column:
    """The header block of a record, up to and with the blank line before its block."""
    one_line = F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")
    return F.concat(
        F.lit(f"WARC/1.1{END}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(page_id)),
        _line("WARC-Target-URI", one_line),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        _line("WARC-Profile", F.when(revisit, REVISIT)),
        _line("WARC-Refers-To", _record_id(refers_to)),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, 0).otherwise(size).cast("string")),
        F.lit(END),
    ).cast("binary")


def write_archive(pages: DataFrame, folder: str, least: int = LEAST, date: str = DATE) -> int:
    """Write one record per row of ``pages`` (page_id, url, html) to ``folder``.

    A null html is an empty payload.  Of rows with equal payloads of at least
    ``least`` bytes those with the smallest page_id are responses, which are
    several only if rows repeat that id; the others revisit it.  Where no row of
    a payload has an id, all are responses.  The payload table is written from
    one shuffle in which each task has already merged its own equal payloads;
    the headers never move a payload.  Returns the number of buckets of the
    payload table, one per shuffle partition.
    """
    buckets = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pages.select(
        pages["page_id"], pages["url"].cast("string").alias("url"),
        F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    # The shuffle deals digests as buckets do, so each bucket is written by one task.
    name = f"archive_{uuid.uuid4().hex}"
    rows.groupBy("digest").agg(F.any_value("payload").alias("payload")).write.format("parquet").option(
        "path", f"{folder}/payloads"
    ).bucketBy(buckets, "digest").sortBy("digest").saveAsTable(name)
    pages.sparkSession.sql(f"DROP TABLE {name}")  # the files stay
    light = rows.withColumn("size", F.octet_length("payload").cast("long")).drop("payload")
    first = light.groupBy("digest").agg(F.min("page_id").alias("first"))
    revisit = (
        (F.col("size") >= least) & F.col("first").isNotNull()
        & ~F.col("page_id").eqNullSafe(F.col("first"))
    )
    light.join(first, "digest").select(
        "page_id", "digest", "size",
        header(
            F.col("page_id"), F.col("url"), F.col("size"), F.col("digest"),
            F.when(revisit, F.col("first")), revisit, date,
        ).alias("header"),
    ).write.parquet(f"{folder}/headers")
    return buckets


def _verified(payloads: DataFrame) -> DataFrame:
    return payloads.select(
        "digest", "payload", F.octet_length("payload").cast("long").alias("stored"),
        F.when(F.sha2("payload", 256) == F.col("digest"), F.col("digest")).otherwise(
            F.raise_error(F.concat(F.lit("payload differs from its digest "), F.col("digest")))
        ).alias("verified"),
    )


def read_archive(spark: SparkSession, folder: str, buckets: int | None = None) -> DataFrame:
    """All records: their ids, verified payloads, headers as written, and exact bytes.

    ``payload`` is the page's payload, also for a revisit; ``record`` is the
    record itself, whose block is empty for a revisit.  What is not selected is
    neither joined nor moved.  With ``buckets``, as ``write_archive`` returned
    them, payloads are joined where they lie.
    """
    headers = spark.read.parquet(f"{folder}/headers")
    path = f"{folder}/payloads"
    if buckets:
        stored = read_bucketed(spark, path, PAYLOADS, "digest", buckets)
    else:
        stored = spark.read.schema(PAYLOADS).parquet(path)
    payloads = _verified(stored)
    text = F.col("header").cast("string")
    field = lambda name: F.regexp_extract(text, rf"\r\n{name}: ([^\r]*)\r\n", 1)
    kind = field("WARC-Type")
    block = F.when(kind == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    size = F.when(F.col("size") == F.col("stored"), F.col("stored")).otherwise(
        F.raise_error(F.concat(F.lit("wrong length of "), F.col("digest")))
    )
    refers = F.regexp_extract(field("WARC-Refers-To"), "<urn:page:(.*)>", 1)
    return headers.join(payloads, "digest", "left").select(
        "page_id", size.alias("payload_bytes"),
        F.coalesce("verified", F.raise_error(F.concat(F.lit("no payload "), F.col("digest")))).alias(
            "payload_digest"
        ),
        kind.alias("record_type"),
        F.when(refers != "", refers).cast(headers.schema["page_id"].dataType).alias("refers_to"),
        "header", "payload",
        F.concat(F.col("header"), block, F.lit(END + END).cast("binary")).alias("record"),
    )
