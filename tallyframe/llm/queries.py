"""The operators bound to the tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe.llm import (
    clusters, decontaminate, language, minhash, negatives, oracles, packing, pii, records,
    sharding, tokens, urls, vectors, warc,
)
from tallyframe.sources.files import load

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc(spark: SparkSession, directory: str) -> DataFrame:
    """The archive of all pages, written to the shared folder and read back; digests of the rebuilt records."""
    folder = warc.new_folder(spark)
    buckets = warc.write_archive(load(spark, directory, "pages"), folder)
    return warc.read_archive(spark, folder, buckets).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
        F.octet_length("record").cast("long").alias("record_bytes"),
        F.sha2("record", 256).alias("record_sha256"),
    )


def op2_urls(spark: SparkSession, directory: str) -> DataFrame:
    model = urls.train(urls.labelled_table(spark))
    return urls.judge_urls(load(spark, directory, "pages"), model)


def op3_pii(spark: SparkSession, directory: str) -> DataFrame:
    return pii.summarise_pii(load(spark, directory, "documents"))


def op4_minhash(spark: SparkSession, directory: str) -> DataFrame:
    return minhash.near_duplicates(load(spark, directory, "documents"))


def op5_language(spark: SparkSession, directory: str) -> DataFrame:
    """Trained on the documents that are not held out; predicted for all."""
    docs = load(spark, directory, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    network = language.train(docs.where(~held_out), long_texts=True)
    return language.identify(docs, network).withColumn("held_out", held_out)


def op6_tokens(spark: SparkSession, directory: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return tokens.count_tokens(load(spark, directory, "documents"), path, limit=1024)


def op7_vectors(spark: SparkSession, directory: str) -> DataFrame:
    return vectors.near_vectors(load(spark, directory, "embeddings"))


def op8_sharding(spark: SparkSession, directory: str) -> DataFrame:
    return sharding.shard_documents(load(spark, directory, "documents"), shards=24)


def op9_packing(spark: SparkSession, directory: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(load(spark, directory, "documents"), path, end_id=2)


def op10_decontaminate(spark: SparkSession, directory: str) -> DataFrame:
    docs, benchmark = load(spark, directory, "documents"), load(spark, directory, "benchmark")
    return decontaminate.find_passages(docs, benchmark)


def op11_clusters(spark: SparkSession, directory: str) -> DataFrame:
    """Forty centroids, moved five times; the first ones are drawn by a hash of the id."""
    made = clusters.cluster_vectors(
        load(spark, directory, "embeddings"), clusters=40, rounds=5, width=64,
        start=lambda vec_id: F.sha2(F.concat(F.lit("2:"), vec_id.cast("string")), 256),
    )
    return clusters.assignments(made, spark).withColumnRenamed("id", "vec_id")


def op12_records(spark: SparkSession, directory: str) -> DataFrame:
    """All token sequences, written as records in ascending order and read back."""
    folder, path = records.new_folder(spark), public_tokenizers.path("word_bpe_49k.json")
    records.write_records(load(spark, directory, "documents"), folder, path, end_id=2)
    records.write_index(spark, folder)
    return records.read_index(spark, folder).withColumnRenamed("id", "doc_id")


def op13_negatives(spark: SparkSession, directory: str) -> DataFrame:
    """Anchors are the ids divisible by 50; labels of ids divisible by 7 move on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(
        load(spark, directory, "embeddings"), label, anchors=F.col("vec_id") % 50 == 0,
        positives=5, negatives=3, low=50, high=95,
    )


QUERIES: dict[str, Query] = {
    "op1_warc": op1_warc,
    "op2_urls": op2_urls,
    "op3_pii": op3_pii,
    "op4_minhash": op4_minhash,
    "op5_language": op5_language,
    "op6_tokens": op6_tokens,
    "op7_vectors": op7_vectors,
    "op8_sharding": op8_sharding,
    "op9_packing": op9_packing,
    "op10_decontaminate": op10_decontaminate,
    "op11_clusters": op11_clusters,
    "op12_records": op12_records,
    "op13_negatives": op13_negatives,
}
ORACLE_SQL: dict[str, str] = {
    "op11_clusters": oracles.clusters(40, 5, 64),
    "op13_negatives": oracles.NEGATIVES,
}
