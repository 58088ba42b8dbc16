"""A corpus pipeline: language, near-duplicates, benchmark passages, personal data, packing.

Every stage reads what its predecessor kept and is written as Parquet before the
next one starts, so a lost executor costs tasks, not stages.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe.llm import decontaminate, language, minhash, packing, pii
from tallyframe.operators.joins import exclude_ids
from tallyframe.sources.files import load
from tallyframe.sources.staging import staged

# A text stays with this share of the score that texts of its language usually get.
LEAST_SHARE, KEPT_OUT = 1 / 3, 5
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
# At 0.8 a pair shares no band with probability (1 - 0.8**4)**28 = 4e-7.
BANDS, ROWS = 28, 4
LEAST_PII_SCORE = 0.4


def _kept(docs: DataFrame, beside: str = "text") -> DataFrame:
    """All columns as one, so that no column a stage adds can clash with them."""
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"), F.col(beside)
    )


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined.

    Texts that are null or without letters go, and those whose best language has
    a pooled probability below ``LEAST_SHARE`` of what is usual for it, measured on
    labelled texts that the network was not trained on; so the limit does not
    depend on the number of languages.  If no document names a language there is
    nothing to learn from and all documents with letters stay.
    """
    network = language.train(docs, long_texts=True, kept_out=KEPT_OUT)
    if network is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    judged = language.identify(_kept(docs), network, keep=("kept",))
    # One entry per learned language, whose number the training sample bounds.
    usual = F.create_map(*[F.lit(v) for pair in network.usual.items() for v in pair])
    return judged.where(
        (F.col("lang_pred") != language.UNDETERMINED)
        & (F.col("score") >= LEAST_SHARE * usual[F.col("lang_pred")])
    ).select("kept.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of every group of near-duplicates.

    Groups are components over shingles of five words at a similarity of 0.8.
    Texts without words and rows without id are kept; of rows that repeat an id
    and a text one stays.
    """
    judged = staged(
        minhash.near_duplicates(
            docs, words=SHINGLE_WORDS, percent=SIMILAR_PERCENT, bands=BANDS, rows=ROWS
        ), "judged",
    )
    copies = judged.where("doc_id is not null and not kept").select("doc_id").distinct()
    # Texts that are surely no copies stay where they are.
    left = exclude_ids(_kept(docs, "doc_id"), copies, "doc_id", sieve=True).select("kept.*")
    repeated = judged.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        return left
    return (
        left.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
        .unionByName(left.where("doc_id is null"))
    )


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of a benchmark item."""
    found = decontaminate.find_passages(_kept(docs), load(spark, sf_dir, "benchmark"), keep=("kept",))
    return found.where("not contaminated").select("kept.*")


def pii_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and ``n_chars`` counted anew."""
    masked = pii.mask_pii(docs, "text", least=LEAST_PII_SCORE)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a training sequence."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii_masking),
    ("packing", packed),
]

# Trained models and tokenizers have no SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of all documents that the stages keep."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
