"""Corpus pipeline: quality filter, near-duplicate removal, decontamination, redaction of personal data, tokenization.

Every stage takes (spark, docs, folder of the tables) and works on all that the stage before it kept; each result is
written as Parquet in the shared checkpoint folder and read again. All stages but the last return the columns of
documents. The stages read whole texts; null and empty texts pass those that find nothing in them.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, decontaminate, pii, quality
from lectern.llm.arrow import shared_folder, stored
from lectern.llm.jaccard_join import component_firsts
from lectern.llm.queries import quality_model, table


def keep_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels outside the held-out part, does not reject."""
    scored = quality.score(docs, quality_model(spark, docs, folder), name="__score")
    return scored.where("__score >= 0.7").select(*[f"`{c}`" for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of linked documents, that of the least id, among equal ids of the least text fingerprint.

    Of rows equal in id and text one stays; rows without an id cannot be named as copies and stay.
    """
    first = component_firsts(docs.select("doc_id", "text")).toDF("__id", "__first")
    marked = docs.withColumn("__mark", F.xxhash64("text"))
    named = marked.join(first, (F.col("doc_id") == F.col("__id")) & (F.col("__mark") == F.col("__first")), "left_semi")
    return named.dropDuplicates(["doc_id", "__mark"]).drop("__mark").unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in which no window of a benchmark item stands."""
    return decontaminate.remove_contaminated(docs, table(spark, folder, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows the new text where it was known."""
    redacted = pii.redact(docs)
    if "n_chars" in docs.columns:
        redacted = redacted.withColumn("n_chars", F.when(F.col("n_chars").isNotNull() & F.col("text").isNotNull(),
                                                         F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return redacted


def tokenize(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of each document (packed little-endian unsigned 32-bit integers), proved by decoding them.

    The ids are stored before they are decoded: in one stage each task would hold two workers with a tokenizer each.
    """
    entries = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), entries, public_tokenizers.PATTERN)
    decoded = bpe.decode(stored(encoded, "ids"), entries, public_tokenizers.PATTERN)
    exact = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return decoded.select("doc_id", "lang", "source", "n_tokens", "ids",
                          F.when(exact, True).otherwise(F.raise_error(F.lit("decoding does not give the text"))).alias("exact"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("tokens", tokenize),
]

#: SQL cannot express the classifier, the tokenizer or the redaction; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
