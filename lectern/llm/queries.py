"""One registered query per operator over its whole table; the digests that the result contracts ask for."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, decontaminate, pii, piece_bpe, quality, secret_scan
from lectern.llm.arrow import shared_folder
from lectern.llm.collocations import collocations
from lectern.llm.html_text import main_text
from lectern.llm.jaccard_join import similarity_join
from lectern.llm.nearest import search
from lectern.llm.oracles import ORACLES  # noqa: F401
from lectern.llm.prefix_trie import prefix_trie
from lectern.llm.substring_dedup import substring_dedup
from lectern.llm.suffix_dedup import suffix_dedup


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _kept(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return _kept(substring_dedup(table(spark, folder, "documents").select("doc_id", "text")))


def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return _kept(suffix_dedup(table(spark, folder, "documents").select("doc_id", "text")))


def op2_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    shared_folder(spark)
    found = secret_scan.features(secret_scan.candidates(docs).checkpoint(), secret_scan.dictionary(docs))
    model = secret_scan.fit(secret_scan.rule_label(found.where(~held_out("key"))))
    return secret_scan.score(found, model).select(
        F.col("key").alias("doc_id"), F.col("n").cast("long").alias("finding"), F.sha2("candidate", 256).alias("candidate_sha256"),
        "score", (F.col("score") >= 0.5).alias("secret"))


def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    entries = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = bpe.encode(docs, entries, public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids")
    decoded = bpe.decode(encoded, entries, public_tokenizers.PATTERN)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return similarity_join(table(spark, folder, "documents").select("doc_id", "text"))


def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def quality_model(spark: SparkSession, docs: DataFrame, folder: str) -> quality.Model:
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    return quality.train(docs, labels.where(~held_out()))


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality_model(spark, docs, folder))
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op8_nearest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"))


def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    base = F.col("base")
    return pii.detect(docs).withColumn("base", pii.base_only(F.col("pii"))).select(
        "doc_id", *[pii.counted(base, k).alias(f"n_{k}") for k in pii.KINDS[:pii.BASE]],
        F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("pii")).alias("spans"))


def op11_piece_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = piece_bpe.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    encoded = piece_bpe.encode(docs, model).select("doc_id", "ids")
    return piece_bpe.decode(encoded, model).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(table(spark, folder, "conversations"))


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_html_text": op2_html_text,
    "op3_secret_scan": op3_secret_scan,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_decontaminate": op6_decontaminate,
    "op7_quality": op7_quality,
    "op8_nearest": op8_nearest,
    "op9_pii": op9_pii,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_piece_bpe": op11_piece_bpe,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_collocations": op13_collocations,
}
