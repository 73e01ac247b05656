"""The registered queries of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import (
    fingerprints, language, line_dedup, mixing, near_dedup, packing, prefix_trie, quality_classifier, quality_rules,
    sharding, signature_tree, spelling, toxicity,
)
from cairn.llm.common import documents

SHARDS = 16
#: predicted is 1 from this score on.
THRESHOLD = 0.3


def vocabulary() -> str:
    """Path of the public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def held_out(parts: int, part: int):
    """Whether crc32 of doc_id as text leaves that remainder; null ids never do."""
    left = F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == part
    return F.coalesce(left, F.lit(False))


def op1_language_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every text."""
    docs = documents(spark, folder)
    model = language.fit(docs.select("doc_id", "text", "lang").filter(~held_out(3, 1)))
    return language.identify(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")


def op2_jump_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 16 shards by jump consistent hashing of doc_id."""
    return sharding.manifest(documents(spark, folder), SHARDS)


def op3_toxic_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every text by its maximum-scoring segments."""
    docs = documents(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter(~held_out(4, 2))
    model = toxicity.fit(toxicity.labelled(docs, labels, "toxic"))
    return toxicity.scored(docs, model).select(
        "doc_id", held_out(4, 2).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("passages").alias("n_passages"),
    )


def op4_mixed_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by epoch in a mix of as many tokens as there are, at most two epochs of any source."""
    return mixing.mixed(documents(spark, folder))


def op5_adaptive_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of every text and the verdict of rules with thresholds per language and source."""
    return quality_rules.judged(documents(spark, folder))


def op6_rule_ensemble(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every text by weighted rules over its statistics."""
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter(~held_out(5, 0))
    return quality_classifier.scored(documents(spark, folder), labels, "quality").select(
        "doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def op7_near_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Class of near duplicates of every document."""
    return near_dedup.classes(documents(spark, folder))


def op8_packed_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return packing.packed(documents(spark, folder), vocabulary())


def op9_bottom_k(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint of every text and of its edited text, and how alike they are."""
    return fingerprints.edited_pairs(documents(spark, folder))


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines found in three documents or more, kept in the last of them only."""
    return line_dedup.line_report(documents(spark, folder))


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all texts with the form and root they are spelling variants of."""
    return spelling.variants(documents(spark, folder))


def op12_signature_join(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document under links of 0.8 or more between sets of word shingles."""
    return signature_tree.linked_documents(documents(spark, folder))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """All nodes of the prefix trie of rebuilt conversations, with sums over their subtrees."""
    return prefix_trie.trie(spark.read.parquet(f"{folder}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_filters": op1_language_filters,
    "op2_jump_shards": op2_jump_shards,
    "op3_toxic_segments": op3_toxic_segments,
    "op4_mixed_sources": op4_mixed_sources,
    "op5_adaptive_rules": op5_adaptive_rules,
    "op6_rule_ensemble": op6_rule_ensemble,
    "op7_near_classes": op7_near_classes,
    "op8_packed_sequences": op8_packed_sequences,
    "op9_bottom_k": op9_bottom_k,
    "op10_line_dedup": op10_line_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_signature_join": op12_signature_join,
    "op13_prefix_trie": op13_prefix_trie,
}
