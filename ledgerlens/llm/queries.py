"""Queries of this folder: name to (session, table directory) -> rows, and SQL where SQL can give the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import chunk_dedup, collocations, conversation_trie, decontamination, embedding_dedup, jaccard_join, mixing, packing, secret_scan, sql, substring_dedup, suffix_dedup, toxicity, warc
from ledgerlens.llm.common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed vocabulary files are; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"),
    )


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets_of(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.exact_duplicates(table(spark, sf_dir, "documents")).drop("n_chunks")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.linked_vectors(table(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents")).drop("removed")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_groups(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(table(spark, sf_dir, "documents")).drop("removed")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontamination.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    found = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), found.alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_secrets, op3_exact_dedup, op4_packing, op5_embedding_dedup, op6_mixing, op7_suffix_dedup, op8_jaccard_join, op9_warc, op10_substring_dedup, op11_collocations, op12_conversation_trie, op13_decontamination)
}

ORACLES: dict[str, str] = {
    "op3_exact_dedup": sql.EXACT_DEDUP,
    "op6_mixing": sql.MIXING,
    "op9_warc": sql.WARC,
    "op10_substring_dedup": sql.SUBSTRING_DEDUP,
    "op11_collocations": sql.COLLOCATIONS,
    "op12_conversation_trie": sql.TRIE,
    "op13_decontamination": sql.DECONTAMINATION,
}
