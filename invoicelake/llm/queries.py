"""Queries of the operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from invoicelake.llm.bpe import bpe_encode
from invoicelake.llm.bytebpe import rank_encode
from invoicelake.llm.common import crc_of_id, stored
from invoicelake.llm.decontaminate import leaks
from invoicelake.llm.hardneg import hard_negatives
from invoicelake.llm.merkle import fold, merkle_proofs, siblings
from invoicelake.llm.neardup import near_duplicates
from invoicelake.llm.oracles import ORACLES  # noqa: F401
from invoicelake.llm.passages import repeated_passages
from invoicelake.llm.quality import BASE, ablations, ledger, passes, sole_rule
from invoicelake.llm.secrets import BASE_KINDS, count_of, joined, scan_secrets
from invoicelake.llm.sharding import write_shards
from invoicelake.llm.tokencount import token_counts
from invoicelake.llm.tokenfile import read_token_files, write_token_files
from invoicelake.llm.toxicity import THRESHOLD, held_out, score_toxicity, train_on_tables

WORD_TOKENIZER, BYTE_TOKENIZER = "word_bpe_49k.json", "byte_bpe_50k.json"
BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The id that closes documents in token files, the one that separates them in flat files, bytes of a shard.
END_ID, SEPARATOR, SHARD_BYTES = 2, 49407, 1 << 20


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ["doc_id", "text"]))


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_encode(documents(spark, sf_dir), public_tokenizers.path(WORD_TOKENIZER), decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(documents(spark, sf_dir), public_tokenizers.path(BYTE_TOKENIZER), END_ID)
    return read_token_files(spark, files)


def op4_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(documents(spark, sf_dir))
    counts = [count_of(kind, "secrets").cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans")
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train_on_tables(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards are written with their texts; the rows are read from them."""
    rows = documents(spark, sf_dir).withColumn("n_bytes", F.octet_length("text"))
    folder = write_shards(rows, SHARD_BYTES, "doc_id", F.col("n_bytes"), row=F.col("text"))
    return spark.read.parquet(folder).select("doc_id", "n_bytes", "shard", "shard_depth", "shard_bytes")


def op8_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = stored(ledger(documents(spark, sf_dir)).drop("text"), "ledger")
    cases = ablations(book, ["v1"]).select(F.col("rule").alias("sole_rule"), "rejected", "kept_without_rule")
    return book.withColumn("sole_rule", sole_rule("v1")).join(F.broadcast(cases), "sole_rule", "left").select(  # a row a rule
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (F.col("failed_bits").bitwiseAND(F.lit(BASE)) != 0).alias("base_failed"),
        passes("v1").alias("kept"),
        "failed_bits",
        "sole_rule",
        F.col("rejected").alias("rule_rejected"),
        F.col("kept_without_rule").alias("rule_kept_without"),
    )


def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path(WORD_TOKENIZER), SEPARATOR)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id = F.col("vec_id")
    label = F.when(vec_id % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), vec_id % 100 == 0, label)


def op12_byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path(BYTE_RANKS)
    coded = rank_encode(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN, decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(crc_of_id() % 5 == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    docs = documents(spark, sf_dir, "doc_id", "source", "lang", "n_chars", "text")
    proofs = merkle_proofs(docs, altered={"text": tampered})
    folded = proofs.withColumn("folded_root", fold(F.col("altered_leaf"), F.col("proof")))
    return folded.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_token_files": op3_token_files,
    "op4_secret_spans": op4_secret_spans,
    "op5_toxicity": op5_toxicity,
    "op6_repeated_passages": op6_repeated_passages,
    "op7_shards": op7_shards,
    "op8_quality_ledger": op8_quality_ledger,
    "op9_benchmark_leaks": op9_benchmark_leaks,
    "op10_token_counts": op10_token_counts,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_byte_bpe_round_trip": op12_byte_bpe_round_trip,
    "op13_merkle_proofs": op13_merkle_proofs,
}
