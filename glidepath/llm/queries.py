"""The queries of this package, one per operator, over the whole table `documents`."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glidepath.llm import (
    alignment, anchors, arrowfiles, bpecount, hilbert, merkle, packing, perplexity, recipes, secrets, simhash, sqltwins, surrogates, tiling)

#: The path of a tokenizer's file is a parameter of each operator; the queries take the public ones.
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: Production takes the key from its secret store.
SURROGATE_KEY = "surrogate-key"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), WORD_TOKENIZER, end_id=2)


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = hilbert.hilbert_shards(documents(spark, sf_dir), shards=8)
    return shards.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
                         "hilbert_index")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = anchors.remove_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("removed").cast("long").alias("n_stretches"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_entropy")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrowfiles.token_files(documents(spark, sf_dir), WORD_TOKENIZER, end_id=1)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), width=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpecount.token_counts(documents(spark, sf_dir), PIECE_MODEL, limit=4096)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminations(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = perplexity.quality(documents(spark, sf_dir), columns=["doc_id"])
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "nll")


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymised(documents(spark, sf_dir).select("doc_id", "text"), SURROGATE_KEY)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignments(documents(spark, sf_dir), BYTE_TOKENIZER, PIECE_MODEL)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    rows = merkle.audited(documents(spark, sf_dir), ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", {"text": tampered})
    return rows.select("doc_id", *[merkle.text_of(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
                       merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def op13_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.exact_duplicates(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_hilbert_shards, op3_substring_dedup, op4_secrets, op5_token_files, op6_near_duplicates,
                            op7_token_counts, op8_decontamination, op9_quality, op10_surrogates, op11_alignment, op12_merkle_manifest,
                            op13_exact_duplicates)}
#: SQL states none of the others: encoders, curves, rolling hashes, fingerprints and tiles. Brute-force versions in tests/llm do.
SQL: dict[str, str] = {"op12_merkle_manifest": sqltwins.OP12, "op13_exact_duplicates": sqltwins.OP13}
