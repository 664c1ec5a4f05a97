"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import chunking, decontaminate, lmscore, maincontent, neardup, pieces, substrings, tokencount, tokenstore, toxicity
from millrace.llm.runtime import ship


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_file(name: str) -> bytes:
    """A public tokenizer file, read by the driver; MILLRACE_TOKENIZERS names another folder."""
    folder = os.environ.get("MILLRACE_TOKENIZERS")
    if folder:
        return (Path(folder) / name).read_bytes()
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_bytes()


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maincontent.extract(_read(spark, sf_dir, "pages"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = lmscore.learn(docs.where(lmscore.fold("doc_id") != 1))
    out = lmscore.score(docs, model)
    return out.select("doc_id", F.coalesce(lmscore.fold("doc_id") == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"), n=3, percent=85)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.compare_with_next(_read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    fold = lmscore.fold("doc_id")
    model = toxicity.learned(docs, _read(spark, sf_dir, "labels"), fold != 0)
    out = toxicity.with_scores(docs, model)
    return out.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("toxic").alias("over_threshold"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    folder = tokenstore.store_folder(docs)
    manifest = tokenstore.write_shards(docs, tokenizer_file("byte_bpe_50k.json"), folder)
    return tokenstore.read_shards(manifest, folder)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encode(_read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_main_text": op1_main_text,
        "op2_decontamination": op2_decontamination,
        "op3_lm_scores": op3_lm_scores,
        "op4_near_duplicates": op4_near_duplicates,
        "op5_fingerprints": op5_fingerprints,
        "op6_toxicity": op6_toxicity,
        "op7_token_store": op7_token_store,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_token_counts": op9_token_counts,
        "op10_substring_dedup": op10_substring_dedup,
    }


ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": decontaminate.ORACLE_SQL,
    "op4_near_duplicates": neardup.ORACLE_SQL,
    "op10_substring_dedup": substrings.ORACLE_SQL,
}
