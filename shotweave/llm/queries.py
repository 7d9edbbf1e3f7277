"""One thin query for each operator, over whole tables, and SQL where it can give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, exact, fim, fuzzy, licenses, lm, mixing, phrases, quality, simhash, substring, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.without_repeats(_table(spark, sf_dir, "documents"), rereadable=True))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_notices(_table(spark, sf_dir, "documents"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.backoff_scores(_table(spark, sf_dir, "documents"), order=3, rereadable=True)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.in_order(chat.with_probe(_table(spark, sf_dir, "conversations")))
    return chat.digests(chat.rendered(turns))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.digest(fuzzy.edited_likeness(_table(spark, sf_dir, "documents")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.fill_in_middle(_table(spark, sf_dir, "documents")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.digest(phrases.collocations(_table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_quality, op2_simhash, op3_exact_dedup, op4_decontaminate, op5_mix_sources, op6_substring_dedup, op7_token_counts, op8_license_scan, op9_lm_scores, op10_chat_format, op11_fingerprints, op12_fill_in_middle, op13_collocations)}
ORACLE_SQL = {"op3_exact_dedup": exact.SQL, "op4_decontaminate": decontam.SQL, "op5_mix_sources": mixing.SQL, "op6_substring_dedup": substring.SQL, "op10_chat_format": chat.SQL, "op12_fill_in_middle": fim.SQL, "op13_collocations": phrases.SQL}
