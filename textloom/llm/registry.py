"""Registered queries of this subpackage: thin wrappers that apply an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textloom.llm import media, ngram_join, piece_lattice, pitman_yor, quality_ledger, quality_rank, source_mix, token_cache, toxic_neighbours, warc
from textloom.tables import scratch_path, table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_lattice.op1_sentencepiece_nbest(table(spark, sf_dir, "documents"), PIECES)


def op2_avi_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.op2_avi_mjpeg(table(spark, sf_dir, "documents"))


def op3_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ledger.op3_quality_ledger(table(spark, sf_dir, "documents"))


def op4_weighted_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.op4_weighted_fair_mix(table(spark, sf_dir, "documents"))


def op5_digest_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_cache.op5_digest_token_counts(table(spark, sf_dir, "documents"), BYTE_BPE)


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.op6_pitman_yor(table(spark, sf_dir, "documents"))


def op7_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op7_warc_salvage(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))


def op8_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rank.op8_bradley_terry_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.op9_ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op10_toxic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_neighbours.op10_toxic_neighbours(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece_nbest": op1_sentencepiece_nbest,
    "op2_avi_mjpeg": op2_avi_mjpeg,
    "op3_quality_ledger": op3_quality_ledger,
    "op4_weighted_fair_mix": op4_weighted_fair_mix,
    "op5_digest_token_counts": op5_digest_token_counts,
    "op6_pitman_yor": op6_pitman_yor,
    "op7_warc_salvage": op7_warc_salvage,
    "op8_bradley_terry_quality": op8_bradley_terry_quality,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_toxic_neighbours": op10_toxic_neighbours,
}
ORACLES: dict[str, str] = {
    "op3_quality_ledger": quality_ledger.ORACLE,
    "op4_weighted_fair_mix": source_mix.ORACLE,
    "op7_warc_salvage": warc.ORACLE,
    "op9_ngram_jaccard_join": ngram_join.ORACLE,
}
