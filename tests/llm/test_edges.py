"""Every operator on hard rows and on an empty table: one defined row for each row, reruns alike."""

import pytest
from pyspark.sql import functions as F

from textloom.llm import media, ngram_join, piece_lattice, pitman_yor, quality_ledger, quality_rank, registry, source_mix, token_cache, toxic_neighbours, warc
from textloom.tables import scratch_path


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(1, 14)] + [(4, None, None), (None, 1, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "op1": lambda d, _: piece_lattice.op1_sentencepiece_nbest(d, registry.PIECES),
    "op2": lambda d, _: media.op2_avi_mjpeg(d),
    "op3": lambda d, _: quality_ledger.op3_quality_ledger(d),
    "op4": lambda d, _: source_mix.op4_weighted_fair_mix(d),
    "op5": lambda d, _: token_cache.op5_digest_token_counts(d, registry.BYTE_BPE),
    "op6": lambda d, _: pitman_yor.op6_pitman_yor(d),
    "op7": lambda d, _: warc.op7_warc_salvage(d.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html")), scratch_path(d.sparkSession, "warc")),
    "op8": lambda d, x: quality_rank.op8_bradley_terry_quality(d, x),
    "op9": lambda d, _: ngram_join.op9_ngram_jaccard_join(d),
    "op10": lambda d, x: toxic_neighbours.op10_toxic_neighbours(d, x),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_hard_rows(hard, labels, name):
    once = sorted(map(str, OPERATORS[name](hard, labels).collect()))
    assert len(once) == 15
    assert once == sorted(map(str, OPERATORS[name](hard.repartition(1), labels).collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(nothing, labels, name):
    assert OPERATORS[name](nothing, labels.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["op8", "op10"])
def test_no_labels(hard, labels, name):
    rows = OPERATORS[name](hard, labels.limit(0)).collect()
    assert len(rows) == 15 and all(0 <= r["score"] <= 1 for r in rows)
