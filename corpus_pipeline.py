"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bloom, ngram_join, piece_lattice, quality_ledger, quality_rank, registry, source_mix
from textloom.tables import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near copies: Jaccard similarity, in percent, on shingles of so many words. op9's 3 and 90 hold for its query only.
WIDTH, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy of the rule ledger keeps; a null or empty text has no words and goes. Rows that are
    repeated are judged alike; other columns than those of documents are left out."""
    kept = quality_ledger.apply_policy(quality_ledger.ledger(docs.select(*COLUMNS))).filter("kept")
    return kept.select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Bradley-Terry score puts at or over its cut; without labels of both kinds all stay."""
    model = quality_rank.train(docs, table(spark, sf_dir, "labels"))
    return quality_rank.score(docs.select(*COLUMNS), model, "_quality").filter(F.col("_quality") >= quality_rank.CUT).select(*COLUMNS)


def row_key() -> Column:
    """Names a row whether or not its id is null or repeated; rows alike in it are alike in id and text."""
    return F.xxhash64("doc_id", "text")


def ngram_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: that with the least doc_id (null last); of rows with equal id and text, one.

    Most rows stay and are not shuffled: a Bloom filter of fixed size lets through those that go or are repeated, and only
    these meet the exact table.
    """
    keyed = docs.select(row_key().alias("key"), "doc_id", "text")
    found = ngram_join.near_duplicates(keyed.select(F.col("key").alias("doc_id"), "text"), WIDTH, PERCENT).groupBy(F.col("doc_id").alias("key")).agg(F.min("component_id").alias("component"), F.count("*").alias("rows"))
    named = found.join(keyed.select("key", "doc_id").distinct(), "key")
    # Members meet their component's choice by their own keys, of which none is hot.
    chosen = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"].alias("key")).select("key", F.lit(True).alias("stays"))
    special = named.join(chosen, "key", "left").select("key", F.coalesce("stays", F.lit(False)).alias("stays"), "rows").filter("NOT stays OR rows > 1").select("key", "stays")
    special = materialize(spark, special, "dropped")
    maybe = bloom.might_contain(spark.sparkContext.broadcast(bloom.build(special, "key")), "key")
    rows = docs.select(*COLUMNS, row_key().alias("key")).withColumn("maybe", maybe)
    met = rows.filter("maybe").join(special.hint("shuffle_hash"), "key", "left").filter("stays IS NULL OR stays")
    repeated = met.filter("stays").dropDuplicates(["key"])
    return rows.filter("NOT maybe").select(*COLUMNS).unionByName(met.filter("stays IS NULL").select(*COLUMNS)).unionByName(repeated.select(*COLUMNS))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the fair queue serves it; served copies are whole. Rows without an id are served like others."""
    keyed = docs.select(*COLUMNS, row_key().alias("key"))
    # Rows alike in id and text take one place in the queue after another; each key carries the copies of all of them.
    served = source_mix.weighted_fair_mix(keyed, boundary="whole", keys=("key",)).groupBy("key").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).filter("copies > 0")
    joined = keyed.join(served, "key")
    alike = joined.filter("rows > 1").dropDuplicates(["key"])
    once = joined.filter("rows = 1").unionByName(alike)
    return once.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of the best segmentation, scores and edits of the N best, and the check of the decoded texts; a null text has
    no pieces. Copies of a document are a row each."""
    return piece_lattice.encode_table(docs, registry.PIECES, keys=("doc_id", "source"))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("ngram_deduplication", ngram_deduplication),
    ("source_mixing", source_mixing),
    ("sentencepiece_encoding", sentencepiece_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier and the segmentation have no SQL form; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None
