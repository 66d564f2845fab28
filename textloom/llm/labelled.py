"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, size: int) -> DataFrame:
    """doc_id, text, label of at most `size` labelled documents outside the held-out remainder, by order of a hash of their ids.

    The chosen ids are at most `size` rows of two numbers, which is the proven bound for broadcasting them. Labels are 0
    or 1; null labels are left out. Of repeated labels of one id the least counts, of repeated documents the least text.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), mod) != held))
    chosen = known.select("doc_id", F.col(label).cast("int").alias("label")).groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text"))
