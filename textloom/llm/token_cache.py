"""Token counts by a digest cache: counts are stored under (content digest, tokenizer digest); only distinct contents that
the cache lacks are encoded, and their counts are appended to it.

Representatives of missing contents are chosen on digests alone (map-side combined, so a text that a third of all rows
share is one row per task), then fetched by row id, which has no hot keys: the text is shuffled once, and not at all where
nothing is missing. Counts go back to the rows by digest; the digests of a HOT share of all rows or more, of which there are
at most 1 / HOT, are salted on both sides. The cache is partitioned by tokenizer.

A digest is that of the text as it is: tokenizers count white space, case and Unicode forms, so that any folding could give
one entry to texts with different counts. Null is the only form that is normalised, to the empty text.

Defined results: a null text is the empty text with 0 tokens; repeated rows and equal texts share one cache entry; an
empty table appends nothing; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import tokens
from textloom.tables import materialize, scratch_path

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens bigint"
#: The pre-tokenizer pattern of the byte-level BPE family.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Outside these characters, Unicode tables of two libraries may differ; such texts go to the tokenizer whole.
PLAIN = re.compile(r"[^\n\t\r -~\xa1-ɏ]")
MEMO = 400_000
#: Least share of rows of a digest that is salted.
HOT = 2.0**-10


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


class Counter:
    """Counts tokens of whole texts as the tokenizer does, with a bounded memo of pre-token counts."""

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        added = [t["content"] for t in spec.get("added_tokens", [])]
        # The memo holds for byte-level BPE with the usual pattern; any other tokenizer gets whole texts.
        self.by_pieces = spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec["model"].get("ignore_merges")
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.pieces = regex.compile(PRE_TOKENS).findall
        self.memo: dict[str, int] = {}

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        out: list[int | None] = [None] * len(texts)
        plain, rest = [], []
        for i, text in enumerate(texts):
            special = self.special and self.special.search(text)
            (rest if not self.by_pieces or special or PLAIN.search(text) else plain).append(i)
        for i, n in zip(rest, self.whole([texts[i] for i in rest]), strict=True):
            out[i] = n
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        cut = [self.pieces(texts[i]) for i in plain]
        missing = list(set().union(*map(set, cut)).difference(memo))
        memo.update(zip(missing, self.whole(missing), strict=True))
        get = memo.__getitem__
        for i, found in zip(plain, cut, strict=True):
            out[i] = sum(map(get, found))
        return out


def encode_counts(path: str):
    """mapInArrow function: content_digest, text -> content_digest, n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = Counter(path)
        for batch, texts in tokens.text_batches(batches):
            counts = counter.count([x.decode("utf-8", "replace") for x in texts])
            yield pa.RecordBatch.from_arrays([batch.column("content_digest").cast(pa.binary()), pa.array(counts, pa.int64())], ["content_digest", "n_tokens"])

    return run


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_cache(spark: SparkSession, path: str, digest: str) -> DataFrame:
    """content_digest, n_tokens of one tokenizer version; one row per content even if writers raced."""
    stored = spark.read.schema(CACHE_SCHEMA).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], CACHE_SCHEMA)
    return stored.filter(F.col("tokenizer_digest") == digest).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = 1024) -> DataFrame:
    """doc_id, text -> doc_id, n_bytes, n_tokens, over_limit, content_digest. Appends what is missing to the cache at path `cache`."""
    spark = docs.sparkSession
    tokens.bound_batches(spark)
    version = file_digest(tokenizer)
    content = F.coalesce(F.col("text"), F.lit(""))
    digest, row_id = F.unhex(F.sha2(content, 256)).alias("content_digest"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("row_id")
    rows = materialize(spark, docs.select("doc_id", digest, F.octet_length(content).cast("long").alias("n_bytes")), "digests")
    known = read_cache(spark, cache, version).select("content_digest")
    distinct = rows.select("content_digest", row_id).groupBy("content_digest").agg(F.min("row_id").alias("row_id"), F.count("*").alias("rows"))
    least = max(2, int(rows.count() * HOT))
    hot = distinct.filter(F.col("rows") > least).select("content_digest", F.ceil(F.col("rows") / least).cast("int").alias("salts")).collect()
    wanted = distinct.select("content_digest", "row_id").join(known, "content_digest", "left_anti")
    misses = docs.select(row_id, digest, content.alias("text")).join(wanted.hint("shuffle_hash"), ["row_id", "content_digest"], "left_semi")
    counted = misses.select("content_digest", "text").mapInArrow(encode_counts(tokenizer), "content_digest binary, n_tokens bigint")
    counted.select("content_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens").write.mode("append").partitionBy("tokenizer_digest").parquet(cache)
    salts = F.broadcast(spark.createDataFrame(hot, "content_digest binary, salts int"))
    counts = read_cache(spark, cache, version).join(salts, "content_digest", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    salted = rows.join(salts, "content_digest", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1))).cast("int"))
    out = salted.join(counts, ["content_digest", "salt"], "left")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "content_digest")


def op5_digest_token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Contract columns; starts from an empty cache in the shared folder."""
    return count_tokens(docs, tokenizer, scratch_path(docs.sparkSession, "token-cache")).drop("content_digest")
