"""JSON-lines and text files, their error files, and counters.

Defined results: nulls are written and read as nulls; rows are written in any order and as often as they occur; an empty
table gives files without rows; a missing path is Spark's own error except for sets of what is done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from textloom.operators.canonical import corpus_rows, index_rows, text_block

INDEX = "title string, url string"
RAW = "artist string, title string, url string, lyrics string"
MARKED = "artist string, title string, url string, lyrics_clean string, sections array<struct<type:string,index:int,speaker:string,text:string,order:int>>, dominant_voice string"
CORPUS = "artist string, title string, url string, dominant_voice string, structure string, text string"
CHAT = "messages array<struct<role:string,content:string>>"


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line, blank lines skipped; a broken line fails the job, a missing path the plan."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet of all folders batch=<number> below a path, with the number as `batch`; a missing path is an empty table."""
    schema = f"{schema}, batch bigint"
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def read_done(spark: SparkSession, path: str, column: str = "url") -> DataFrame:
    """Distinct values of a column; broken lines are skipped, a missing path is an empty set."""
    if not _exists(spark, path):
        return spark.createDataFrame([], f"{column} string")
    return spark.read.schema(f"{column} string").option("mode", "DROPMALFORMED").json(path).filter(F.col(column).isNotNull()).distinct()


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object a line, characters as they are, nulls written."""
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def counted(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """rows, and an observation whose `n` is their number once an action has run."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("n")), seen


def write_canonical(canonical: DataFrame, folder: str) -> int:
    """Corpus text, corpus JSON lines and index of canonical songs, from one computation; returns the number of songs."""
    kept = canonical.persist()
    try:
        rows, seen = counted(kept, "songs")
        write_jsonl(corpus_rows(rows), f"{folder}/canonical_corpus.jsonl")
        text_block(kept).write.mode("overwrite").text(f"{folder}/canonical_corpus.txt")
        write_jsonl(index_rows(kept), f"{folder}/canonical_index.jsonl")
        return seen.get["n"]
    finally:
        kept.unpersist()


def error_lines(rows: DataFrame, kind: str, url: str = "url", title: str = "title", detail: str | None = None) -> DataFrame:
    """Tab-separated error lines: kind, url, title, and what was raised."""
    columns = [F.col(kind), F.col(url), F.col(title), *([F.col(detail)] if detail else [])]
    return rows.filter(F.col(kind).isNotNull()).select(F.concat_ws("\t", *columns).alias("value"))


def write_errors(rows: DataFrame, path: str, kind: str, mode: str = "append", **names: str) -> None:
    error_lines(rows, kind, **names).write.mode(mode).text(path)


def read_splits(spark: SparkSession, folder: str) -> DataFrame:
    """messages, split of the train and valid files."""
    part = lambda name: read_strict(spark, f"{folder}/{name}.jsonl", CHAT).withColumn("split", F.lit(name))
    return part("train").unionByName(part("valid"))


def write_splits(examples: DataFrame, folder: str) -> None:
    """The `split` column's rows as train.jsonl and valid.jsonl."""
    for name in ("train", "valid"):
        write_jsonl(examples.filter(F.col("split") == name).select("messages"), f"{folder}/{name}.jsonl")
