"""Restartable crawl results: pages arrive as files, and songs that the output lacks are appended, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.sources import html, records

PAGES = "page_id bigint, url string, html string"


def append_new(pages: DataFrame, output: str, errors: str, artist: str, selectors: list | None = None, batch: int = 0) -> None:
    """Extract the pages whose url no earlier batch has done; add songs, and error lines of pages that failed or are short.

    Each batch has folders of its own below output, errors and output + ".done" (the urls of its songs, as Parquet), which
    it overwrites: a batch that is repeated after a failure, wherever that came, adds nothing twice. The anti-join reads the
    urls alone and comes before the parser. Pages that failed or are short are tried again when they arrive again.
    """
    spark, done = pages.sparkSession, output.rstrip("/") + ".done"
    earlier = records.read_batches(spark, done, "url string").filter(F.col("batch") != batch).select("url")
    fresh = pages.join(earlier, "url", "left_anti")
    text = html.length_gate(html.extract_text(fresh, "url", selectors=selectors)).persist()
    try:
        good = text.filter("error IS NULL AND status IS NULL")
        records.write_jsonl(good.select(F.lit(artist).alias("artist"), F.lit(None).cast("string").alias("title"), "url", F.col("text").alias("lyrics")), f"{output}/batch={batch}")
        bad = text.withColumn("kind", F.when(F.col("error").isNotNull(), "ERROR").otherwise(F.col("status"))).withColumn("title", F.lit(""))
        records.write_errors(bad, f"{errors}/batch={batch}", "kind", detail="error", mode="overwrite")
        good.select("url").distinct().write.mode("overwrite").parquet(f"{done}/batch={batch}")
    finally:
        text.unpersist()


def follow(spark: SparkSession, source: str, output: str, errors: str, checkpoint: str, artist: str, selectors: list | None = None) -> StreamingQuery:
    """Streams parquet files of pages from a folder until none is left. Batches repeated after a failure add nothing twice."""
    stream = spark.readStream.schema(PAGES).parquet(source)
    sink = stream.writeStream.foreachBatch(lambda rows, batch: append_new(rows, output, errors, artist, selectors, batch))
    return sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
