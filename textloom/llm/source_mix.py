"""Weighted fair queueing of sources: each shuffled document gets a virtual finish time, its source's cumulative size over
the source's weight; the words of all queues are served in the order of their finish times until the total budget is spent.

A source's queue repeats up to `max_epochs` times. Words are the packets of the schedule, so that each source is served
within a word of its share however long a document is. Finish times are whole numbers (in units of one over the least
common multiple of the weights). Truncation: every queued copy adds its words to range buckets of finish time, and the
bucket in which their sum reaches the budget is split again, until it is one instant; words of that instant are served in
the order of sources. A queue that runs dry leaves its share to the others; `target` is what the fluid schedule would
serve, a closed form on one row per source, against which the served words are held in tests.

Cumulative sizes are taken in two levels (the sums of 4096 shuffle buckets per source, then a running sum inside one
bucket), so that a source with a third of all rows is spread over thousands of window groups. Only ids and sizes are
shuffled, never texts.

Defined results: null or empty texts have size 0 and are taken 0 words; null sources are one source, last in order; ties
in the shuffle key (repeated rows) follow doc_id, then size; an empty table gives an empty mix; further columns are kept
out of the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.tables import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the shuffle key that name a bucket: 16**3 buckets.
BUCKET_DIGITS = 3
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Range buckets of finish times at each level of the truncation.
RANGES = 4096


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, size) rows -> source, place, source_size, weight, target: one row per source.

    Sources in order of their dryness level max_epochs * size / weight; the level of the queue is that of the first
    source which does not run dry. The windows see one row per distinct source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    names = F.array(*[F.lit(w) for w in weights])
    per = per.withColumn("place", F.row_number().over(by_name))
    per = per.withColumn("weight", F.element_at(names, ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("long"))
    cap = F.lit(max_epochs) * F.col("source_size")
    dry = Window.orderBy((cap / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    per = per.withColumns({"cap": cap, "budget": F.sum("source_size").over(every), "all_weight": F.sum("weight").over(every)})
    per = per.withColumns({"left": F.col("budget") - F.coalesce(F.sum("cap").over(dry), F.lit(0)), "left_weight": F.col("all_weight") - F.coalesce(F.sum("weight").over(dry), F.lit(0))})
    level = F.col("left").cast("double") / F.col("left_weight").cast("double")
    per = per.withColumn("level", F.when(F.col("cap") >= F.col("weight") * level, level))
    # The first source that does not run dry has the highest of the levels that hold.
    per = per.withColumn("level", F.max("level").over(every))
    return per.select("source", "place", "source_size", "weight", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"))


def service(placed: DataFrame, targets: DataFrame, unit: int, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Words that each queue gets when the words of all queues, in order of finish time, are cut at the total budget: queue, served.

    Word i of a queue (from 1, through all epochs) finishes at i * unit / weight. Collected are sums of RANGES buckets.
    """
    sizes = targets.agg(F.sum("source_size").alias("budget"), F.max(F.col("source_size") * F.lit(max_epochs * unit) / F.col("weight")).alias("last")).head()
    left, low, width = sizes["budget"] or 0, 0, int(sizes["last"] or 0)
    step = F.expr(f"{unit} div weight")
    epochs = F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1)))
    copies = placed.filter("size > 0").select("size", "end", "source_size", "weight", epochs.alias("epoch"))
    copies = copies.select((F.col("end") - F.col("size") + F.col("epoch") * F.col("source_size")).alias("a"), (F.col("end") + F.col("epoch") * F.col("source_size")).alias("z"), step.alias("step"))
    while width > 1:
        # The instants low + 1 to low + width hold the cut; a bucket has `fine` of them.
        fine = -(-width // RANGES)
        rows = copies.filter((F.col("z") * F.col("step") > low) & ((F.col("a") + 1) * F.col("step") <= low + width))
        first = F.expr(f"(greatest((a + 1) * step, {low + 1}L) - {low + 1}L) div {fine}L")
        final = F.expr(f"(least(z * step, {low + width}L) - {low + 1}L) div {fine}L")
        rows = rows.withColumn("b", F.explode(F.sequence(first, final)))
        words = F.expr(f"least(z, least({low}L + (b + 1) * {fine}L, {low + width}L) div step) - greatest(a, ({low}L + b * {fine}L) div step)")
        sums = rows.groupBy("b").agg(F.sum(words).alias("words")).orderBy("b").collect()
        for row in sums:
            if left <= row["words"]:
                low, width = low + row["b"] * fine, min(fine, width - row["b"] * fine)
                break
            left -= row["words"]
    served = targets.withColumn("before", F.least(F.expr(f"{low}L div ({unit} div weight)"), max_epochs * F.col("source_size")))
    due = ((F.col("before") + 1) * step == low + 1) & (F.col("before") < max_epochs * F.col("source_size"))
    rank = F.sum(F.when(due, 1).otherwise(0)).over(Window.orderBy("place"))
    return served.select("queue", (F.col("before") + F.when(due & (rank <= left), 1).otherwise(0)).alias("served"))


def weighted_fair_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, boundary: str = "cut", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, doc_id, source, text -> keys, source, size, source_size, target, taken, finish, copies.

    keys name a row in the result; doc_id seeds the shuffle. taken: words served over all epochs. finish: virtual finish
    time of the document in the first epoch. copies: whole copies served; boundary "cut" counts the last copy's words up
    to the cut in taken, boundary "whole" serves the last copy whole if at least half of it is served, else not at all.
    """
    if boundary not in ("cut", "whole"):
        raise ValueError(f"boundary: {boundary}")
    sized = docs.select(*[F.col(k).alias(f"key_{k}") for k in keys], "doc_id", "source", word_count(F.col("text")).alias("size"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    queued = sized.withColumn("key", key).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    # The source's name may be null: a marked copy of it is a key that joins.
    queued = queued.withColumn("queue", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    sums = queued.groupBy("queue", "source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(sums.select("source", F.col("bucket_size").alias("size")), weights, max_epochs)
    targets = targets.withColumn("queue", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).drop("source")
    earlier = Window.partitionBy("queue").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("before", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0))).select("queue", "bucket", "before").join(targets, "queue")
    inside = Window.partitionBy("queue", "bucket").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = queued.withColumn("upto", F.sum("size").over(inside)).join(offsets, ["queue", "bucket"]).withColumn("end", F.col("before") + F.col("upto"))
    names = [f"key_{k}" for k in keys]
    placed = materialize(docs.sparkSession, placed.select(*names, "source", "queue", "place", "size", "end", "source_size", "weight", "target"), "mix")
    per_queue = placed.select("queue", "place", "source_size", "weight").distinct()
    placed = placed.join(service(placed, per_queue, math.lcm(*weights), max_epochs), "queue", "left")
    taken, copies = F.lit(0).cast("long"), F.lit(0)
    for epoch in range(max_epochs):
        start = F.col("end") - F.col("size") + epoch * F.col("source_size")
        served = F.greatest(F.lit(0), F.least(F.col("size"), F.coalesce("served", F.lit(0)) - start))
        if boundary == "whole":
            served = F.when((F.col("size") > 0) & (2 * served >= F.col("size")), F.col("size")).otherwise(F.lit(0))
        taken = taken + served
        copies = copies + F.when((F.col("size") > 0) & (served == F.col("size")), 1).otherwise(0)
    return placed.select(*[F.col(f"key_{k}").alias(k) for k in keys], "source", "size", "source_size", "target", taken.cast("long").alias("taken"), (F.col("end") / F.col("weight")).alias("finish"), copies.alias("copies"), "weight")


def served_order(mix: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The served copies, one row each with its epoch and its own finish time, range-sorted over the cluster by that time."""
    rows = mix.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    words = F.greatest(F.lit(0), F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size")))
    rows = rows.withColumn("words", words).withColumn("finish", F.col("finish") + F.col("epoch") * F.col("source_size") / F.col("weight"))
    return rows.filter("words > 0").orderBy("finish", "doc_id")


def op4_weighted_fair_mix(docs: DataFrame) -> DataFrame:
    """Contract columns, with source and finish; one row per row of documents, in the order of service."""
    mix = weighted_fair_mix(docs)
    return mix.select("doc_id", "size", "source_size", "target", "taken", "source", F.round("finish", 6).alias("finish")).orderBy("finish", "doc_id")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS place FROM s),
n AS (SELECT *, (place - 1) % 3 + 1 AS weight FROM r),
o AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS budget, sum(weight) OVER () AS all_weight,
             coalesce(sum(3 * source_size) OVER dry, 0) AS gone, coalesce(sum(weight) OVER dry, 0) AS gone_weight
      FROM n WINDOW dry AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, CAST(budget - gone AS DOUBLE) / CAST(all_weight - gone_weight AS DOUBLE) AS own FROM o),
v AS (SELECT *, max(CASE WHEN cap >= weight * own THEN own END) OVER () AS level FROM l),
t AS (SELECT source, place, source_size, weight, least(CAST(cap AS DOUBLE), weight * level) AS target FROM v),
w AS (SELECT place, unnest(range(1, 3 * source_size + 1)) * (6 // weight) AS finish FROM t),
k AS (SELECT place, row_number() OVER (ORDER BY finish, place) AS n FROM w),
g AS (SELECT place, count(*) AS served FROM k WHERE n <= (SELECT sum(size) FROM d) GROUP BY place),
c AS (SELECT d.*, source_size, weight, target, coalesce(served, 0) AS served, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN g USING (place))
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, served - (upto - size))) + greatest(0, least(size, served - (upto - size) - source_size))
            + greatest(0, least(size, served - (upto - size) - 2 * source_size)) AS BIGINT) AS taken,
       source, round(CAST(upto AS DOUBLE) / weight, 6) AS finish FROM c
"""
