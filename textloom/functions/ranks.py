"""Running totals over one global order, in two levels: sums of hash buckets, then a window inside each bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Leading hex digits of the order key that name a bucket: 4096 buckets, which bounds the table of sums.
DIGITS = 3


def running_total(rows: DataFrame, key: Column, value: Column, name: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """rows with `name`: the total of value up to and including each row, in order of the hexadecimal hash `key`, then of ties.

    The rows' own columns stay as they are, whatever their names. Nulls in ties come first.
    """
    marked = rows.select(F.struct("*").alias("row"), key.alias("key"), value.alias("value"), F.substring(key, 1, DIGITS).alias("bucket"))
    sums = marked.groupBy("bucket").agg(F.sum("value").alias("sum"))
    before = sums.select("bucket", (F.sum("sum").over(Window.orderBy("bucket")) - F.col("sum")).alias("before"))
    inside = F.sum("value").over(Window.partitionBy("bucket").orderBy("key", *[F.col(f"row.`{t}`") for t in ties]).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = marked.withColumn("inside", inside).join(F.broadcast(before), "bucket")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in rows.columns if c != name], (F.col("before") + F.col("inside")).alias(name))


def first_keys(rows: DataFrame, key: Column, share: float, ties: tuple[str, ...] = ()) -> Column:
    """Whether a row is among the first max(1, floor(share * n)) by `key`, then ties; rows equal in both go together.

    One pass counts buckets, a second one ranks the bucket that holds the boundary; the rows themselves are compared with
    the boundary where they are, and not shuffled.
    """
    bucket = F.substring(key, 1, DIGITS)
    sums = sorted((r["b"], r["n"]) for r in rows.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect())
    left = max(1, int(sum(n for _, n in sums) * share))
    for b, n in sums:
        if left <= n:
            break
        left -= n
    else:
        return F.lit(False)
    own = F.struct(key.alias("key"), *ties)
    last = rows.filter(bucket == b).select(own.alias("own")).orderBy("own").offset(left - 1).limit(1).head()["own"]
    schema = rows.select(own.alias("own")).schema["own"].dataType
    return own <= F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(last, schema, strict=True)])


def previous_key(rows: DataFrame, group: str, key: str, width: int = 1 << 16) -> DataFrame:
    """group, key, previous: the next lower key of the group for each of its integer keys, null for its first.

    Keys are cut into ranges of `width`, so that a group of any size is spread over many windows; a range's first key takes
    the highest key of the ranges before it, found on one row per range.
    """
    narrow = rows.select(F.col(group).alias("group"), F.col(key).alias("key")).filter(F.col("key").isNotNull()).withColumn("range", F.floor(F.col("key") / width))
    lag = F.lag("key").over(Window.partitionBy("group", "range").orderBy("key"))
    tops = narrow.groupBy("group", "range").agg(F.max("key").alias("top"))
    before = F.max("top").over(Window.partitionBy("group").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.select(F.col("group").alias("g"), F.col("range").alias("r"), before.alias("before"))
    placed = narrow.withColumn("lag", lag).join(tops, F.col("group").eqNullSafe(F.col("g")) & (F.col("range") == F.col("r")))
    return placed.select(F.col("group").alias(group), F.col("key").alias(key), F.coalesce("lag", "before").alias("previous"))
