"""Ordered scans over keys of any size.

A plain window puts all rows of one key into one task. Here every key is cut
into buckets along its order; rows are windowed per (key, bucket) and only one
summary row per bucket is scanned per key. ``bucket`` must not decrease along
``order``: a day for times, a division for sequence numbers. The join back uses
the same partitioning as the window, so the rows are shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"


def _with_carry(
    df: DataFrame, keys: Sequence[str], bucket: Column, summary: Column, carry: Column
) -> tuple[DataFrame, Window]:
    """``df`` with ``_carry``: ``carry`` scanned over earlier buckets' summaries."""
    bucketed = df.withColumn(BUCKET, bucket)
    per_bucket = bucketed.groupBy(*keys, BUCKET).agg(summary.alias("_summary"))
    earlier = (
        Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = per_bucket.select(*keys, BUCKET, carry.over(earlier).alias("_carry"))
    return bucketed.join(carried, [*keys, BUCKET]), Window.partitionBy(*keys, BUCKET)


def ranked(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, name: str = "rank"
) -> DataFrame:
    """1-based position of every row within its key."""
    joined, part = _with_carry(df, keys, bucket, F.count(F.lit(1)), F.sum("_summary"))
    local = F.row_number().over(part.orderBy(*order))
    return joined.withColumn(name, F.coalesce("_carry", F.lit(0)) + local).drop("_carry", BUCKET)


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, value: Column, name: str
) -> DataFrame:
    """Sum of ``value`` from the first row of the key through this one."""
    joined, part = _with_carry(df, keys, bucket, F.sum(value), F.sum("_summary"))
    upto = part.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.withColumn(
        name, F.coalesce("_carry", F.lit(0)) + F.coalesce(F.sum(value).over(upto), F.lit(0))
    ).drop("_carry", BUCKET)


def last_known(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, value: Column, name: str,
    include_current: bool = True,
) -> DataFrame:
    """Latest non-null ``value`` up to this row (or strictly before it)."""
    position = F.struct(*order)
    summary = F.max(F.when(value.isNotNull(), F.struct(position.alias("at"), value.alias("v"))))
    joined, part = _with_carry(df, keys, bucket, summary, F.last("_summary", ignorenulls=True))
    end = Window.currentRow if include_current else -1
    upto = part.orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    local = F.last(value, ignorenulls=True).over(upto)
    return joined.withColumn(name, F.coalesce(local, F.col("_carry.v"))).drop("_carry", BUCKET)


def previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, value: Column, name: str
) -> DataFrame:
    """``value`` of the row just before this one, NULL on the first row."""
    summary = F.max(F.struct(F.struct(*order).alias("at"), value.alias("v")))
    joined, part = _with_carry(df, keys, bucket, summary, F.last("_summary"))
    ordered = part.orderBy(*order)
    first = F.row_number().over(ordered) == 1
    return joined.withColumn(
        name, F.when(first, F.col("_carry.v")).otherwise(F.lag(value).over(ordered))
    ).drop("_carry", BUCKET)


def preceding(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, value: Column, rows: int,
    name: str, block: int = 4096,
) -> DataFrame:
    """Array of the previous ``rows`` values, oldest first.

    Rows are numbered, cut into blocks of ``block`` rows, and the last rows of
    a block are copied in front of the next one.
    """
    numbered = ranked(df, keys, order, bucket, "_n").withColumn("_value", value)
    own = F.floor((F.col("_n") - 1) / block)
    in_block = (F.col("_n") - 1) % block
    copies = F.when(in_block >= block - rows, F.array(own, own + 1)).otherwise(F.array(own))
    spread = numbered.withColumn("_own", own).withColumn("_block", F.explode(copies))
    window = Window.partitionBy(*keys, "_block").orderBy("_n").rowsBetween(-rows, -1)
    return (
        spread.withColumn(name, F.collect_list("_value").over(window))
        .filter(F.col("_own") == F.col("_block"))
        .drop("_n", "_value", "_own", "_block")
    )
