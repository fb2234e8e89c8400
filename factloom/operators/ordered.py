"""Ordered dedupe, rankings and numbering: order is part of the result, so it is always spelled out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored


def first_wins(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def top_n(df: DataFrame, keys: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows of each key (evidence lists keep ten, values thirty)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def numbered(df: DataFrame, prefix: str, order: list[Column | str]) -> DataFrame:
    """claim_id ``PREFIX-001`` … in order."""
    return numbered_within(df.withColumn("_prefix", F.lit(prefix)), "_prefix", order).drop("_prefix")


def numbered_within(df: DataFrame, prefix: str, order: list[Column | str]) -> DataFrame:
    """claim_id ``PREFIX-001`` … in order within each value of the column ``prefix``.

    One range sort for all of them, written so that every use sees the same parts, and per-part counts: no prefix passes
    through one task.
    """
    sorted_ = df.withColumn("_o", F.struct(*order)).repartitionByRange(prefix, "_o").withColumn("_p", F.spark_partition_id())
    placed = stored(sorted_, "ordered")
    inside = placed.withColumn("_i", F.row_number().over(Window.partitionBy("_p", prefix).orderBy("_o")))
    sizes = placed.groupBy("_p", prefix).count()
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("count").over(Window.partitionBy(prefix).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = inside.join(F.broadcast(sizes.select("_p", prefix, "_before")), ["_p", prefix])  # a row for each part and prefix
    number = (F.col("_before") + F.col("_i")).cast("string")
    return joined.withColumn("claim_id", F.concat(F.col(prefix), F.lit("-"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number))).drop("_o", "_p", "_i", "_before")
