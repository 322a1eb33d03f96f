"""Running sums over a whole table in an order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import save


def running_sums(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with, under each name of sums, the sum of its column over all rows before in the order (0 for the first).

    Rows are dealt by ranges of the order and written, as the pass after next has to meet the same ranges. Each range's total
    is a row, and what lies before a range is summed up over these few rows; the rest is a window within each range."""
    dealt = save(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_range").agg(*(F.sum(c).alias(f"_{k}") for k, c in sums.items()))
    w = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    before = totals.select("_range", *(F.coalesce(F.sum(f"_{k}").over(w), F.lit(0)).alias(f"_{k}") for k in sums))
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(F.broadcast(before), "_range")
    return placed.withColumns({k: F.col(f"_{k}") + F.coalesce(F.sum(c).over(own), F.lit(0)) for k, c in sums.items()}).drop("_range", *(f"_{k}" for k in sums))
