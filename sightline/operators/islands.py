"""Runs of rows: sessions by gap, merged intervals, cumulative offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessionize(df: DataFrame, keys: list[str], order: list[str], time: str, gap: float, extra_break: Column | None = None, name: str = "island") -> DataFrame:
    """Numbers runs of rows whose time is less than gap (strictly) after the row before. extra_break: a condition over lag() columns that ends a run too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(time).over(w)
    new = before.isNull() | (F.col(time) - before >= gap)
    if extra_break is not None:
        new = new | extra_break
    return df.withColumn("_new", new.cast("int")).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def unlike(keys: list[str], order: list[str], persons: str, share: float = 0.7) -> Column:
    """Whether the set of persons shares too little with the row before: under share of the smaller set, or one is empty."""
    now, before = F.col(persons), F.lag(persons).over(Window.partitionBy(*keys).orderBy(*order))
    least = F.least(F.size(now), F.size(before))
    return F.coalesce((least <= 0) | (F.size(F.array_intersect(now, before)) < least * share), F.lit(False))


def merge_intervals(df: DataFrame, keys: list[str], order: list[str], start: str = "start_time", end: str = "end_time", slack: float = 1.0, name: str = "island") -> DataFrame:
    """Numbers groups of intervals that start no later than slack after all before have ended."""
    w = Window.partitionBy(*keys).orderBy(start, *order)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (reach.isNull() | (F.col(start) > reach + slack)).cast("int")
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def take_free(pairs: DataFrame, keys: list[str], order: list[Column], left: str, right: str) -> DataFrame:
    """One to one: pairs in order, each taken if neither side is taken yet. keys: columns of groups in which choices can depend
    on one another; with islands of overlapping intervals among them, groups stay small, however much one video holds.

    A group's pairs are folded in one expression: no Python, and no shuffle beyond that of the groups."""
    names = [c for c in pairs.columns if c not in keys]
    row = F.struct(*(c.alias(f"_{k}") for k, c in enumerate(order)), F.struct(*names).alias("_row"))
    rows = pairs.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["_row"]).alias("_rows"))
    none = F.slice("_rows", 1, 0)
    met = lambda taken, x: F.exists(taken, lambda t: (t[left] == x[left]) | (t[right] == x[right]))
    return rows.select(*keys, F.inline(F.aggregate("_rows", none, lambda taken, x: F.when(met(taken, x), taken).otherwise(F.concat(taken, F.array(x)))))).select(*pairs.columns)


def offsets(df: DataFrame, keys: list[str], order: str, length: Column, name: str = "offset") -> DataFrame:
    """The summed length of the rows before."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(length).over(w), F.lit(0.0)))
