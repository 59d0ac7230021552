"""Ordered logic: ordinals, revisions, gaps, running ids and greedy choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_ordinal(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ordinal and group_size within equal keys."""
    w = Window.partitionBy(*keys)
    return df.withColumns({"ordinal": F.row_number().over(w.orderBy(*order)), "group_size": F.count("*").over(w)})


def revisions(df: DataFrame, entity: str, order: list[str], value: str) -> DataFrame:
    """Adds retracted (the value before was set and this is not) and revised (this differs from the last one set)."""
    w = Window.partitionBy(entity).orderBy(*order)
    before, last = F.lag(value).over(w), F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    now = F.col(value)
    return df.withColumns({"retracted": before.isNotNull() & now.isNull(), "revised": now.isNotNull() & last.isNotNull() & (now != last)})


def missing_numbers(df: DataFrame, entity: str, number: str) -> DataFrame:
    """Numbers between the least and the greatest of each entity that it lacks, with the nearest that it has, the
    smaller of two. A gap lies between a number and the next: no entity's numbers are ever one array."""
    w = Window.partitionBy(entity).orderBy(number)
    gaps = df.select(entity, number).distinct().withColumn("next", F.lead(number).over(w)).filter(F.col("next") > F.col(number) + 1)
    rows = gaps.select(entity, F.col(number).alias("before"), "next", F.explode(F.sequence(F.col(number) + 1, F.col("next") - 1)).alias(number))
    return rows.select(entity, number, F.when(F.col(number) - F.col("before") <= F.col("next") - F.col(number), F.col("before")).otherwise(F.col("next")).alias("nearest"))


def greedy_exposures(days: Column, gap: float) -> Column:
    """From a sorted array: the first day, then each that is at least gap after the last one chosen."""
    start = F.array().cast("array<double>")
    return F.aggregate(days, start, lambda kept, d: F.when((F.size(kept) == 0) | (d - F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit(0.0)) >= gap), F.concat(kept, F.array(d))).otherwise(kept))


def segment_ids(lines: DataFrame, order: str, text: str, within: list[str]) -> DataFrame:
    """Adds segment, the number of delimiter lines ('>') up to here, in files read line by line."""
    w = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("segment", F.sum(F.when(F.col(text).startswith(">"), 1).otherwise(0)).over(w))


def serial_faults(df: DataFrame, within: list[str], serial: str) -> DataFrame:
    """Rows whose serial number is not their place 1, 2, 3... in order."""
    w = Window.partitionBy(*within).orderBy(serial)
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") != F.col(serial))


def regime_changes(blocks: DataFrame, order: str, mc: str, rate: str, mc_step: float, rate_factor: float, within: list[str] = ()) -> DataFrame:
    """Adds mc_change and rate_ratio against the block before, and changed where either passes its limit."""
    w = Window.partitionBy(*within).orderBy(order) if within else Window.orderBy(order)
    step, ratio = F.col(mc) - F.lag(mc).over(w), F.try_divide(F.col(rate), F.lag(rate).over(w))
    return blocks.withColumns({"mc_change": step, "rate_ratio": ratio}).withColumn("changed", F.coalesce((F.abs("mc_change") >= mc_step) | (F.col("rate_ratio") >= rate_factor) | (F.col("rate_ratio") <= 1 / rate_factor), F.lit(False)))


def ranked(df: DataFrame, within: list[str], order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each group."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).filter(F.col("place") <= most)
