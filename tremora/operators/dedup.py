"""Duplicate events of two sources: candidates by a band join, merging only where the match is mutual and alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremora.operators.joins import band_join, band_place_join, mutual_degree_one

DAY = 86400.0


def planar(l: str = "l_", r: str = "r_") -> Column:  # noqa: E741
    return F.sqrt((F.col(f"{l}x_km") - F.col(f"{r}x_km")) ** 2 + (F.col(f"{l}y_km") - F.col(f"{r}y_km")) ** 2)


def candidates(left: DataFrame, right: DataFrame, review=(3600.0, 50.0, 0.5), auto=(600.0, 20.0, 0.1), distance: Column | None = None) -> DataFrame:
    """l_event_id, r_event_id, seconds, km, dm and auto of every pair within the review limits. By planar distance the
    sides meet by time, place and magnitude; by another distance, by time alone."""
    km = planar() if distance is None else distance
    dm = F.abs(F.col("l_magnitude") - F.col("r_magnitude"))
    limits = (km <= review[1]) & (F.round(dm, 6) <= review[2])
    pairs = band_place_join(left, right, review[0] / DAY, review[1], review[2], limits) if distance is None else band_join(left, right, "origin_day", review[0] / DAY, limits)
    seconds = F.round(F.abs(F.col("l_origin_day") - F.col("r_origin_day")) * DAY, 3)
    out = pairs.select("l_event_id", "r_event_id", seconds.alias("seconds"), km.alias("km"), F.round(dm, 6).alias("dm"))
    return out.withColumn("auto", (F.col("seconds") <= auto[0]) & (F.col("km") <= auto[1]) & (F.col("dm") <= auto[2]))


def accepted(pairs: DataFrame) -> DataFrame:
    """Automatic pairs that are the only ones of both events: merging is never transitive."""
    return mutual_degree_one(pairs.filter("auto"), "l_event_id", "r_event_id")


def classified(pairs: DataFrame) -> DataFrame:
    """status of each pair: merged, ambiguous (automatic, but not alone) or review. Degrees among the automatic pairs
    tell, without a second look at the pairs."""
    degree = lambda c: F.count_if("auto").over(Window.partitionBy(c))
    alone = (degree("l_event_id") == 1) & (degree("r_event_id") == 1)
    out = pairs.withColumn("alone", alone)
    return out.withColumn("status", F.when(F.col("auto") & F.col("alone"), "merged").when(F.col("auto"), "ambiguous").otherwise("review")).drop("alone")


def event_status(left: DataFrame, pairs: DataFrame) -> DataFrame:
    """status of each left event, the first that holds: merged, ambiguous, review, exact_duplicate (its own source holds
    an event of the same time, place and magnitude with a smaller id), unmatched."""
    rank = F.when(F.col("status") == "merged", 1).when(F.col("status") == "ambiguous", 2).otherwise(3)
    best = classified(pairs).groupBy(F.col("l_event_id").alias("event_id")).agg(F.min(rank).alias("rank"))
    same = Window.partitionBy("origin_day", "x_km", "y_km", "magnitude").orderBy("event_id")
    marked = left.withColumn("copy", F.row_number().over(same) > 1)
    status = F.when(F.col("rank") == 1, "merged").when(F.col("rank") == 2, "ambiguous").when(F.col("rank") == 3, "review").when(F.col("copy"), "exact_duplicate").otherwise("unmatched")
    return marked.join(best, "event_id", "left").withColumn("status", status).drop("rank", "copy")


def events(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """Physical events: each merged pair once, by the right source's values and with the flags of both, and all events
    without a merge."""
    kept = accepted(pairs).select(F.col("l_event_id").alias("l"), F.col("r_event_id").alias("event_id"))
    right_rows = right.join(kept, "event_id", "left").withColumn("sources", F.when(F.col("l").isNull(), F.array(F.lit("m5"))).otherwise(F.array(F.lit("m3"), F.lit("m5")))).drop("l")
    left_rows = left.join(kept.select(F.col("l").alias("event_id")), "event_id", "left_anti").withColumn("sources", F.array(F.lit("m3")))
    out = right_rows.unionByName(left_rows)
    if "flags" not in left.columns:
        return out
    given = left.select(F.col("event_id").alias("l"), F.col("flags").alias("more")).join(kept, "l").select("event_id", "more")
    return out.join(given, "event_id", "left").withColumn("flags", F.array_sort(F.array_union("flags", F.coalesce("more", F.array().cast("array<string>"))))).drop("more")
