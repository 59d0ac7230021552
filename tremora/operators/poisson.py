"""Uniform and kernel-density Poisson models: one distance serves all bandwidths, supports are infinite."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BANDWIDTHS = (75.0, 100.0, 150.0, 200.0, 300.0)


def gaussian(r2: Column, h: float) -> Column:
    return F.exp(-r2 / (2 * h * h)) / (2 * math.pi * h * h)


def uniform_score(n: Column, rate: Column, area: float, days: float) -> Column:
    """Sum of log intensities less the compensator; a period without events keeps the latter."""
    return n * F.log(rate / area) - rate * days


def kde_cell_masses(training: DataFrame, cells: Column, bandwidths: tuple[float, ...] = BANDWIDTHS) -> DataFrame:
    """h, row, column and mass of each cell, normalised over the study area once for each bandwidth. Every training
    event meets the fixed cells of the grid in an array literal; sums are made on the map side. Without training events
    raw and mass are null on every cell: such a model has no density."""
    spark = training.sparkSession
    rows = training.select("x_km", "y_km", F.explode(cells).alias("c"))
    r2 = (F.col("x_km") - F.col("c.cx")) ** 2 + (F.col("y_km") - F.col("c.cy")) ** 2
    sums = rows.groupBy("c").agg(*[F.sum(gaussian(r2, h)).alias(f"h{int(h)}") for h in bandwidths], F.count("*").alias("n"))
    whole = spark.range(1).select(F.explode(cells).alias("c")).join(sums, "c", "left")
    long = whole.select("c", F.explode(F.array(*[F.struct(F.lit(h).alias("h"), (F.col(f"h{int(h)}") / F.col("n") * F.col("c.area_km2")).alias("raw")) for h in bandwidths])).alias("x"))
    masses = long.select(F.col("x.h").alias("h"), F.col("c.row").alias("row"), F.col("c.column").alias("column"), F.col("x.raw").alias("raw"))
    totals = masses.groupBy("h").agg(F.sum("raw").alias("normaliser"))  # one row a bandwidth
    return masses.join(F.broadcast(totals), "h").withColumn("mass", F.col("raw") / F.col("normaliser"))


def met_in_blocks(queries: DataFrame, points: DataFrame, blocks: int) -> DataFrame:
    """Every query (event_id, x_km, y_km) with every point (tx, ty), in blocks: both sides are dealt by hash and a task
    holds one block of each."""
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))
    q = queries.withColumn("qb", F.pmod(F.xxhash64("event_id"), F.lit(blocks))).withColumn("tb", every)
    t = points.withColumn("tb", F.pmod(F.xxhash64("tx", "ty", "key"), F.lit(blocks))).drop("key").withColumn("qb", every)
    return q.join(t, ["qb", "tb"]).withColumn("r2", (F.col("x_km") - F.col("tx")) ** 2 + (F.col("y_km") - F.col("ty")) ** 2)


def kde_log_densities(queries: DataFrame, training: DataFrame, normalisers: DataFrame, bandwidths: tuple[float, ...] = BANDWIDTHS, block_rows: int = 2_000) -> DataFrame:
    """event_id, h and log_density at each query point: the support is infinite, so every query meets every training
    point. The number of blocks follows the training points, block_rows to each.

    Exponents are shifted by the squared distance to the nearest occupied square (of the least bandwidth's side), so a
    query far from all training points keeps a finite density. Without training points there is no row."""
    blocks = max(1, -(-training.count() // block_rows))
    side = min(bandwidths)
    middle = lambda c: (F.floor(F.col(c) / side) + 0.5) * side
    occupied = training.select(middle("x_km").alias("tx"), middle("y_km").alias("ty")).distinct().withColumn("key", F.lit(0))
    places = queries.select("event_id", "x_km", "y_km")
    shifts = met_in_blocks(places, occupied, blocks).groupBy("event_id").agg(F.min("r2").alias("shift"))
    points = training.select(F.col("x_km").alias("tx"), F.col("y_km").alias("ty"), F.col("event_id").alias("key"))
    met = met_in_blocks(places.join(shifts, "event_id"), points, blocks)
    sums = met.groupBy("event_id").agg(*[F.sum(F.exp((F.col("shift") - F.col("r2")) / (2 * h * h))).alias(f"h{int(h)}") for h in bandwidths], F.count("*").alias("n"), F.first("shift").alias("shift"))
    log = lambda h: F.log(F.col(f"h{int(h)}")) - F.col("shift") / (2 * h * h) - F.log(F.col("n") * (2 * math.pi * h * h))
    long = sums.select("event_id", F.explode(F.array(*[F.struct(F.lit(h).alias("h"), log(h).alias("raw")) for h in bandwidths])).alias("x")).select("event_id", "x.*")
    return long.join(F.broadcast(normalisers), "h").select("event_id", "h", (F.col("raw") - F.log("normaliser")).alias("log_density"))


def scores(log_densities: DataFrame, exposures: DataFrame, by: list[str]) -> DataFrame:
    """n and log_likelihood of each exposure (by, rate, days, mass): sum of log(rate) + log density less the compensator
    rate * days * mass; an exposure without events keeps the latter."""
    sums = log_densities.groupBy(*by).agg(F.count("*").alias("n"), F.sum("log_density").alias("sum"))
    out = exposures.join(sums, by, "left").withColumns({"n": F.coalesce("n", F.lit(0)), "sum": F.coalesce("sum", F.lit(0.0))})
    logs = F.when(F.col("n") > 0, F.col("sum") + F.col("n") * F.log("rate")).otherwise(0.0)
    return out.withColumn("log_likelihood", logs - F.col("rate") * F.col("days") * F.col("mass")).drop("sum")


def select_bandwidth(fold_scores: DataFrame) -> DataFrame:
    """From (h, fold, score): mean, paired standard error against the best, eligible and selected. Best ties and the
    selection go to the larger bandwidth. Windows over the few (h, fold) rows: the scores are computed once."""
    whole, by_h, by_fold = Window.partitionBy(F.lit(0)), Window.partitionBy("h"), Window.partitionBy("fold")
    rows = fold_scores.withColumn("mean", F.avg("score").over(by_h)).withColumn("best", F.max(F.struct("mean", "h")).over(whole))
    rows = rows.withColumn("gap", F.col("score") - F.max(F.when(F.col("h") == F.col("best.h"), F.col("score"))).over(by_fold))
    paired = rows.groupBy("h").agg(F.first("mean").alias("mean"), (F.coalesce(F.stddev_samp("gap"), F.lit(0.0)) / F.sqrt(F.count("gap"))).alias("se"), F.first("best.mean").alias("best_mean"))
    out = paired.withColumn("eligible", F.col("mean") >= F.col("best_mean") - F.col("se"))
    chosen = F.max(F.when(F.col("eligible"), F.col("h"))).over(whole)
    return out.withColumn("chosen", chosen).select("h", "mean", "se", "eligible", (F.col("h") == F.col("chosen")).alias("selected"))
