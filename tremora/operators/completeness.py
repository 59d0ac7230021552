"""Magnitude of completeness: maximum curvature, b-value, temporal blocks and spatial strata with sparse parents."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremora.functions.kernels import CANDIDATES, candidate_magnitude, magnitude_bin

CORRECTION, HALF_BIN = 0.2, 0.05


def histogram(events: DataFrame, by: list[str] = ()) -> DataFrame:
    return events.groupBy(*by, magnitude_bin(F.col("magnitude")).cast("double").alias("bin")).agg(F.count("*").alias("n"))


def max_curvature(events: DataFrame, by: list[str] = ()) -> DataFrame:
    """peak, peak_n, n, estimate and candidate: the fullest bin, ties to the higher, plus the correction."""
    h = histogram(events, by)
    out = h.groupBy(*by).agg(F.max(F.struct("n", "bin")).alias("top"), F.sum("n").alias("n"))
    estimate = F.round(F.col("top.bin") + CORRECTION, 1)
    return out.select(*by, F.col("top.bin").alias("peak"), F.col("top.n").alias("peak_n"), "n", estimate.alias("estimate"), candidate_magnitude(estimate).alias("candidate"))


def aki_b(mean: Column, mc) -> Column:
    return F.try_divide(F.lit(math.log10(math.e)), mean - (mc - HALF_BIN))


def b_values(events: DataFrame, thresholds: tuple[float, ...] = CANDIDATES, by: list[str] = ()) -> DataFrame:
    """Count and b at or above each threshold, in one scan: every event goes to the thresholds it reaches."""
    rows = events.withColumn("mc", F.explode(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: F.col("magnitude") >= t - 1e-12)))
    return rows.groupBy(*by, "mc").agg(F.count("*").alias("n"), F.avg("magnitude").alias("mean")).select(*by, "mc", "n", aki_b(F.col("mean"), F.col("mc")).alias("b"))


def stratum_estimates(events: DataFrame, by: list[str]) -> DataFrame:
    """max_curvature with the number and b-value of complete events. The strata meet the events on their own key."""
    estimates = max_curvature(events, by)
    joined = events.join(estimates.select(*by, "candidate"), by) if by else events.crossJoin(F.broadcast(estimates.select("candidate")))
    complete = joined.filter("magnitude >= candidate - 1e-12").groupBy(*by).agg(F.count("*").alias("n_complete"), F.avg("magnitude").alias("mean"), F.first("candidate").alias("mc"))
    complete = complete.select(*by, "n_complete", aki_b(F.col("mean"), F.col("mc")).alias("b"))
    return estimates.join(complete, by, "left") if by else estimates.crossJoin(F.broadcast(complete))


def temporal_blocks(events: DataFrame, start: float, end: float, width: float, least_n: int, least_span: float) -> DataFrame:
    """stratum_estimates of blocks of ``width`` days, the last one closed and maybe shorter, with eligible."""
    last = math.ceil((end - start) / width) - 1
    block = F.least(F.floor((F.col("origin_day") - start) / width), F.lit(last)).cast("int")
    rows = events.filter((F.col("origin_day") >= start) & (F.col("origin_day") <= end)).withColumn("block", block)
    out = stratum_estimates(rows, ["block"])
    span = F.least(F.lit(end), F.lit(start) + (F.col("block") + 1) * width) - (F.lit(start) + F.col("block") * width)
    return out.withColumn("days", span).withColumn("eligible", (F.col("n") >= least_n) & (F.col("days") >= least_span)).withColumn("rate", F.col("n") / F.col("days"))


def spatial_strata(events: DataFrame, cell_km: float, least_n: int) -> DataFrame:
    """Cells, and for sparse ones their parent of twice the side, which counts all events in it. level tells which."""
    cell = lambda size: {"cx": F.floor(F.col("x_km") / size).cast("int"), "cy": F.floor(F.col("y_km") / size).cast("int")}
    fine = max_curvature(events.withColumns(cell(cell_km)), ["cx", "cy"])
    coarse = max_curvature(events.withColumns(cell(2 * cell_km)), ["cx", "cy"])
    sparse = fine.filter(F.col("n") < least_n).select(F.floor(F.col("cx") / 2).cast("int").alias("cx"), F.floor(F.col("cy") / 2).cast("int").alias("cy")).distinct()
    kept = fine.filter(F.col("n") >= least_n).withColumn("level", F.lit("cell"))
    return kept.unionByName(coarse.join(sparse, ["cx", "cy"]).withColumn("level", F.lit("parent")))


def sparse_parents(events: DataFrame, cell_km: float, least_n: int) -> DataFrame:
    """Each sparse cell with its parent and the parent's own count."""
    cell = lambda size, x, y: {x: F.floor(F.col("x_km") / size).cast("int"), y: F.floor(F.col("y_km") / size).cast("int")}
    fine = events.withColumns(cell(cell_km, "cx", "cy")).groupBy("cx", "cy").agg(F.count("*").alias("n"))
    parents = events.withColumns(cell(2 * cell_km, "px", "py")).groupBy("px", "py").agg(F.count("*").alias("parent_n"))
    sparse = fine.filter(F.col("n") < least_n).withColumns({"px": F.floor(F.col("cx") / 2).cast("int"), "py": F.floor(F.col("cy") / 2).cast("int")})
    return sparse.join(parents, ["px", "py"])


def gate(strata: DataFrame, most: float = CANDIDATES[-1]) -> DataFrame:
    """One row: the greatest estimate, the candidate at or above it, and status. A catalogue that is not complete
    enough is a result, not an error."""
    out = strata.agg(F.max("estimate").alias("greatest"), F.count("*").alias("strata"))
    status = F.when(F.col("greatest").isNull(), "no_eligible_stratum").when(F.col("greatest") > most, "completeness_above_limit").otherwise("ok")
    return out.select("greatest", "strata", candidate_magnitude(F.col("greatest")).alias("mc"), status.alias("status"))
