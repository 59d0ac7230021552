"""Scores against the uniform model, gates and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def information_gain(candidate: Column, uniform: Column, n: Column) -> Column:
    """Log-likelihood gain an event; null without events."""
    return F.try_divide(candidate - uniform, n)


def paired_gain(candidate: DataFrame, uniform: DataFrame, by: list[str]) -> DataFrame:
    """Gain from per-event log intensities of two models over the same events: columns event_id, log_intensity and,
    for each group, a compensator. Events that one side lacks are counted in ``unpaired``."""
    c = candidate.select(*by, "event_id", F.col("log_intensity").alias("c"), F.col("compensator").alias("cc"))
    u = uniform.select(*by, "event_id", F.col("log_intensity").alias("u"), F.col("compensator").alias("uc"))
    both = c.join(u, [*by, "event_id"], "full")
    out = both.groupBy(*by).agg(F.sum(F.col("c") - F.col("u")).alias("d"), (F.max("cc") - F.max("uc")).alias("dc"), F.count_if(F.col("c").isNotNull() & F.col("u").isNotNull()).alias("n"), F.count_if(F.col("c").isNull() | F.col("u").isNull()).alias("unpaired"))
    return out.select(*by, "n", "unpaired", F.try_divide(F.col("d") - F.col("dc"), F.col("n")).alias("gain"))


def g1(folds: DataFrame, validation: DataFrame, least_positive: int = 3) -> DataFrame:
    """From (model, fold, gain) and (model, gain, stable): passed where one model alone meets every demand."""
    positive = folds.groupBy("model").agg(F.count_if(F.col("gain") > 0).alias("positive_folds"))
    out = validation.join(positive, "model", "left").withColumn("positive_folds", F.coalesce("positive_folds", F.lit(0)))
    return out.withColumn("passed", (F.col("gain") > 0) & (F.col("positive_folds") >= least_positive) & F.col("stable"))


def select_model(folds: DataFrame, validation: DataFrame) -> DataFrame:
    """One standard error rule. validation: model, complexity, gain, stable. The best is the highest gain, ties to the
    more complex; chosen is the simplest stable model within one paired standard error of it."""
    pool = validation.filter("stable")
    best = pool.agg(F.max(F.struct("gain", "complexity", "model")).alias("b")).select(F.col("b.model").alias("best"), F.col("b.gain").alias("best_gain"))
    reference = folds.join(F.broadcast(best), folds["model"] == best["best"]).select("fold", F.col("gain").alias("best_fold"))
    paired = folds.join(F.broadcast(reference), "fold").groupBy("model").agg((F.coalesce(F.stddev_samp(F.col("gain") - F.col("best_fold")), F.lit(0.0)) / F.sqrt(F.count("*"))).alias("se"))
    out = pool.join(paired, "model").crossJoin(F.broadcast(best)).withColumn("eligible", F.col("gain") >= F.col("best_gain") - F.col("se"))
    chosen = out.filter("eligible").agg(F.min_by("model", "complexity").alias("chosen"))
    return out.crossJoin(F.broadcast(chosen)).select("model", "gain", "se", "eligible", (F.col("model") == F.col("best")).alias("best"), (F.col("model") == F.col("chosen")).alias("chosen"))


def repeated_events(exposures: DataFrame, by: list[str]) -> DataFrame:
    """Events that lie in more than one exposure of a group: none may."""
    return exposures.groupBy(*by, "event_id").agg(F.count("*").alias("n")).filter("n > 1")


def horizon_counts(catalog: DataFrame, exposures: DataFrame, horizons: tuple[float, ...], least: float) -> DataFrame:
    """Targets in (T, T + h] of every issue day and horizon, zeros kept. exposures: horizon, issue_day."""
    longest = max(horizons)
    marked = catalog.filter(F.col("inside_study_area") & (F.col("magnitude") >= least)).withColumn("bucket", F.floor(F.col("origin_day") / longest))
    wide = exposures.withColumn("bucket", F.explode(F.array(F.floor(F.col("issue_day") / longest), F.floor(F.col("issue_day") / longest) + 1)))
    hits = wide.join(marked, "bucket").filter("origin_day > issue_day and origin_day <= issue_day + horizon").groupBy("horizon", "issue_day").agg(F.count("*").alias("n"))
    return exposures.join(hits, ["horizon", "issue_day"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
