"""Backtests by publication delay, horizon, issue and model: one relational plan, keyed by all of them.

Targets are the events of an exposure (T, T + h], whatever their availability. What a model may see depends on the
delay: an event counts as a parent from its own availability plus the delay on, pair by pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.functions import kernels
from tremora.operators import etas
from tremora.operators.etas import Parameters, Spec
from tremora.operators.joins import radius_join

EXPOSURE = ["horizon", "issue_day"]
KEY = ["delay", *EXPOSURE]


def targets(catalog: DataFrame, exposures: DataFrame, least: float) -> DataFrame:
    """exposures (horizon, issue_day) with the events they hold. Both sides meet on equal spans of the longest horizon."""
    longest = F.lit(max(r.horizon for r in exposures.select("horizon").distinct().collect()))  # a few horizons
    span = lambda c: F.floor(c / longest)
    marked = catalog.filter(F.col("inside_study_area") & (F.col("magnitude") >= least)).withColumn("span", span(F.col("origin_day")))
    wide = exposures.withColumn("span", F.explode(F.array(span(F.col("issue_day")), span(F.col("issue_day")) + 1)))
    return wide.join(marked, "span").filter("origin_day > issue_day and origin_day <= issue_day + horizon").drop("span")


def score_parents(catalog: DataFrame, exposures: DataFrame, least: float, lag: float) -> DataFrame:
    """exposures with the events that may act in them: origin in (T - lag, T + h], strictly after its start."""
    near = catalog.filter(F.col("inside_external_buffer") & (F.col("magnitude") >= least))
    reach = F.lit(lag + max(r.horizon for r in exposures.select("horizon").distinct().collect()))
    span = lambda c: F.floor(c / reach)
    wide = exposures.withColumn("span", F.explode(F.array(span(F.col("issue_day")) - 1, span(F.col("issue_day")), span(F.col("issue_day")) + 1)))
    met = wide.join(near.withColumn("span", span(F.col("origin_day"))), "span")
    return met.filter((F.col("origin_day") > F.col("issue_day") - lag) & (F.col("origin_day") <= F.col("issue_day") + F.col("horizon"))).drop("span")


def poisson_scores(held: DataFrame, plan: DataFrame, rate: float, area: float, log_density: DataFrame | None, model: str) -> DataFrame:
    """A model that no delay changes: uniform over the area, or by ``log_density`` (event_id, log_density)."""
    logs = held.select(*EXPOSURE, "event_id")
    logs = logs.withColumn("log", F.log(F.lit(rate / area))) if log_density is None else logs.join(log_density, "event_id").withColumn("log", F.col("log_density") + F.log(F.lit(rate)))
    sums = logs.groupBy(*EXPOSURE).agg(F.count("*").alias("n"), F.sum("log").alias("log_sum"), F.bit_xor(F.xxhash64("event_id")).alias("events"))
    return finished(plan.join(sums, EXPOSURE, "left").withColumn("compensator", F.lit(rate) * F.col("horizon")), model)


def finished(rows: DataFrame, model: str) -> DataFrame:
    out = rows.withColumns({"n": F.coalesce("n", F.lit(0)), "events": F.coalesce("events", F.lit(0)), "log_sum": F.coalesce("log_sum", F.lit(0.0))})
    return out.select(*KEY, F.lit(model).alias("model"), "n", "events", "compensator", (F.col("log_sum") - F.col("compensator")).alias("log_likelihood"))


def etas_scores(catalog: DataFrame, held: DataFrame, plan: DataFrame, delays: tuple[float, ...], cells: DataFrame, s: Spec, w: Parameters, log_density: DataFrame) -> DataFrame:
    """The self-exciting model: background w.mu times the density, and what parents add. Pairs are found once; the delay
    only decides which of them count. Parents' spatial masses are one table for all delays, horizons and issues."""
    events = catalog.filter(F.col("inside_external_buffer") & (F.col("magnitude") >= s.mc)).select("event_id", "origin_day", "available_day", "magnitude", "x_km", "y_km")
    distinct = held.select("event_id", "origin_day", "available_day", "magnitude", "x_km", "y_km").distinct()
    late = F.explode(F.array(*[F.lit(float(x)) for x in delays]))
    pairs = radius_join(distinct, events, s.cutoff, s.lag, visible=False).withColumn("delay", late).filter("p_available_day + delay <= t_origin_day")
    part = etas.trigger(F.col("dt"), F.col("r"), F.col("p_magnitude"), s, w)
    exposed = held.select(*EXPOSURE, F.col("event_id").alias("t_event_id"))
    # an exposure's parents begin after issue_day - lag: the pair's lag alone would let in older ones
    excited = exposed.join(pairs, "t_event_id").filter(F.col("p_origin_day") > F.col("issue_day") - s.lag).groupBy(*KEY, "t_event_id").agg(F.sum(part).alias("excited"))
    base = exposed.withColumn("delay", late).join(log_density.withColumnRenamed("event_id", "t_event_id"), "t_event_id")
    rates = base.join(excited, [*KEY, "t_event_id"], "left").withColumn("log", F.log(w.mu * F.exp("log_density") + F.coalesce("excited", F.lit(0.0))))
    sums = rates.groupBy(*KEY).agg(F.count("*").alias("n"), F.sum("log").alias("log_sum"), F.bit_xor(F.xxhash64("t_event_id")).alias("events"))
    masses = etas.parent_masses(events, cells, s)
    acting = score_parents(events.withColumn("inside_external_buffer", F.lit(True)), plan.select(*EXPOSURE).distinct(), s.mc, s.lag).withColumn("delay", late)
    lower = F.greatest(F.greatest("issue_day", F.col("available_day") + F.col("delay")) - F.col("origin_day"), F.lit(0.0))
    upper = F.least(F.lit(s.lag), F.col("issue_day") + F.col("horizon") - F.col("origin_day"))
    spent = kernels.productivity(F.col("magnitude"), w.k, w.alpha, s.mc) * (kernels.omori_cdf(F.col("upper"), w.c, w.p) - kernels.omori_cdf(F.col("lower"), w.c, w.p))
    triggered = acting.withColumns({"lower": lower, "upper": upper}).filter("upper > lower").join(masses, "event_id").groupBy(*KEY).agg(F.sum(spent * F.col("spatial_mass")).alias("triggered"))
    rows = plan.join(sums, KEY, "left").join(triggered, KEY, "left")
    return finished(rows.withColumn("compensator", w.mu * F.col("horizon") + F.coalesce("triggered", F.lit(0.0))), "etas")


def backtest(catalog: DataFrame, exposures: DataFrame, delays: tuple[float, ...], least: float, rate: float, area: float, log_density: DataFrame, cells: DataFrame, s: Spec, w: Parameters) -> DataFrame:
    """KEY, model, n, events (a hash of the targets' ids), compensator and log_likelihood of the uniform, spatial and
    self-exciting models over every delay, horizon and issue; exposures without events keep their compensator."""
    plan = exposures.withColumn("delay", F.explode(F.array(*[F.lit(float(x)) for x in delays]))).select(*KEY)
    held = targets(catalog, exposures, least)
    uniform = poisson_scores(held, plan, rate, area, None, "uniform")
    spatial = poisson_scores(held, plan, rate, area, log_density, "spatial")
    return uniform.unionByName(spatial).unionByName(etas_scores(catalog, held, plan, delays, cells, s, w, log_density))


def comparisons(scores: DataFrame, base: str = "uniform") -> DataFrame:
    """delay, horizon and model with exposures, events, gain (log-likelihood an event over ``base``) and unpaired:
    exposures whose identity - delay, horizon, issue, number and set of targets - has no equal in the base model, of
    which there must be none. In order of delay, horizon and model."""
    other = scores.filter(F.col("model") == base).select(*KEY, "n", "events", F.col("log_likelihood").alias("of_base"))
    both = scores.filter(F.col("model") != base).join(other, [*KEY, "n", "events"], "left")
    out = both.groupBy("delay", "horizon", "model").agg(F.count("*").alias("exposures"), F.sum("n").alias("events"), F.try_divide(F.sum(F.col("log_likelihood") - F.col("of_base")), F.sum("n")).alias("gain"), F.count_if(F.col("of_base").isNull()).alias("unpaired"))
    return out.orderBy("delay", "horizon", "model")
