"""Masks over a catalogue. Labels ignore when an event became available; histories never do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORIGIN, AVAILABLE, MAGNITUDE = F.col, "available_day", "magnitude"


def eligible(df: DataFrame, through: float, least: float, inside_only: bool = False) -> DataFrame:
    domain = F.col("inside_study_area") if inside_only else F.col("inside_study_area") | F.col("inside_external_buffer")
    return df.filter((F.col("available_day") <= through) & (F.col("magnitude") >= least) & domain)


def event_mask(df: DataFrame, least: float, after: float, through: float, available: float, inside_only: bool) -> DataFrame:
    return eligible(df, available, least, inside_only).filter((F.col("origin_day") > after) & (F.col("origin_day") <= through))


def targets(df: DataFrame, least: float, after: float, through: float) -> DataFrame:
    """Physical targets in (after, through]: no test of availability."""
    return df.filter(F.col("inside_study_area") & (F.col("magnitude") >= least) & (F.col("origin_day") > after) & (F.col("origin_day") <= through))


def training(df: DataFrame, least: float, start: float, end: float) -> DataFrame:
    return eligible(df, end, least, True).filter((F.col("origin_day") >= start) & (F.col("origin_day") <= end))


def exclusion(start: float, cutoff: float) -> Column:
    """The first reason, in order, for which an event stays out, else included."""
    return (
        F.when(~F.col("inside_study_area"), "outside").when(F.col("origin_day") < start, "before_start").when(F.col("origin_day") > cutoff, "future_origin")
        .when(F.col("available_day") > cutoff, "unavailable").otherwise("included")
    )


def issue_history(catalog: DataFrame, issues: list[float], least: float, span: float) -> DataFrame:
    """Each issue day's visible history: origin in [T - span, T], available by T. The few issue days are an array
    literal, so this is a narrow map and no join."""
    rows = catalog.filter(F.col("inside_external_buffer") & (F.col("magnitude") >= least)).withColumn("issue_day", F.explode(F.array(*[F.lit(float(x)) for x in issues])))
    return rows.filter((F.col("origin_day") >= F.col("issue_day") - span) & (F.col("origin_day") <= F.col("issue_day")) & (F.col("available_day") <= F.col("issue_day")))


def delayed(catalog: DataFrame, days: float, origin: float = 0.0) -> DataFrame:
    """The catalogue as published ``days`` later, in time from ``origin``."""
    return catalog.withColumns({"available_day": F.col("available_day") + days - origin, "origin_day": F.col("origin_day") - origin})


def fit_parents(catalog: DataFrame, least: float, start: float, end: float) -> DataFrame:
    """Parents of a fit: from its start on, and available by its end."""
    return catalog.filter(F.col("inside_external_buffer") & (F.col("magnitude") >= least) & (F.col("origin_day") >= start) & (F.col("origin_day") <= end) & (F.col("available_day") <= end))


def score_parents(catalog: DataFrame, least: float, end: float, lag: float) -> DataFrame:
    """Parents of a score up to its end: whether one was available yet is asked pair by pair."""
    return catalog.filter(F.col("inside_external_buffer") & (F.col("magnitude") >= least) & (F.col("origin_day") > end - lag) & (F.col("origin_day") <= end))


def leakage(observations: DataFrame | None = None, earthquakes: list[DataFrame] = (), geology: list[DataFrame] = (), basemaps: list[DataFrame] = ()) -> dict[str, int]:
    """Violations of the six rules that standardised tables can prove, over all tables of each group, one aggregate a
    table. The tables have the columns of their contracts."""
    midnight = lambda c: F.date_trunc("day", F.col(c)) == F.col(c)
    has = lambda c, x: F.array_contains(c, x)
    out = dict.fromkeys(("anomaly_available_at_rule", "anomaly_end_or_manual_field_backfill", "anomaly_occurrence_time_precision", "earthquake_available_at_assumption", "historical_geology_early_use", "basemap_model_feature_use"), 0)

    def add(df: DataFrame, rules: dict[str, list[Column]]) -> None:
        """Each condition that does not hold, or is unknown, counts once."""
        broken = [sum((F.when(F.coalesce(c, F.lit(False)), 0).otherwise(1) for c in cs), F.lit(0)) for cs in rules.values()]
        row = df.agg(*[F.coalesce(F.sum(b), F.lit(0)).alias(n) for n, b in zip(rules, broken, strict=True)]).first()
        for n in rules:
            out[n] += row[n]

    if observations is not None:
        local_day = F.greatest("report_date", "raw_row_report_date").cast("timestamp")
        end = F.col("reported_end_time").isNotNull()
        add(observations, {
            "anomaly_available_at_rule": [F.col("available_at") == local_day + F.expr("interval 16 hours")],
            "anomaly_end_or_manual_field_backfill": [F.when(end, F.col("right_censored") == has("reliability_flags", "future_reported_end_time")).otherwise(F.col("right_censored")), has("reliability_flags", "manual_prediction_fields_excluded")],
            "anomaly_occurrence_time_precision": [midnight("start_time") & (~end | midnight("reported_end_time")) & has("reliability_flags", "anomaly_time_date_only_assumed_fixed_utc_plus_08_midnight")],
        })
    for df in earthquakes:
        flags = "quality_flags" if "quality_flags" in df.columns else "normalization_flags"
        add(df, {"earthquake_available_at_assumption": [(F.col("available_at") == F.col("origin_time_utc")) & has(flags, "publication_time_assumed_origin_time")]})
    for df in geology:
        add(df, {"historical_geology_early_use": [~F.coalesce("historical_model_eligible", F.lit(False))]})
    for df in basemaps:
        add(df, {"basemap_model_feature_use": [~F.coalesce("model_feature_eligible", F.lit(False))]})
    return out


def domain_class() -> Column:
    return F.when(F.col("inside_study_area"), "study").when(F.col("inside_external_buffer"), "buffer").otherwise("outside")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row a rule with the number of rows that break it: one aggregate over one scan."""
    counts = df.agg(*[F.count_if(c).alias(n) for n, c in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])).alias("x")).select("x.*")
