"""Registered queries: each applies operators to the driver's tables; oracles.py has their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremora.functions import geodesy, kernels, moments, textual
from tremora.operators import completeness, dedup, etas, evaluation, filters, fitting, grid, joins, poisson, sequences, simulation
from tremora.plans.oracles import ORACLES  # noqa: F401
from tremora.plans.view import AREA, BUFFER, FIRST_DAY, STUDY_X, STUDY_Y, catalog, table

QUERIES: dict = {}
CUT = FIRST_DAY + 20
#: The scalar fixture's parameters.
MICRO = {"mc": 3.0, "k": 0.2, "alpha": 1.0, "c": 0.05, "p": 1.2, "d": 25.0, "q": 1.5, "gamma": 1.0, "cutoff": 300.0}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
SPEC, PARAMETERS = etas.Spec(mc=4.5, lag=5.0), etas.Parameters(mu=20.0)
CELLS = grid.cell_values(100.0, STUDY_X, STUDY_Y)


def study_cells(spark: SparkSession) -> DataFrame:
    return grid.cells(spark, 100.0, STUDY_X, STUDY_Y)


def query(f):
    QUERIES[f.__name__] = f
    return f


# --- scans and filters ---------------------------------------------------------------------------------------------


@query
def catalog_scan(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).filter((F.col("origin_day") <= CUT) & (F.col("available_day") <= CUT)).select("event_id", "origin_day", "available_day", "magnitude", "inside_study_area", "inside_external_buffer")


@query
def catalog_eligible(spark: SparkSession, d: str) -> DataFrame:
    return filters.eligible(catalog(spark, d), CUT, 3.2).groupBy("source").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query
def event_mask(spark: SparkSession, d: str) -> DataFrame:
    return filters.event_mask(catalog(spark, d), 3.2, FIRST_DAY + 7, FIRST_DAY + 17, FIRST_DAY + 18, False).select("event_id", "magnitude")


@query
def target_mask(spark: SparkSession, d: str) -> DataFrame:
    return filters.targets(catalog(spark, d), 3.2, FIRST_DAY + 7, FIRST_DAY + 17).select("event_id", "magnitude", "available_day")


@query
def training_mask(spark: SparkSession, d: str) -> DataFrame:
    return filters.training(catalog(spark, d), 3.2, FIRST_DAY + 2, FIRST_DAY + 12).select("event_id", "magnitude")


@query
def exclusion_audit(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).groupBy(filters.exclusion(FIRST_DAY + 2, FIRST_DAY + 22).alias("reason")).agg(F.count("*").alias("n"))


@query
def delay_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """Events visible at the cut when the catalogue is published 0, 1 and 7 days later."""
    late = catalog(spark, d).withColumn("delay", F.explode(F.array(*[F.lit(float(x)) for x in (0, 1, 7)])))
    return late.filter(F.col("available_day") + F.col("delay") <= CUT).groupBy("delay").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


@query
def issue_history(spark: SparkSession, d: str) -> DataFrame:
    return filters.issue_history(catalog(spark, d), [FIRST_DAY + x for x in (5, 10, 15, 20, 25)], 3.2, 8.0).groupBy("issue_day").agg(F.count("*").alias("n"), F.max("magnitude").alias("greatest"))


@query
def domain_classes(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).groupBy(filters.domain_class().alias("domain")).agg(F.count("*").alias("n"))


@query
def leakage_counts(spark: SparkSession, d: str) -> DataFrame:
    late = F.col("available_day") > CUT
    rules = {
        "available_before_origin": F.col("available_day") < F.col("origin_day"), "history_not_yet_available": late & (F.col("origin_day") <= CUT),
        "inside_but_not_in_buffer": F.col("inside_study_area") & ~F.col("inside_external_buffer"), "magnitude_below_bin": F.col("magnitude") < 2.95,
        "optimistic_availability": F.col("available_day") == F.col("origin_day"), "source_unknown": ~F.col("source").isin("m3", "m5"),
    }
    return filters.violations(catalog(spark, d), rules)


@query
def quality_summary(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).groupBy("source").agg(
        F.count("*").alias("n"), F.count_if("inside_study_area").alias("inside"), F.count_if(F.col("available_day") > F.col("origin_day")).alias("delayed"),
        F.round(F.min("origin_day"), 6).alias("first_day"), F.round(F.max("origin_day"), 6).alias("last_day"), F.min("magnitude").alias("least"), F.max("magnitude").alias("greatest"),
    )


@query
def null_audit(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.nullif("event_type", F.lit("error")).alias("kind"), F.when(F.col("value") >= 5, F.col("value")).alias("value"), F.when(F.col("user_id") % 7 > 0, F.col("user_id")).alias("user_id"))
    missing = textual.flags(kind=F.col("kind").isNull(), value=F.col("value").isNull(), user_id=F.col("user_id").isNull())
    return e.groupBy(F.array_join(missing, ",").alias("missing")).agg(F.count("*").alias("n"))


@query
def inventory(spark: SparkSession, d: str) -> DataFrame:
    """Path, bytes and digest of every table's files."""
    from tremora.sources import files

    return files.inventory(spark, {n: f"{d}/{n}.parquet" for n in TABLES}).select("source_id", "name", "bytes", "sha256")


# --- completeness --------------------------------------------------------------------------------------------------


@query
def maxc_histogram(spark: SparkSession, d: str) -> DataFrame:
    return completeness.histogram(catalog(spark, d))


@query
def maxc_estimate(spark: SparkSession, d: str) -> DataFrame:
    return completeness.max_curvature(catalog(spark, d))


@query
def aki_b(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: the magnitude of completeness of the whole catalogue and the b-value above it."""
    out = completeness.stratum_estimates(catalog(spark, d), [])
    return out.select(F.col("candidate").alias("mc"), "n_complete", F.round("b", 9).alias("b"))


@query
def magnitude_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return completeness.b_values(catalog(spark, d)).select("mc", "n", F.round("b", 9).alias("b"))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    inside = catalog(spark, d).filter("inside_study_area")
    return completeness.temporal_blocks(inside, FIRST_DAY, FIRST_DAY + 31, 7.0, 200, 4.0)


@query
def temporal_blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocks(spark, d).select("block", "n", "peak", "estimate", "candidate", "n_complete", F.round("b", 9).alias("b"), "days", "eligible")


@query
def regime_change(spark: SparkSession, d: str) -> DataFrame:
    out = sequences.regime_changes(blocks(spark, d).select("block", "estimate", "rate"), "block", "estimate", "rate", 0.2, 1.5)
    return out.select("block", F.round("mc_change", 6).alias("mc_change"), F.round("rate_ratio", 9).alias("rate_ratio"), "changed")


@query
def spatial_strata(spark: SparkSession, d: str) -> DataFrame:
    inside = catalog(spark, d).filter("inside_study_area")
    return completeness.spatial_strata(inside, 200.0, 250).select("cx", "cy", "level", "n", "peak", "estimate")


@query
def sparse_parent_resolution(spark: SparkSession, d: str) -> DataFrame:
    return completeness.sparse_parents(catalog(spark, d).filter("inside_study_area"), 200.0, 250).select("cx", "cy", "n", "px", "py", "parent_n")


@query
def completeness_gate(spark: SparkSession, d: str) -> DataFrame:
    return completeness.gate(blocks(spark, d).filter("eligible").select("estimate"))


@query
def snapshot_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Estimates as of several cutoffs: each event goes to every cutoff that may see it."""
    cuts = F.array(*[F.lit(FIRST_DAY + x) for x in (7.0, 14.0, 21.0, 28.0)])
    rows = catalog(spark, d).filter("inside_study_area").withColumn("cutoff", F.explode(F.filter(cuts, lambda c: (F.col("origin_day") <= c) & (F.col("available_day") <= c))))
    return completeness.stratum_estimates(rows, ["cutoff"]).select("cutoff", "n", "peak", "estimate", "candidate", "n_complete", F.round("b", 9).alias("b"))


# --- duplicates and joins ------------------------------------------------------------------------------------------


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = catalog(spark, d).select("event_id", "origin_day", "magnitude", "x_km", "y_km", "source")
    return c.filter("source = 'm3'"), c.filter("source = 'm5'")


def candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dedup.candidates(*sides(spark, d), review=(7200.0, 60.0, 0.5), auto=(3600.0, 40.0, 0.2))


@query
def dedup_candidates(spark: SparkSession, d: str) -> DataFrame:
    return candidate_pairs(spark, d).select("l_event_id", "r_event_id", F.round("seconds", 1).alias("seconds"), F.round("km", 6).alias("km"), "dm", "auto")


@query
def dedup_accepted(spark: SparkSession, d: str) -> DataFrame:
    return dedup.accepted(candidate_pairs(spark, d)).select("l_event_id", "r_event_id")


@query
def dedup_classified(spark: SparkSession, d: str) -> DataFrame:
    return dedup.classified(candidate_pairs(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


@query
def dedup_status(spark: SparkSession, d: str) -> DataFrame:
    return dedup.event_status(sides(spark, d)[0], candidate_pairs(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


@query
def dedup_events(spark: SparkSession, d: str) -> DataFrame:
    return dedup.events(*sides(spark, d), candidate_pairs(spark, d)).select("event_id", "magnitude", F.array_join("sources", "+").alias("sources"))


@query
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    keyed = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    return keyed.groupBy("o_custkey", "day").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key")).filter("n > 1")


@query
def duplicate_ordinal(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    return sequences.duplicate_ordinal(e, ["user_id", "event_type", "day"], ["event_id"]).filter("group_size > 1").select("event_id", "ordinal", "group_size")


@query
def end_time_revisions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 > 0, F.floor("value").cast("long")).alias("end"))
    return sequences.revisions(e, "user_id", ["ts", "event_id"], "end").select("event_id", "retracted", "revised")


@query
def key_join_strict(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    out = joins.strict_join(n.select(F.col("n_nationkey").alias("key"), "n_name"), r.select(F.col("r_regionkey").alias("key"), "r_name"), ["key"], {"n_name": "r_name"})
    return out.select("key", "n_name", "r_name", "fault")


@query
def key_set_difference(spark: SparkSession, d: str) -> DataFrame:
    """Finished orders against orders of which a line came back."""
    done = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key"))
    back = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key"))
    return joins.key_difference(done, back, ["key"]).select("key", "side")


@query
def crosswalk_two_tier(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("name"), F.substring("n_name", 1, 2).alias("loose"))
    shortened = F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).otherwise(F.concat(F.substring("n_name", 1, 2), F.lit("X")))
    t = table(spark, d, "nation").withColumn("name", shortened).select((F.col("n_nationkey") + 100).alias("trace"), "name", F.substring("name", 1, 2).alias("loose")).filter("trace < 120")
    return joins.two_tier_join(s, t, "n_nationkey", "trace", "name", "loose").select("n_nationkey", "trace", "tier")


@query
def parent_windows(spark: SparkSession, d: str) -> DataFrame:
    out = joins.overlap_window(catalog(spark, d), FIRST_DAY + 10, FIRST_DAY + 20, 5.0)
    return out.select("event_id", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"))


@query
def missing_periods(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("period"))
    return sequences.missing_numbers(e, "user_id", "period").select("user_id", "period", "nearest")


@query
def greedy_exposures(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("double").alias("day"))
    days = e.groupBy("user_id").agg(F.array_sort(F.collect_set("day")).alias("days"))
    return days.select("user_id", F.explode(sequences.greedy_exposures(F.col("days"), 4.0)).alias("day")).select("user_id", F.col("day").cast("int").alias("day"))


@query
def segment_numbers(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", "> new").otherwise("1 2").alias("line"))
    return sequences.segment_ids(lines, "event_id", "line", ["user_id"]).filter("line not like '>%'").groupBy("user_id", "segment").agg(F.count("*").alias("points"))


@query
def serial_faults(spark: SparkSession, d: str) -> DataFrame:
    return sequences.serial_faults(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").filter("l_partkey % 5 > 0"), ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_linenumber", "place")


@query
def period_pivot(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("period"), "event_type")
    return e.groupBy("period").agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in ("click", "error", "purchase", "signup", "view")], F.count("*").alias("n"))


# --- grid ----------------------------------------------------------------------------------------------------------


@query
def grid_cells(spark: SparkSession, d: str) -> DataFrame:
    return grid.cells(spark, 250.0, STUDY_X, STUDY_Y).select("cell_id", "area_km2", "x_km", "y_km")


@query
def cell_assignment(spark: SparkSession, d: str) -> DataFrame:
    return grid.assigned(catalog(spark, d).filter("inside_study_area"), 50.0).groupBy("cell_id").agg(F.count("*").alias("n"))


def cell_rates(spark: SparkSession, d: str, size: float) -> DataFrame:
    rows = grid.assigned(catalog(spark, d).filter("inside_study_area and magnitude >= 3.2"), size)
    return rows.groupBy("row", "column").agg(F.count("*").cast("double").alias("value"))


@query
def fine_to_coarse(spark: SparkSession, d: str) -> DataFrame:
    return grid.coarser(cell_rates(spark, d, 50.0), "value")


@query
def grid_filled(spark: SparkSession, d: str) -> DataFrame:
    """Rates of 50 km cells on every 100 km cell of the study area, zeros too."""
    return grid.filled(study_cells(spark), cell_rates(spark, d, 50.0), "value").select("row", "column", "value", "orphan")


@query
def cell_lookup(spark: SparkSession, d: str) -> DataFrame:
    """All events by cell of the study grid, and those that no cell holds."""
    return grid.to_cells(catalog(spark, d), grid.cells(spark, 50.0, STUDY_X, STUDY_Y), 50.0).groupBy("missing").agg(F.count("*").alias("n"), F.count_distinct("row", "column").alias("cells"))


@query
def grid_convergence(spark: SparkSession, d: str) -> DataFrame:
    """A smooth density at centres of 50, 25 and 12.5 km cells, each grid against the next finer one."""
    def field(size):
        return grid.cells(spark, size, STUDY_X, STUDY_Y).select("row", "column", (F.exp(-(F.col("x_km") ** 2 + F.col("y_km") ** 2) / 80000.0) * F.col("area_km2")).alias("value"))

    out = grid.three_grids({size: field(size) for size in (50.0, 25.0, 12.5)}, "value")
    return out.select("coarse_km", "fine_km", F.round("relative_total", 9).alias("relative_total"), F.round("density_l1", 9).alias("density_l1"), "passed")


# --- Poisson and kernel density ------------------------------------------------------------------------------------


def kde_training(spark: SparkSession, d: str) -> DataFrame:
    return filters.training(catalog(spark, d), 5.0, FIRST_DAY, FIRST_DAY + 20)


@query
def uniform_poisson_score(spark: SparkSession, d: str) -> DataFrame:
    n = catalog(spark, d).filter("inside_study_area and magnitude >= 3.2").agg(F.count_if(F.col("origin_day") <= CUT).alias("trained"), F.count_if(F.col("origin_day") > CUT).alias("n"))
    rate = F.col("trained") / F.lit(20.0)
    return n.select("trained", "n", F.round(rate, 9).alias("rate"), F.round(poisson.uniform_score(F.col("n"), rate, AREA, 11.0), 6).alias("log_likelihood"))


@query
def kde_cell_mass(spark: SparkSession, d: str) -> DataFrame:
    return poisson.kde_cell_masses(kde_training(spark, d), grid.cell_array(CELLS)).select("h", "row", "column", F.round("mass", 9).alias("mass"))


def normalisers(masses: DataFrame) -> DataFrame:
    return masses.groupBy("h").agg(F.first("normaliser").alias("normaliser"))


def kde_scores(spark: SparkSession, d: str) -> DataFrame:
    c, training = catalog(spark, d), kde_training(spark, d)
    queries = c.filter("inside_study_area and magnitude >= 5.5").filter(F.col("origin_day") > CUT)
    return poisson.kde_log_densities(queries, training, normalisers(poisson.kde_cell_masses(training, grid.cell_array(CELLS))))


@query
def kde_event_log_density(spark: SparkSession, d: str) -> DataFrame:
    return kde_scores(spark, d).select("event_id", "h", F.round("log_density", 8).alias("log_density"))


@query
def kde_far_density(spark: SparkSession, d: str) -> DataFrame:
    """Queries 4,000 km away, where a plain sum of kernels is zero."""
    c, training = catalog(spark, d), kde_training(spark, d)
    queries = c.filter("inside_study_area and magnitude >= 5.5").filter(F.col("origin_day") > CUT).withColumn("x_km", F.col("x_km") + 4000)
    out = poisson.kde_log_densities(queries, training, normalisers(poisson.kde_cell_masses(training, grid.cell_array(CELLS))))
    return out.select("event_id", "h", F.round("log_density", 6).alias("log_density"))


@query
def exposure_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of six exposures of three days, of which the last lie beyond the catalogue and have no event."""
    fold = F.floor((F.col("origin_day") - CUT) / 3.0).cast("int")
    logs = kde_scores(spark, d).filter("h = 150").join(catalog(spark, d).select("event_id", fold.alias("fold")), "event_id")
    plan = spark.range(6).select(F.col("id").cast("int").alias("fold"), F.lit(5.0).alias("rate"), F.lit(3.0).alias("days"), F.lit(1.0).alias("mass"))
    return poisson.scores(logs, plan, ["fold"]).select("fold", "n", F.round("log_likelihood", 6).alias("log_likelihood"))


def kde_fold_scores(spark: SparkSession, d: str) -> DataFrame:
    fold = F.floor((F.col("origin_day") - CUT) / 3.0).cast("int")
    places = catalog(spark, d).select("event_id", fold.alias("fold")).filter("fold between 0 and 3")
    return kde_scores(spark, d).join(places, "event_id").groupBy("h", "fold").agg((F.avg("log_density") - F.log(F.lit(1 / AREA))).alias("score"), F.count("*").alias("n"))


@query
def kde_fold_gain(spark: SparkSession, d: str) -> DataFrame:
    return kde_fold_scores(spark, d).select("h", "fold", "n", F.round("score", 8).alias("score"))


@query
def kde_bandwidth_select(spark: SparkSession, d: str) -> DataFrame:
    return poisson.select_bandwidth(kde_fold_scores(spark, d)).select("h", F.round("mean", 8).alias("mean"), F.round("se", 8).alias("se"), "eligible", "selected")


# --- self-exciting rates -------------------------------------------------------------------------------------------


def etas_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = catalog(spark, d).select("event_id", "origin_day", "available_day", "magnitude", "x_km", "y_km", "inside_study_area", "inside_external_buffer")
    parents = c.filter("inside_external_buffer and magnitude >= 4.5")
    return filters.targets(c, 4.5, FIRST_DAY + 10, FIRST_DAY + 20), parents


@query
def omori_weights(spark: SparkSession, d: str) -> DataFrame:
    age = F.lit(FIRST_DAY + 31) - F.col("origin_day")
    return catalog(spark, d).select("event_id", F.round(kernels.omori_density(age, 0.05, 1.2), 9).alias("density"), F.round(kernels.omori_cdf(age, 0.05, 1.2), 9).alias("mass"))


@query
def inverse_power_density(spark: SparkSession, d: str) -> DataFrame:
    r, m = F.sqrt(F.col("x_km") ** 2 + F.col("y_km") ** 2), F.col("magnitude")
    args = (25.0, 1.5, 1.0, 3.0, 300.0)
    return catalog(spark, d).select("event_id", F.round(kernels.spatial_density(r, m, *args), 12).alias("density"), F.round(kernels.spatial_mass(r, m, *args), 9).alias("mass"))


@query
def etas_pairs(spark: SparkSession, d: str) -> DataFrame:
    return etas.pairs(*etas_sides(spark, d), SPEC).select("t_event_id", "p_event_id", F.round("dt", 6).alias("dt"), F.round("r", 6).alias("r"))


@query
def etas_event_intensity(spark: SparkSession, d: str) -> DataFrame:
    t, p = etas_sides(spark, d)
    return etas.intensities(t, etas.pairs(t, p, SPEC), SPEC, PARAMETERS, F.lit(PARAMETERS.mu / AREA)).select("event_id", F.round("intensity", 10).alias("intensity"))


@query
def etas_log_likelihood(spark: SparkSession, d: str) -> DataFrame:
    t, p = etas_sides(spark, d)
    out = etas.log_likelihood(t, p, study_cells(spark), SPEC, PARAMETERS, FIRST_DAY + 10, FIRST_DAY + 20, AREA)
    return out.select("n", F.round("log_sum", 5).alias("log_sum"), "background", F.round("triggered", 5).alias("triggered"), F.round("log_likelihood", 4).alias("log_likelihood"))


@query
def etas_cell_mass(spark: SparkSession, d: str) -> DataFrame:
    return etas.cell_masses(etas_sides(spark, d)[1], study_cells(spark), SPEC, PARAMETERS, FIRST_DAY + 10, FIRST_DAY + 20, AREA).select("row", "column", F.round("mass", 7).alias("mass"))


@query
def etas_issue_field(spark: SparkSession, d: str) -> DataFrame:
    return etas.field(etas_sides(spark, d)[1], study_cells(spark), SPEC, PARAMETERS, FIRST_DAY + 20, AREA).select("row", "column", F.round("intensity", 9).alias("intensity"))


@query
def etas_cell_mass_without_parents(spark: SparkSession, d: str) -> DataFrame:
    """Before the catalogue begins no parent acts: the background's mass on every cell."""
    return etas.cell_masses(etas_sides(spark, d)[1], study_cells(spark), SPEC, PARAMETERS, FIRST_DAY - 30, FIRST_DAY - 20, AREA).select("row", "column", F.round("mass", 7).alias("mass"))


@query
def layer_summary(spark: SparkSession, d: str) -> DataFrame:
    out = etas.layer_summary(etas.field(etas_sides(spark, d)[1], study_cells(spark), SPEC, PARAMETERS, FIRST_DAY + 20, AREA))
    return out.select("cells", F.round("total", 5).alias("total"), F.round("least", 9).alias("least"), F.round("greatest", 9).alias("greatest"))


@query
def scalar_regression(spark: SparkSession, d: str) -> DataFrame:
    """The 23 closed-form scalars of kernels, intensities and likelihood, in one row of expressions."""
    k, a, c, p, mc = (MICRO[x] for x in ("k", "alpha", "c", "p", "mc"))
    space = tuple(MICRO[x] for x in ("d", "q", "gamma", "mc", "cutoff"))
    mu, radius, start, end = 1e-4, 30.0, 0.5, 2.0
    prod = lambda m: kernels.productivity(m, k, a, mc)
    g = lambda t: kernels.omori_density(t, c, p)
    cdf = lambda t: kernels.omori_cdf(t, c, p)
    f = lambda r, m: kernels.spatial_density(r, m, *space)
    mass = lambda m: kernels.spatial_mass(radius, m, *space)
    event = mu + prod(4.0) * g(1.0) * f(0.0, 4.0)
    probe = mu + prod(4.0) * g(2.0) * f(5.0, 4.0) + prod(3.5) * g(1.0) * f(5.0, 3.5)
    base, root, later = F.lit(mu * math.pi * radius**2 * (end - start)), prod(4.0) * (cdf(end) - cdf(start)) * mass(4.0), prod(3.5) * cdf(1.0) * mass(3.5)
    values = {
        "cutoff_mass_m4": kernels.cutoff_mass(4.0, *space), "cutoff_mass_m3p5": kernels.cutoff_mass(3.5, *space),
        "sigma_m4_km2": kernels.spatial_scale(4.0, 25.0, 1.0, 3.0), "sigma_m3p5_km2": kernels.spatial_scale(3.5, 25.0, 1.0, 3.0),
        "productivity_m4": prod(4.0), "productivity_m3p5": prod(3.5), "temporal_density_dt1_per_day": g(1.0), "temporal_density_dt2_per_day": g(2.0),
        "temporal_cdf_dt0p5": cdf(0.5), "temporal_cdf_dt1": cdf(1.0), "temporal_cdf_dt2": cdf(2.0),
        "spatial_density_r0_m4_per_km2": f(0.0, 4.0), "spatial_density_r5_m4_per_km2": f(5.0, 4.0), "spatial_density_r5_m3p5_per_km2": f(5.0, 3.5),
        "spatial_mass_r30_m4": mass(4.0), "spatial_mass_r30_m3p5": mass(3.5), "lambda_event_t1_r0_per_day_km2": event,
        "background_compensator": base, "root_compensator": root, "event1_postevent_compensator": later, "total_compensator": base + root + later,
        "unmarked_log_likelihood": F.log(event) - (base + root + later), "lambda_probe_t2_r5_per_day_km2": probe,
    }
    one = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in values.items()])).alias("x")).select("x.*")
    return one.withColumn("value", F.round("value", 12))


@query
def branching_ratios(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in (0.0, 0.5, 1.0, 1.5, 2.0, 2.5)])).alias("alpha"))
    return rows.select("alpha", F.round(kernels.branching_ratio(0.2, F.col("alpha"), 2.0, 4.0), 9).alias("ratio"))


# --- evaluation ----------------------------------------------------------------------------------------------------


def model_folds(spark: SparkSession, d: str) -> DataFrame:
    """Gain of each KDE bandwidth taken as a model, by fold."""
    return kde_fold_scores(spark, d).select(F.concat(F.lit("kde"), F.col("h").cast("int").cast("string")).alias("model"), "fold", F.col("score").alias("gain"), F.col("h").cast("int").alias("complexity"))


@query
def info_gain(spark: SparkSession, d: str) -> DataFrame:
    return kde_fold_scores(spark, d).groupBy("h").agg(F.sum("n").alias("n"), F.round(evaluation.information_gain(F.sum(F.col("score") * F.col("n")), F.lit(0.0), F.sum("n")), 8).alias("gain"))


@query
def g1_gate(spark: SparkSession, d: str) -> DataFrame:
    folds = model_folds(spark, d)
    validation = folds.groupBy("model").agg(F.avg("gain").alias("gain"), (F.max("complexity") != 75).alias("stable"))
    return evaluation.g1(folds, validation).select("model", F.round("gain", 8).alias("gain"), "positive_folds", "stable", "passed")


@query
def model_select_one_se(spark: SparkSession, d: str) -> DataFrame:
    folds = model_folds(spark, d)
    validation = folds.groupBy("model").agg(F.avg("gain").alias("gain"), (-F.max("complexity")).alias("complexity"), F.lit(True).alias("stable"))
    return evaluation.select_model(folds, validation).select("model", F.round("gain", 8).alias("gain"), F.round("se", 8).alias("se"), "eligible", "best", "chosen")


@query
def horizon_backtest(spark: SparkSession, d: str) -> DataFrame:
    """Counts and uniform scores of non-overlapping exposures for each horizon."""
    days = F.array(*[F.lit(FIRST_DAY + x) for x in range(5, 26)])
    horizons = (1.0, 3.0, 7.0)
    plan = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), sequences.greedy_exposures(days, h).alias("days")) for h in horizons])).alias("x")).select("x.horizon", F.explode("x.days").alias("issue_day"))
    counts = evaluation.horizon_counts(catalog(spark, d), plan, horizons, 4.0)
    return counts.select("horizon", F.col("issue_day").cast("int").alias("issue_day"), F.col("n").cast("long").alias("n"), F.round(poisson.uniform_score(F.col("n"), F.lit(40.0), AREA, F.col("horizon")), 6).alias("log_likelihood"))


# --- futures -------------------------------------------------------------------------------------------------------


def given_future(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = catalog(spark, d).filter("inside_study_area and magnitude >= 4").withColumn("replicate", F.pmod(F.col("event_id"), F.lit(32)).cast("int"))
    return c, spark.range(32).select(F.col("id").cast("int").alias("replicate"))


@query
def future_counts(spark: SparkSession, d: str) -> DataFrame:
    return simulation.horizon_replicate_counts(*given_future(spark, d), FIRST_DAY, (1.0, 7.0, 14.0, 30.0)).select("horizon", "replicate", F.col("n").cast("long").alias("n"))


@query
def future_quantiles(spark: SparkSession, d: str) -> DataFrame:
    counts = simulation.horizon_replicate_counts(*given_future(spark, d), FIRST_DAY, (1.0, 7.0, 14.0, 30.0))
    return simulation.count_quantiles(counts).select("horizon", F.round("mean", 9).alias("mean"), F.round("q25", 9).alias("low"), F.round("q500", 9).alias("middle"), F.round("q975", 9).alias("high"))


@query
def sparse_expected_cells(spark: SparkSession, d: str) -> DataFrame:
    return simulation.expected_cells(grid.assigned(given_future(spark, d)[0], 200.0), 32, ["row", "column"])


@query
def etas_simulation(spark: SparkSession, d: str) -> DataFrame:
    history = catalog(spark, d).filter("inside_external_buffer and magnitude >= 5.5")
    out = simulation.simulate(history, etas.Spec(mc=5.5, lag=3650.0), etas.Parameters(mu=1.0), FIRST_DAY + 31, 30.0, 128, (STUDY_X, STUDY_Y), BUFFER)
    return out.groupBy("replicate").agg(F.count_if("inside").alias("n"), F.max("generation").alias("generations"))


@query
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    gains = kde_scores(spark, d).filter("h = 150").select((F.col("log_density") - F.log(F.lit(1 / AREA))).alias("contribution"))
    return simulation.interval(simulation.bootstrap_gains(gains))


@query
def analytic_regression(spark: SparkSession, d: str) -> DataFrame:
    """The nine checks of 8,192 trees against the closed form: all pass."""
    return simulation.analytic_checks(simulation.analytic_regression(spark)).select("name", "passed")


@query
def etas_fit(spark: SparkSession, d: str) -> DataFrame:
    c = catalog(spark, d)
    parents = c.filter("inside_external_buffer and magnitude >= 5.5")
    spec = etas.Spec(mc=5.5, lag=31.0)
    targets = filters.targets(c, 5.5, FIRST_DAY + 5, FIRST_DAY + 20)
    d_ = fitting.prepare(targets, parents, study_cells(spark), spec, FIRST_DAY + 5, FIRST_DAY + 20, AREA)
    f = fitting.fit(d_, spec)
    return spark.createDataFrame([(*[float(x) for x in (f.parameters.mu, f.parameters.k, f.parameters.alpha, f.parameters.c, f.parameters.p, f.log_likelihood)], int(f.converged), bool(f.stable), f.reason)], "mu double, k double, alpha double, c double, p double, log_likelihood double, converged int, stable boolean, reason string")


# --- scalar functions on tables ------------------------------------------------------------------------------------


@query
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", textual.normalize_ascii(F.concat(F.lit("  "), F.regexp_replace("p_name", " ", " \t "))).alias("name"), textual.canonical_decimal(F.col("p_retailprice").cast("decimal(12,2)")).alias("price"), textual.content_id(F.col("p_name")).alias("id"))


@query
def loose_names(spark: SparkSession, d: str) -> DataFrame:
    """Part names with signs for dashes and class words, and numbers in place of some."""
    key = F.col("p_partkey")
    name = F.when(key % 5 == 0, F.concat(F.lit("-"), key.cast("string"), F.lit(".5"))).when(key % 5 == 1, F.concat(F.regexp_replace("p_name", " ", "\u2014_"), F.lit("断裂带"))).when(key % 5 == 2, F.concat("p_name", F.lit("断层"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", textual.loose_name(name).alias("name"))


@query
def time_functions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    day = F.to_date("o_orderdate")
    return o.select("o_orderkey", F.date_format(moments.conservative_available_at(day, F.date_add(day, (F.col("o_orderkey") % 3).cast("int") - 1)), "yyyy-MM-dd HH:mm").alias("available"), F.round(moments.epoch_day(F.col("o_orderdate").cast("timestamp_ntz")), 6).alias("day"))


@query
def great_circle(spark: SparkSession, d: str) -> DataFrame:
    c = catalog(spark, d)
    lon, lat = F.lit(105.0) + F.col("x_km") / 100, F.lit(35.0) + F.col("y_km") / 100
    return c.select("event_id", F.round(geodesy.great_circle_km(lon, lat, F.lit(105.0), F.lit(35.0)), 3).alias("km"))


@query
def albers_projection(spark: SparkSession, d: str) -> DataFrame:
    c = catalog(spark, d)
    x, y = geodesy.albers(F.lit(105.0) + F.col("x_km") / 100, F.lit(35.0) + F.col("y_km") / 100)
    return c.select("event_id", F.round(x, 1).alias("x_m"), F.round(y, 1).alias("y_m"))


@query
def text_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Lines in the fixed layout of a text catalogue, written and parsed again."""
    from tremora.sources import texts

    e = table(spark, d, "events")
    line = F.concat_ws(" ", F.date_format("ts", "yyyyMMdd"), F.date_format("ts", "HHmmss.SS"), (F.col("user_id") % 90).cast("string"), F.col("user_id").cast("string"), F.round("value", 1).cast("string"), F.when(F.col("event_id") % 4 == 0, "-1").otherwise("10"), F.lit("000"), F.concat(F.lit("place "), F.col("event_type")))
    parsed = texts.parse_catalog(e.select(F.col("event_id").alias("source_row"), line.alias("value")))
    return parsed.select(F.col("source_row").alias("event_id"), "latitude", "longitude", "magnitude", "depth_km", "place", F.array_join("flags", ",").alias("flags"), F.col("origin_local").cast("string").substr(1, 19).alias("origin_local"))


@query
def best_three(spark: SparkSession, d: str) -> DataFrame:
    return sequences.ranked(table(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], [F.desc("value"), F.asc("event_id")], 3).select("user_id", "event_id", "place")


@query
def regression_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Mean, variance and the distance of the values' empirical law from the exponential one with mean 50."""
    w = Window.partitionBy("event_type")
    e = table(spark, d, "events").withColumns({"n": F.count("*").over(w), "place": F.row_number().over(w.orderBy("value", "event_id"))})
    pit = -F.expm1(-F.col("value") / 50.0)
    ks = F.greatest(F.col("place") / F.col("n") - pit, pit - (F.col("place") - 1) / F.col("n"))
    return e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.var_samp("value"), 4).alias("variance"), F.round(F.max(ks), 9).alias("ks"))
