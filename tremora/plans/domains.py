"""Registered queries of study areas, horizon backtests, fault maps and anomaly reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremora.operators import filters, grid, horizons, poisson, sequences, study
from tremora.plans.catalogue import CELLS, PARAMETERS, SPEC, kde_training, normalisers, query, study_cells
from tremora.plans.oracles import ETAS, KDE, ORACLES, POWER, TRIGGER, sql
from tremora.plans.view import AREA, BUFFER, FIRST_DAY, catalog, table
from tremora.sources import anomalies, faultmaps

#: A hexagon with a square hole, in km.
HEXAGON = {"type": "Polygon", "coordinates": [[[600, 0], [300, 400], [-300, 400], [-600, 0], [-300, -400], [300, -400], [600, 0]], [[-50, -50], [50, -50], [50, 50], [-50, 50], [-50, -50]]]}

# --- study area ----------------------------------------------------------------------------------------------------


@query
def polygon_domains(spark: SparkSession, d: str) -> DataFrame:
    area = study.area_of(HEXAGON, project=False)
    marked = study.with_domains(catalog(spark, d).drop("inside_study_area", "inside_external_buffer"), area, BUFFER)
    return marked.groupBy(filters.domain_class().alias("domain")).agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


EDGES = "(VALUES (600, 0, 300, 400), (300, 400, -300, 400), (-300, 400, -600, 0), (-600, 0, -300, -400), (-300, -400, 300, -400), (300, -400, 600, 0)) AS v(ax, ay, bx, by_)"
sql("polygon_domains", f"""SELECT CASE WHEN inside THEN 'study' WHEN near <= 300 THEN 'buffer' ELSE 'outside' END AS domain, count(*) AS n, max(event_id) AS last_id FROM (
  SELECT event_id, abs(y_km) <= 400 AND 4 * abs(x_km) + 3 * abs(y_km) <= 2400 AND NOT (abs(x_km) < 50 AND abs(y_km) < 50) AS inside, abs(x_km) < 50 AND abs(y_km) < 50 AS hole, min(dist) AS edge,
    CASE WHEN hole THEN 0 ELSE min(dist) END AS near FROM (
    SELECT event_id, x_km, y_km, sqrt(pow(ax + t * (bx - ax) - x_km, 2) + pow(ay + t * (by_ - ay) - y_km, 2)) AS dist FROM (
      SELECT *, greatest(0, least(1, ((x_km - ax) * (bx - ax) + (y_km - ay) * (by_ - ay)) / CAST(pow(bx - ax, 2) + pow(by_ - ay, 2) AS DOUBLE))) AS t FROM catalog, {EDGES})) GROUP BY event_id, x_km, y_km) GROUP BY 1""")


@query
def polygon_grid(spark: SparkSession, d: str) -> DataFrame:
    """Cells of 100 km that the polygon meets; tested against sampled points."""
    return study.clipped_cells(spark, study.area_of(HEXAGON, project=False), 100.0).select("cell_id", "area_km2", "x_km", "y_km", "whole")


# --- horizons ------------------------------------------------------------------------------------------------------

RATE, DELAYS = 20.0, (0.0, 1.0, 7.0)


def exposures(spark: SparkSession) -> DataFrame:
    days = F.array(*[F.lit(FIRST_DAY + x) for x in range(5, 20)])
    plans = F.array(*[F.struct(F.lit(h).alias("horizon"), sequences.greedy_exposures(days, h).alias("days")) for h in (7.0, 14.0)])
    return spark.range(1).select(F.explode(plans).alias("x")).select("x.horizon", F.explode("x.days").alias("issue_day"))


def horizon_scores(spark: SparkSession, d: str) -> DataFrame:
    events, training = catalog(spark, d), kde_training(spark, d)
    norms = normalisers(poisson.kde_cell_masses(training, grid.cell_array(CELLS)))
    aimed = events.filter(F.col("inside_study_area") & (F.col("magnitude") >= SPEC.mc) & (F.col("origin_day") > FIRST_DAY + 5))
    density = poisson.kde_log_densities(aimed, training, norms).filter("h = 150").select("event_id", "log_density")
    return horizons.backtest(events, exposures(spark), DELAYS, SPEC.mc, RATE, AREA, density, study_cells(spark), SPEC, PARAMETERS)


@query
def horizon_models(spark: SparkSession, d: str) -> DataFrame:
    """Every delay, horizon and issue under three models."""
    out = horizon_scores(spark, d)
    return out.select("delay", "horizon", F.col("issue_day").cast("int").alias("issue_day"), "model", "n", F.round("compensator", 6).alias("compensator"), F.round("log_likelihood", 5).alias("log_likelihood"))


@query
def horizon_comparisons(spark: SparkSession, d: str) -> DataFrame:
    out = horizons.comparisons(horizon_scores(spark, d))
    return out.select("delay", "horizon", "model", "exposures", "events", F.round("gain", 6).alias("gain"), "unpaired")


HORIZONS = [
    *KDE[:5], ETAS[0], "expo AS (SELECT CAST(h AS DOUBLE) AS horizon, CAST(19728 + k AS DOUBLE) AS issue_day FROM (VALUES (7), (14)) AS v(h), range(0, 15) AS r(k) WHERE k % h = 0)",
    "delays AS (SELECT * FROM (VALUES (CAST(0 AS DOUBLE)), (1), (7)) AS v(delay))",
    "held AS (SELECT horizon, issue_day, c.* FROM expo JOIN catalog c ON inside_study_area AND magnitude >= 4.5 AND origin_day > issue_day AND origin_day <= issue_day + horizon)",
    """ld AS (SELECT q.event_id, ln(avg(exp(-(pow(q.x_km - t.x_km, 2) + pow(q.y_km - t.y_km, 2)) / 45000.0) / (45000.0 * pi())) / any_value(z)) AS ld FROM (SELECT DISTINCT event_id, x_km, y_km FROM held) q, train t, norm WHERE h = 150 GROUP BY 1)""",
    f"""excited AS (SELECT delay, horizon, issue_day, event_id, sum({TRIGGER}) AS x FROM (SELECT delay, horizon, issue_day, t.event_id, p.magnitude AS m, t.origin_day - p.origin_day AS dt, sqrt(pow(t.x_km - p.x_km, 2) + pow(t.y_km - p.y_km, 2)) AS r
      FROM delays, held t JOIN parents p ON p.origin_day < t.origin_day AND t.origin_day - p.origin_day <= 5 AND p.origin_day > issue_day - 5 WHERE p.available_day + delay <= t.origin_day) WHERE r <= 300 GROUP BY 1, 2, 3, 4)""",
    f"""weights AS (SELECT event_id, sum(CASE WHEN r <= 300 THEN {POWER.format(s='(25.0 * exp(magnitude - 4.5))', r='r')} ELSE 0 END * area) AS w FROM (SELECT event_id, magnitude, area, sqrt(pow(x_km - cx, 2) + pow(y_km - cy, 2)) AS r FROM parents, g) GROUP BY 1)""",
    """spent AS (SELECT delay, horizon, issue_day, sum(0.2 * exp(magnitude - 4.5) * (pow(1 + lower / 0.05, CAST(-0.2 AS DOUBLE)) - pow(1 + upper / 0.05, CAST(-0.2 AS DOUBLE))) * w) AS x FROM (
      SELECT delay, horizon, issue_day, event_id, magnitude, greatest(greatest(issue_day, available_day + delay) - origin_day, 0) AS lower, least(CAST(5 AS DOUBLE), issue_day + horizon - origin_day) AS upper
      FROM delays, expo, parents WHERE origin_day > issue_day - 5 AND origin_day <= issue_day + horizon) JOIN weights USING (event_id) WHERE upper > lower GROUP BY 1, 2, 3)""",
    """scored AS (SELECT delay, horizon, issue_day, 'uniform' AS model, count(event_id) AS n, 20 * horizon AS compensator, count(event_id) * ln(20 / CAST(960000 AS DOUBLE)) AS logs FROM delays, expo LEFT JOIN held USING (horizon, issue_day) GROUP BY 1, 2, 3
      UNION ALL SELECT delay, horizon, issue_day, 'spatial', count(event_id), 20 * horizon, coalesce(sum(ld + ln(20)), 0) FROM delays, expo LEFT JOIN (held JOIN ld USING (event_id)) USING (horizon, issue_day) GROUP BY 1, 2, 3
      UNION ALL SELECT delay, horizon, issue_day, 'etas', n, 20 * horizon + coalesce(x, 0), logs FROM (
        SELECT e.delay, e.horizon, e.issue_day, count(k.event_id) AS n, coalesce(sum(ln(20 * exp(k.ld) + coalesce(x.x, 0))), 0) AS logs FROM (SELECT * FROM delays, expo) e
        LEFT JOIN (SELECT horizon, issue_day, event_id, ld FROM held JOIN ld USING (event_id)) k ON k.horizon = e.horizon AND k.issue_day = e.issue_day
        LEFT JOIN excited x ON x.delay = e.delay AND x.horizon = e.horizon AND x.issue_day = e.issue_day AND x.event_id = k.event_id GROUP BY 1, 2, 3) LEFT JOIN spent USING (delay, horizon, issue_day))""",
]
sql("horizon_models", "SELECT delay, horizon, CAST(issue_day AS INTEGER) AS issue_day, model, n, round(compensator, 6) AS compensator, round(logs - compensator, 5) AS log_likelihood FROM scored", *HORIZONS)
sql("horizon_comparisons", """SELECT s.delay, s.horizon, s.model, count(*) AS exposures, CAST(sum(s.n) AS BIGINT) AS events, round(sum(s.logs - s.compensator - u.logs + u.compensator) / nullif(sum(s.n), 0), 6) AS gain, CAST(0 AS BIGINT) AS unpaired
  FROM scored s JOIN scored u ON u.model = 'uniform' AND s.model <> 'uniform' AND u.delay = s.delay AND u.horizon = s.horizon AND u.issue_day = s.issue_day GROUP BY 1, 2, 3""", *HORIZONS)

# --- fault maps ----------------------------------------------------------------------------------------------------


@query
def fault_segments(spark: SparkSession, d: str) -> DataFrame:
    """Orders as faults whose line items are points: what is wrong with segments, and what the good ones hold."""
    key = [F.col("l_orderkey").alias("fault_id"), F.lit(1).alias("segment_number")]
    name = lambda c: F.concat(F.lit("F"), (F.col(c) % 7).cast("string"))
    points = table(spark, d, "lineitem").select(*key, F.col("l_linenumber").alias("point_number"), name("l_orderkey").alias("fault_name"), F.lit("S").alias("segment_name"), (100 + (F.col("l_partkey") % 5) / 10.0).alias("longitude"), (30 + (F.col("l_suppkey") % 2) / 10.0).alias("latitude"), (F.col("l_orderkey") % 2 == 0).alias("is_new"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("fault_id"), F.lit(1).alias("segment_number"), name("o_orderkey").alias("fault_name"), F.lit("S").alias("segment_name"))
    attributes = orders.filter("fault_id % 10 <> 3").withColumns({"recurrence_years": F.when(F.col("fault_id") % 4 > 0, 100.0), "last_year": (1900 + F.col("fault_id") % 100).cast("int")})
    hazards = orders.filter("fault_id % 10 <> 7").withColumn("fault_name", F.when(F.col("fault_id") % 11 == 0, "other").otherwise(F.col("fault_name")))
    out = faultmaps.segments(points, attributes, hazards, 2024)
    return out.groupBy("fault").agg(F.count("*").alias("n"), F.sum("raw_point_count").alias("points"), F.sum(F.when(F.col("raw_point_count").isNotNull(), F.col("geometry_point_count"))).cast("long").alias("kept"), F.round(F.sum("elapsed_ratio"), 6).alias("ratios"))


ORACLES["fault_segments"] = """WITH raw AS (SELECT l_orderkey AS id, l_linenumber AS p, 100 + (l_partkey % 5) / CAST(10 AS DOUBLE) AS x, 30 + (l_suppkey % 2) / CAST(10 AS DOUBLE) AS y FROM lineitem),
walk AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM raw WINDOW w AS (PARTITION BY id ORDER BY p, x, y)),
g AS (SELECT id, count(*) AS points, count(DISTINCT p) AS numbers, min(p) AS first, max(p) AS last, count(DISTINCT (x, y)) AS places, count(*) FILTER (px IS NULL OR px <> x OR py <> y) AS kept FROM walk GROUP BY id),
met AS (SELECT coalesce(g.id, o_orderkey) AS id, points, numbers, first, last, places, kept, o_orderkey AS o FROM g FULL JOIN orders ON g.id = o_orderkey),
judged AS (SELECT *, CASE WHEN points IS NULL THEN 'no_points' WHEN o IS NULL OR id % 10 = 3 THEN 'no_attributes' WHEN id % 10 = 7 THEN 'no_hazards' WHEN first <> 1 OR last <> points OR numbers <> points THEN 'point_numbers'
  WHEN id % 11 = 0 THEN 'names_differ_across' WHEN places < 2 THEN 'one_place' END AS fault FROM met)
SELECT fault, count(*) AS n, CAST(sum(points) AS BIGINT) AS points, CAST(sum(kept) AS BIGINT) AS kept, round(sum(CASE WHEN o IS NOT NULL AND id % 10 <> 3 AND id % 4 > 0 THEN (2024 - (1900 + id % 100)) / CAST(100 AS DOUBLE) END), 6) AS ratios FROM judged
WHERE points IS NOT NULL OR id % 10 <> 3 OR id % 10 <> 7 GROUP BY 1"""


@query
def duplicate_lines(spark: SparkSession, d: str) -> DataFrame:
    """Line items as lines of two vertices, in either direction."""
    vertex = lambda a, b: F.concat(F.col(a).cast("string"), F.lit(","), (F.col(b) % 3).cast("string"))
    lines = table(spark, d, "lineitem").select("l_returnflag", F.array(vertex("l_suppkey", "l_linenumber"), vertex("l_partkey", "l_orderkey")).alias("line"))
    return faultmaps.with_duplicates(lines, F.col("line"), "l_returnflag").groupBy("duplicate_geometry", "duplicate_name_conflict").agg(F.count("*").alias("n"), F.count_distinct("duplicate_group_id").alias("groups"))


ORACLES["duplicate_lines"] = """SELECT duplicate_geometry, duplicate_name_conflict, count(*) AS n, count(DISTINCT CASE WHEN duplicate_geometry THEN k END) AS groups FROM (
  SELECT k, count(*) OVER (PARTITION BY k) > 1 AS duplicate_geometry, min(l_returnflag) OVER (PARTITION BY k) <> max(l_returnflag) OVER (PARTITION BY k) AS duplicate_name_conflict FROM (
    SELECT l_returnflag, least(a || ';' || b, b || ';' || a) AS k FROM (SELECT l_returnflag, l_suppkey || ',' || l_linenumber % 3 AS a, l_partkey || ',' || l_orderkey % 3 AS b FROM lineitem))) GROUP BY 1, 2"""

# --- anomaly reports -----------------------------------------------------------------------------------------------


def report_rows(spark: SparkSession, d: str) -> DataFrame:
    """Events as lines of weekly reports in both layouts."""
    e = table(spark, d, "events").select("event_id", "user_id", F.to_date("ts").alias("day"))
    period = (F.floor((F.dayofyear("day") - 1) / 7) + 1).cast("int")
    e = e.withColumn("period", period).withColumn("report", F.date_add(F.lit("2024-01-01").cast("date"), F.col("period") * 7))
    i = F.col("event_id")
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    cells = {
        "序号": F.lit("1"), "报告日期": text(F.date_add("report", (i % 3 - 1).cast("int"))), "单位": F.concat(F.lit("U"), (F.col("user_id") % 5).cast("string")), "经度": (100 + F.col("user_id") % 30).cast("string"),
        "纬度": (30 + F.col("user_id") % 10).cast("string"), "分量名": F.when(i % 11 > 0, F.concat(F.lit("m"), (i % 4).cast("string"))), "异常是否结束": F.when(i % 5 > 0, anomalies.END_FLAGS[0]).otherwise(anomalies.END_FLAGS[1]),
        "异常起始时间": text("day"), "异常结束时间": F.when(i % 3 > 0, text(F.date_add("day", (i % 40 - 10).cast("int")))), "异常持续时间": F.when(i % 6 == 0, "3"), "其它说明": F.when(i % 13 == 0, "x"),
        "新增_持续_取消": F.element_at(F.array(*map(F.lit, anomalies.STATES)), (i % 3 + 1).cast("int")),
    }
    station = F.when(i % 7 > 0, F.concat(F.lit("s"), F.col("user_id").cast("string")))
    sheet = F.element_at(F.array(*map(F.lit, anomalies.SHEETS)), (i % 4 + 1).cast("int"))
    layout = lambda names, own: F.array(*[own.get(n, cells.get(n, F.lit(None))).cast("string") for n in names])
    common = layout(anomalies.COMMON, {"台站": station, "学科": F.col("sheet"), "测点编号": F.lit("p")})
    cross = layout(anomalies.CROSS_FAULT, {"场地": station, "手段": F.lit("p"), "趋势性异常时间": F.lit("2024")})
    name = F.format_string("in/异常零数据All2024%02d期周报-修改-%s.XLS", F.col("period"), F.date_format("report", "yyyyMMdd"))
    rows = e.withColumns({"sheet": sheet, "file": name})
    return rows.select("file", F.lit("00").alias("sha256"), "sheet", F.col("event_id").alias("source_row"), F.when(F.col("sheet") == anomalies.SHEETS[3], cross).otherwise(common).alias("cells"))


@query
def anomaly_flags(spark: SparkSession, d: str) -> DataFrame:
    found = anomalies.observations(report_rows(spark, d))
    each = found.select(F.explode_outer("quality_flags").alias("flag")).filter("flag is not null")  # an inner one is planned with a filter that works out all flags a second time, each cell anew
    return each.groupBy("flag").agg(F.count("*").alias("n"))


@query
def anomaly_quality(spark: SparkSession, d: str) -> DataFrame:
    return anomalies.quality(anomalies.observations(report_rows(spark, d))).select("rows", "faults", "files", "stations", "anomalies", "right_censored", "first_report", "last_report", "first_start")


@query
def anomaly_periods(spark: SparkSession, d: str) -> DataFrame:
    out = anomalies.period_table(anomalies.observations(report_rows(spark, d)), "weekly")
    return out.select("report_period", "report_date", "row_count", "row_report_date_mismatch_count", "row_report_date_before_count", "row_report_date_after_count", "deformation_row_count", "fluid_row_count", "electromagnetic_row_count", "cross_fault_row_count")


@query
def anomaly_audit(spark: SparkSession, d: str) -> DataFrame:
    """Anomalies to look at again, by kind."""
    return anomalies.entity_audit(anomalies.observations(report_rows(spark, d))).groupBy("audit_type").agg(F.count("*").alias("n"))


@query
def anomaly_missing_periods(spark: SparkSession, d: str) -> DataFrame:
    """Periods that are gone when the files of every third are."""
    there = anomalies.periods(anomalies.observations(report_rows(spark, d))).filter("report_period % 3 <> 2")
    return anomalies.missing_periods(there)


REPORTS = """e AS (SELECT event_id AS i, user_id AS u, CAST(ts AS DATE) AS start, CAST(floor((dayofyear(CAST(ts AS DATE)) - 1) / 7) + 1 AS INTEGER) AS period FROM events),
r AS (SELECT *, DATE '2024-01-01' + period * 7 AS report, CASE WHEN i % 3 > 0 THEN start + CAST(i % 40 - 10 AS INTEGER) END AS fin, i % 4 = 3 AS crossed FROM e),
a AS (SELECT *, report + CAST(i % 3 - 1 AS INTEGER) AS own, greatest(report, report + CAST(i % 3 - 1 AS INTEGER)) AS known FROM r)"""
MARKS = {
    "row_report_date_mismatch_source": "i % 3 <> 1", "row_report_date_before_source": "i % 3 = 0", "row_report_date_after_source": "i % 3 = 2", "available_at_conservatively_delayed": "i % 3 = 2",
    "missing_station_name": "i % 7 = 0", "missing_measurement": "i % 11 = 0", "identity_incomplete": "i % 7 = 0 OR i % 11 = 0", "entity_unresolved": "i % 7 = 0 OR i % 11 = 0", "future_reported_end_time": "fin > report",
    "end_after_raw_row_report_date": "fin > own", "end_before_start": "fin < start", "listed_after_reported_end": "fin < report", "start_after_report_date": "start > known", "end_flag_inconsistent": "(i % 5 > 0) <> (fin IS NOT NULL)",
    "cancel_without_end_time": "i % 3 = 2 AND fin IS NULL", "continued_with_end_time": "i % 3 = 1 AND fin IS NOT NULL", "new_with_end_time": "i % 3 = 0 AND fin IS NOT NULL", "cross_fault_trend_field_is_period": "crossed",
    "source_duration_ignored": "i % 6 = 0", "manual_prediction_fields_present": "i % 13 = 0", "manual_prediction_fields_excluded": "true", "anomaly_time_date_only_assumed_fixed_utc_plus_08_midnight": "true",
}
ORACLES["anomaly_flags"] = f"WITH {REPORTS} SELECT flag, n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS flag, count(*) FILTER ({c}) AS n FROM a" for k, c in MARKS.items()) + ") WHERE n > 0"
ORACLES["anomaly_periods"] = f"""WITH {REPORTS} SELECT CAST(period AS INTEGER) AS report_period, report AS report_date, count(*) AS row_count, count(*) FILTER (own <> report) AS row_report_date_mismatch_count, count(*) FILTER (own < report) AS row_report_date_before_count,
count(*) FILTER (own > report) AS row_report_date_after_count, count(*) FILTER (i % 4 = 0) AS deformation_row_count, count(*) FILTER (i % 4 = 1) AS fluid_row_count, count(*) FILTER (i % 4 = 2) AS electromagnetic_row_count, count(*) FILTER (crossed) AS cross_fault_row_count FROM a GROUP BY 1, 2"""
ORACLES["anomaly_quality"] = f"""WITH {REPORTS}, placed AS (SELECT *, CASE WHEN i % 7 > 0 THEN concat_ws('|', u % 5, u, u % 30, u % 10) ELSE 'row' || i END AS station, CASE i % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE 'd' END AS discipline FROM a)
SELECT count(*) AS rows, CAST(0 AS BIGINT) AS faults, count(DISTINCT period) AS files, count(DISTINCT station) AS stations, count(DISTINCT CASE WHEN i % 7 = 0 OR i % 11 = 0 THEN 'row' || i ELSE concat_ws('|', station, discipline, i % 4, start) END) AS anomalies,
count(*) FILTER (fin IS NULL OR fin > known) AS right_censored, min(report) AS first_report, max(report) AS last_report, min(start) AS first_start FROM placed"""
ORACLES["anomaly_missing_periods"] = f"""WITH {REPORTS}, p AS (SELECT DISTINCT period FROM a WHERE period % 3 <> 2), w AS (SELECT CAST(unnest(range(min(period), max(period) + 1)) AS INTEGER) AS period FROM p)
SELECT CAST(2024 AS INTEGER) AS report_year, period AS report_period, DATE '2024-01-01' + period * 7 AS expected_report_date FROM w WHERE period NOT IN (SELECT period FROM p)"""
