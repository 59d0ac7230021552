"""SQL for DuckDB of the queries in catalogue.py that SQL can express."""

from __future__ import annotations

from tremora.plans.view import CATALOG_SQL

ORACLES: dict[str, str] = {}
#: Candidate magnitudes and estimates, as SQL expressions.
CANDIDATE = "CASE WHEN {0} <= 3.0 + 1e-12 THEN 3.0 WHEN {0} <= 3.2 + 1e-12 THEN 3.2 WHEN {0} <= 3.5 + 1e-12 THEN 3.5 WHEN {0} <= 4.0 + 1e-12 THEN 4.0 END"
LOG10E = "0.4342944819032518"


def sql(name: str, body: str, *views: str) -> None:
    """Registers a query whose WITH list starts with the catalogue view."""
    ORACLES[name] = "WITH RECURSIVE " + ",\n".join([CATALOG_SQL, *views]) + "\n" + body


def stratum(name: str, events: str, by: str) -> str:
    """Views for the estimates of groups ``by`` of a view of events: <name> has peak, n, estimate, candidate, n_complete, b."""
    using = f"USING ({by})" if by else "ON true"
    g = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""{name}_h AS (SELECT {g}CAST(round(CAST(magnitude AS DECIMAL(12,4)), 1) AS DOUBLE) AS bin, count(*) AS n FROM {events} GROUP BY ALL),
{name}_p AS (SELECT {g}max(n) AS peak_n, arg_max(bin, n * 1000.0 + bin) AS peak, CAST(sum(n) AS BIGINT) AS n FROM {name}_h {group}),
{name}_e AS (SELECT *, round(peak + 0.2, 1) AS estimate FROM {name}_p),
{name}_c AS (SELECT *, {CANDIDATE.format('estimate')} AS candidate FROM {name}_e),
{name}_k AS (SELECT {g.replace(by, 'e.' + by) if by else ''}count(*) AS n_complete, avg(magnitude) AS mean, any_value(candidate) AS mc FROM {events} e JOIN {name}_c c {using} WHERE magnitude >= candidate - 1e-12 {('GROUP BY e.' + by) if by else ''}),
{name} AS (SELECT c.*, k.n_complete, {LOG10E} / (k.mean - (k.mc - 0.05)) AS b FROM {name}_c c LEFT JOIN {name}_k k {using})"""


sql("catalog_scan", "SELECT event_id, origin_day, available_day, magnitude, inside_study_area, inside_external_buffer FROM catalog WHERE origin_day <= 19743 AND available_day <= 19743")
sql("catalog_eligible", "SELECT source, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM catalog WHERE available_day <= 19743 AND magnitude >= 3.2 AND (inside_study_area OR inside_external_buffer) GROUP BY source")
sql("event_mask", "SELECT event_id, magnitude FROM catalog WHERE available_day <= 19741 AND magnitude >= 3.2 AND inside_external_buffer AND origin_day > 19730 AND origin_day <= 19740")
sql("target_mask", "SELECT event_id, magnitude, available_day FROM catalog WHERE inside_study_area AND magnitude >= 3.2 AND origin_day > 19730 AND origin_day <= 19740")
sql("training_mask", "SELECT event_id, magnitude FROM catalog WHERE inside_study_area AND magnitude >= 3.2 AND available_day <= 19735 AND origin_day >= 19725 AND origin_day <= 19735")
sql("exclusion_audit", """SELECT CASE WHEN NOT inside_study_area THEN 'outside' WHEN origin_day < 19725 THEN 'before_start' WHEN origin_day > 19745 THEN 'future_origin'
  WHEN available_day > 19745 THEN 'unavailable' ELSE 'included' END AS reason, count(*) AS n FROM catalog GROUP BY 1""")
sql("delay_sensitivity", "SELECT delay, count(*) AS n, max(event_id) AS last_id FROM catalog, (VALUES (CAST(0 AS DOUBLE)), (1), (7)) AS v(delay) WHERE available_day + delay <= 19743 GROUP BY delay")
sql("issue_history", """SELECT issue_day, count(*) AS n, max(magnitude) AS greatest FROM catalog, (VALUES (CAST(19728 AS DOUBLE)), (19733), (19738), (19743), (19748)) AS v(issue_day)
  WHERE inside_external_buffer AND magnitude >= 3.2 AND origin_day >= issue_day - 8 AND origin_day <= issue_day AND available_day <= issue_day GROUP BY issue_day""")
sql("domain_classes", "SELECT CASE WHEN inside_study_area THEN 'study' WHEN inside_external_buffer THEN 'buffer' ELSE 'outside' END AS domain, count(*) AS n FROM catalog GROUP BY 1")
sql("leakage_counts", """SELECT rule, CAST(violations AS BIGINT) AS violations FROM (
  SELECT 'available_before_origin' AS rule, count(*) FILTER (available_day < origin_day) AS violations FROM catalog UNION ALL
  SELECT 'history_not_yet_available', count(*) FILTER (available_day > 19743 AND origin_day <= 19743) FROM catalog UNION ALL
  SELECT 'inside_but_not_in_buffer', count(*) FILTER (inside_study_area AND NOT inside_external_buffer) FROM catalog UNION ALL
  SELECT 'magnitude_below_bin', count(*) FILTER (magnitude < 2.95) FROM catalog UNION ALL
  SELECT 'optimistic_availability', count(*) FILTER (available_day = origin_day) FROM catalog UNION ALL
  SELECT 'source_unknown', count(*) FILTER (source NOT IN ('m3', 'm5')) FROM catalog)""")
sql("quality_summary", """SELECT source, count(*) AS n, count(*) FILTER (inside_study_area) AS inside, count(*) FILTER (available_day > origin_day) AS delayed,
  round(min(origin_day), 6) AS first_day, round(max(origin_day), 6) AS last_day, min(magnitude) AS least, max(magnitude) AS greatest FROM catalog GROUP BY source""")
ORACLES["null_audit"] = """SELECT concat_ws(',', CASE WHEN event_type = 'error' THEN 'kind' END, CASE WHEN user_id % 7 = 0 THEN 'user_id' END, CASE WHEN value < 5 THEN 'value' END) AS missing, count(*) AS n
FROM events GROUP BY 1"""

sql("maxc_histogram", "SELECT CAST(round(CAST(magnitude AS DECIMAL(12,4)), 1) AS DOUBLE) AS bin, count(*) AS n FROM catalog GROUP BY 1")
sql("maxc_estimate", "SELECT peak, peak_n, n, estimate, CAST(candidate AS DOUBLE) AS candidate FROM s", stratum("s", "catalog", ""))
sql("aki_b", "SELECT CAST(candidate AS DOUBLE) AS mc, n_complete, round(b, 9) AS b FROM s", stratum("s", "catalog", ""))
sql("magnitude_sensitivity", f"SELECT mc, count(*) AS n, round({LOG10E} / (avg(magnitude) - (mc - 0.05)), 9) AS b FROM catalog, (VALUES (CAST(3.0 AS DOUBLE)), (3.2), (3.5), (4.0)) AS v(mc) WHERE magnitude >= mc - 1e-12 GROUP BY mc")
BLOCKS = ["blocked AS (SELECT *, CAST(least(floor((origin_day - 19723) / 7.0), 4) AS INTEGER) AS block FROM catalog WHERE inside_study_area AND origin_day >= 19723 AND origin_day <= 19754)", stratum("s", "blocked", "block"), "t AS (SELECT *, least(CAST(19754 AS DOUBLE), 19723 + (block + 1) * 7.0) - (19723 + block * 7.0) AS days FROM s)"]
sql("temporal_blocks", "SELECT block, n, peak, estimate, CAST(candidate AS DOUBLE) AS candidate, n_complete, round(b, 9) AS b, CAST(days AS DOUBLE) AS days, n >= 200 AND days >= 4 AS eligible FROM t", *BLOCKS)
sql("regime_change", """SELECT block, round(mc_change, 6) AS mc_change, round(rate_ratio, 9) AS rate_ratio,
  coalesce(abs(mc_change) >= 0.2 OR rate_ratio >= 1.5 OR rate_ratio <= 1 / CAST(1.5 AS DOUBLE), false) AS changed
  FROM (SELECT block, estimate - lag(estimate) OVER w AS mc_change, (n / CAST(days AS DOUBLE)) / lag(n / CAST(days AS DOUBLE)) OVER w AS rate_ratio FROM t WINDOW w AS (ORDER BY block))""", *BLOCKS)
sql("completeness_gate", f"""SELECT greatest, strata, CAST({CANDIDATE.format('greatest')} AS DOUBLE) AS mc, CASE WHEN greatest IS NULL THEN 'no_eligible_stratum' WHEN greatest > 4 THEN 'completeness_above_limit' ELSE 'ok' END AS status
  FROM (SELECT max(estimate) AS greatest, count(*) AS strata FROM t WHERE n >= 200 AND days >= 4)""", *BLOCKS)
sql("snapshot_completeness", "SELECT cutoff, n, peak, estimate, CAST(candidate AS DOUBLE) AS candidate, n_complete, round(b, 9) AS b FROM s",
    "seen AS (SELECT * FROM catalog, (VALUES (CAST(19730 AS DOUBLE)), (19737), (19744), (19751)) AS v(cutoff) WHERE inside_study_area AND origin_day <= cutoff AND available_day <= cutoff)", stratum("s", "seen", "cutoff"))
CELL = "CAST(floor(x_km / {0}) AS INTEGER) AS {1}, CAST(floor(y_km / {0}) AS INTEGER) AS {2}"
SPARSE = f"""fine AS (SELECT {CELL.format(200, 'cx', 'cy')}, count(*) AS n FROM catalog WHERE inside_study_area GROUP BY 1, 2),
parents AS (SELECT {CELL.format(400, 'px', 'py')}, count(*) AS parent_n FROM catalog WHERE inside_study_area GROUP BY 1, 2)"""
sql("sparse_parent_resolution", """SELECT cx, cy, n, px, py, parent_n FROM (SELECT *, CAST(floor(cx / 2.0) AS INTEGER) AS px, CAST(floor(cy / 2.0) AS INTEGER) AS py FROM fine WHERE n < 250) JOIN parents USING (px, py)""", SPARSE)


def spatial(size: int, name: str) -> str:
    return f"""{name}_h AS (SELECT {CELL.format(size, 'cx', 'cy')}, magnitude AS bin, count(*) AS n FROM catalog WHERE inside_study_area GROUP BY 1, 2, 3),
{name} AS (SELECT cx, cy, CAST(sum(n) AS BIGINT) AS n, arg_max(bin, n * 1000.0 + bin) AS peak FROM {name}_h GROUP BY cx, cy)"""


sql("spatial_strata", """SELECT cx, cy, 'cell' AS level, n, peak, round(peak + 0.2, 1) AS estimate FROM small WHERE n >= 250 UNION ALL
  SELECT cx, cy, 'parent', n, peak, round(peak + 0.2, 1) FROM large WHERE (cx, cy) IN (SELECT (CAST(floor(cx / 2.0) AS INTEGER), CAST(floor(cy / 2.0) AS INTEGER)) FROM small WHERE n < 250)""", spatial(200, "small"), spatial(400, "large"))

PAIRS = """pairs AS (SELECT * FROM (SELECT l.event_id AS l_event_id, r.event_id AS r_event_id, round(abs(l.origin_day - r.origin_day) * 86400, 3) AS seconds,
    sqrt(pow(l.x_km - r.x_km, 2) + pow(l.y_km - r.y_km, 2)) AS km, round(abs(l.magnitude - r.magnitude), 6) AS dm
  FROM catalog l JOIN catalog r ON l.source = 'm3' AND r.source = 'm5' AND abs(l.origin_day - r.origin_day) <= CAST(7200.0 AS DOUBLE) / 86400.0) WHERE km <= 60 AND dm <= 0.5),
tagged AS (SELECT *, seconds <= 3600 AND km <= 40 AND dm <= 0.2 AS auto FROM pairs),
degrees AS (SELECT *, count(*) OVER (PARTITION BY l_event_id) AS ld, count(*) OVER (PARTITION BY r_event_id) AS rd FROM tagged WHERE auto),
kept AS (SELECT l_event_id, r_event_id FROM degrees WHERE ld = 1 AND rd = 1)"""
sql("dedup_candidates", "SELECT l_event_id, r_event_id, round(seconds, 1) AS seconds, round(km, 6) AS km, dm, auto FROM tagged", PAIRS)
sql("dedup_accepted", "SELECT l_event_id, r_event_id FROM kept", PAIRS)
sql("dedup_classified", "SELECT CASE WHEN k.l_event_id IS NOT NULL THEN 'merged' WHEN auto THEN 'ambiguous' ELSE 'review' END AS status, count(*) AS n FROM tagged LEFT JOIN kept k USING (l_event_id, r_event_id) GROUP BY 1", PAIRS)
sql("dedup_status", """SELECT CASE WHEN best = 1 THEN 'merged' WHEN best = 2 THEN 'ambiguous' WHEN best = 3 THEN 'review' WHEN copy > 1 THEN 'exact_duplicate' ELSE 'unmatched' END AS status, count(*) AS n FROM
  (SELECT event_id, row_number() OVER (PARTITION BY origin_day, x_km, y_km, magnitude ORDER BY event_id) AS copy FROM catalog WHERE source = 'm3') LEFT JOIN
  (SELECT t.l_event_id AS event_id, min(CASE WHEN k.l_event_id IS NOT NULL THEN 1 WHEN auto THEN 2 ELSE 3 END) AS best FROM tagged t LEFT JOIN kept k USING (l_event_id, r_event_id) GROUP BY 1) USING (event_id) GROUP BY 1""", PAIRS)
sql("dedup_events", """SELECT event_id, magnitude, CASE WHEN event_id IN (SELECT r_event_id FROM kept) THEN 'm3+m5' ELSE source END AS sources FROM catalog WHERE event_id NOT IN (SELECT l_event_id FROM kept)""", PAIRS)
ORACLES["exact_duplicates"] = "SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, count(*) AS n, min(o_orderkey) AS first_key FROM orders GROUP BY 1, 2 HAVING count(*) > 1"
ORACLES["duplicate_ordinal"] = """SELECT event_id, CAST(row_number() OVER (w ORDER BY event_id) AS INTEGER) AS ordinal, count(*) OVER w AS group_size FROM events
WINDOW w AS (PARTITION BY user_id, event_type, CAST(ts AS DATE)) QUALIFY group_size > 1"""
ORACLES["end_time_revisions"] = """SELECT event_id, coalesce(before IS NOT NULL AND finish IS NULL, false) AS retracted, coalesce(finish IS NOT NULL AND recent IS NOT NULL AND finish <> recent, false) AS revised FROM (
  SELECT event_id, finish, lag(finish) OVER w AS before, last_value(finish IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS recent
  FROM (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 > 0 THEN CAST(floor(value) AS BIGINT) END AS finish FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
ORACLES["key_join_strict"] = "SELECT n_nationkey AS key, n_name, r_name, CASE WHEN n_name IS DISTINCT FROM r_name THEN 'differs' END AS fault FROM nation JOIN region ON n_nationkey = r_regionkey"
ORACLES["key_set_difference"] = """WITH f AS (SELECT o_orderkey AS key FROM orders WHERE o_orderstatus = 'F'), r AS (SELECT l_orderkey AS key FROM lineitem WHERE l_returnflag = 'R')
SELECT key, 'left' AS side FROM (SELECT key FROM f EXCEPT SELECT key FROM r) UNION ALL SELECT key, 'right' FROM (SELECT key FROM r EXCEPT SELECT key FROM f)"""
ORACLES["crosswalk_two_tier"] = """WITH s AS (SELECT n_nationkey, n_name AS name, substr(n_name, 1, 2) AS loose FROM nation),
t AS (SELECT n_nationkey + 100 AS trace, CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE substr(n_name, 1, 2) || 'X' END AS name, substr(n_name, 1, 2) AS loose FROM nation WHERE n_nationkey < 20),
x AS (SELECT n_nationkey, trace, 'exact' AS tier FROM s JOIN t USING (name)),
y AS (SELECT n_nationkey, trace, 'loose' AS tier FROM s JOIN t USING (loose) WHERE trace NOT IN (SELECT trace FROM x)),
a AS (SELECT * FROM x UNION ALL SELECT * FROM y)
SELECT n_nationkey, trace, coalesce(tier, 'unmatched') AS tier FROM s LEFT JOIN a USING (n_nationkey)"""
sql("parent_windows", """SELECT event_id, round(lower, 6) AS lower, round(upper, 6) AS upper FROM (SELECT event_id, greatest(greatest(CAST(19733 AS DOUBLE), available_day) - origin_day, 0) AS lower, least(CAST(5 AS DOUBLE), 19743 - origin_day) AS upper FROM catalog) WHERE upper > lower""")
ORACLES["missing_periods"] = """WITH p AS (SELECT DISTINCT user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS period FROM events),
w AS (SELECT user_id, CAST(unnest(range(min(period), max(period) + 1)) AS INTEGER) AS period FROM p GROUP BY user_id),
m AS (SELECT * FROM w WHERE (user_id, period) NOT IN (SELECT (user_id, period) FROM p))
SELECT m.user_id, m.period, arg_min(p.period, abs(p.period - m.period) * 1000 + p.period) AS nearest FROM m JOIN p USING (user_id) GROUP BY 1, 2"""
ORACLES["greedy_exposures"] = """WITH RECURSIVE p AS (SELECT DISTINCT user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS day FROM events),
g AS (SELECT user_id, min(day) AS day FROM p GROUP BY user_id UNION ALL
  SELECT user_id, day FROM (SELECT g.user_id, (SELECT min(p.day) FROM p WHERE p.user_id = g.user_id AND p.day >= g.day + 4) AS day FROM g) WHERE day IS NOT NULL)
SELECT user_id, day FROM g"""
ORACLES["segment_numbers"] = """SELECT user_id, CAST(segment AS BIGINT) AS segment, count(*) AS points FROM (SELECT user_id, event_type, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS segment FROM events)
WHERE event_type <> 'error' GROUP BY 1, 2"""
ORACLES["serial_faults"] = """SELECT l_orderkey, l_linenumber, CAST(place AS INTEGER) AS place FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS place FROM lineitem WHERE l_partkey % 5 > 0) WHERE place <> l_linenumber"""
ORACLES["period_pivot"] = """SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS period, """ + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in ("click", "error", "purchase", "signup", "view")) + ", count(*) AS n FROM events GROUP BY 1"

ID = "printf('g{0:08d}_r%+08d_c%+08d', {1}, {2})"
GRID = """{3} AS (SELECT r AS "row", c AS "column", (x1 - x0) * (y1 - y0) AS area, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM (
  SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, CAST(greatest(c * {0}, -600) AS DOUBLE) AS x0, CAST(least((c + 1) * {0}, 600) AS DOUBLE) AS x1, CAST(greatest(r * {0}, -400) AS DOUBLE) AS y0, CAST(least((r + 1) * {0}, 400) AS DOUBLE) AS y1
  FROM range({1}, -({1})) AS a(c), range({2}, -({2})) AS b(r)))"""
ORACLES["grid_cells"] = "WITH " + GRID.format(250, -3, -2, "g") + f' SELECT {ID.format(250_000_000, chr(34) + "row" + chr(34), chr(34) + "column" + chr(34))} AS cell_id, area AS area_km2, cx AS x_km, cy AS y_km FROM g'
sql("cell_assignment", f"SELECT {ID.format(50_000_000, 'r', 'c')} AS cell_id, count(*) AS n FROM (SELECT {CELL.format(50, 'c', 'r')} FROM catalog WHERE inside_study_area) GROUP BY 1")
sql("fine_to_coarse", 'SELECT CAST(floor(floor(y_km / 50) / 2) AS INTEGER) AS "row", CAST(floor(floor(x_km / 50) / 2) AS INTEGER) AS "column", CAST(count(*) AS DOUBLE) AS value FROM catalog WHERE inside_study_area AND magnitude >= 3.2 GROUP BY 1, 2')
def converges(coarse: str, fine: str, km: float) -> str:
    """One comparison of two grids, views that GRID makes."""
    return f"""SELECT CAST({km} AS DOUBLE) AS coarse_km, CAST({km / 2} AS DOUBLE) AS fine_km, round(abs(tc - tf) / greatest(abs(tf), 1e-12), 9) AS relative_total, round(l1, 9) AS density_l1, abs(tc - tf) / greatest(abs(tf), 1e-12) <= 0.02 AND l1 <= 0.05 AS passed
  FROM (SELECT any_value(tc) AS tc, any_value(tf) AS tf, sum(abs(v / tc - w / tf)) AS l1 FROM (SELECT v, w, sum(v) OVER () AS tc, sum(w) OVER () AS tf FROM
    (SELECT "row", "column", exp(-(cx * cx + cy * cy) / 80000.0) * area AS v FROM {coarse}) JOIN
    (SELECT CAST(floor("row" / 2.0) AS INTEGER) AS "row", CAST(floor("column" / 2.0) AS INTEGER) AS "column", sum(exp(-(cx * cx + cy * cy) / 80000.0) * area) AS w FROM {fine} GROUP BY 1, 2) USING ("row", "column")))"""


ORACLES["grid_convergence"] = "WITH " + ", ".join([GRID.format(50, -12, -8, "g50"), GRID.format(25, -24, -16, "g25"), GRID.format(12.5, -48, -32, "g12")]) + " " + converges("g50", "g25", 50.0) + " UNION ALL " + converges("g25", "g12", 25.0)
RATES = "fine AS (SELECT CAST(floor(y_km / 50) AS INTEGER) AS r, CAST(floor(x_km / 50) AS INTEGER) AS c FROM catalog WHERE inside_study_area AND magnitude >= 3.2)"
sql("grid_filled", 'SELECT coalesce(g."row", pr) AS "row", coalesce(g."column", pc) AS "column", CAST(count(pr) AS DOUBLE) AS value, any_value(area) IS NULL AS orphan FROM g FULL JOIN (SELECT CAST(floor(r / 2.0) AS INTEGER) AS pr, CAST(floor(c / 2.0) AS INTEGER) AS pc FROM fine) ON pr = "row" AND pc = "column" GROUP BY 1, 2', GRID.format(100, -6, -4, "g"), RATES)
sql("cell_lookup", 'SELECT g."row" IS NULL AS missing, count(*) AS n, count(DISTINCT (r, c)) AS cells FROM (SELECT CAST(floor(y_km / 50) AS INTEGER) AS r, CAST(floor(x_km / 50) AS INTEGER) AS c FROM catalog) LEFT JOIN g ON r = g."row" AND c = g."column" GROUP BY 1', GRID.format(50, -12, -8, "g"))

sql("uniform_poisson_score", """SELECT trained, n, round(trained / CAST(20 AS DOUBLE), 9) AS rate, round(n * ln(trained / CAST(20 AS DOUBLE) / 960000.0) - trained / CAST(20 AS DOUBLE) * 11, 6) AS log_likelihood
  FROM (SELECT count(*) FILTER (origin_day <= 19743) AS trained, count(*) FILTER (origin_day > 19743) AS n FROM catalog WHERE inside_study_area AND magnitude >= 3.2)""")
KDE = [GRID.format(100, -6, -4, "g"), "hs AS (SELECT * FROM (VALUES (CAST(75 AS DOUBLE)), (100), (150), (200), (300)) AS v(h))",
       "train AS (SELECT x_km, y_km FROM catalog WHERE inside_study_area AND magnitude >= 5 AND available_day <= 19743 AND origin_day >= 19723 AND origin_day <= 19743)",
       """raw AS (SELECT h, "row", "column", avg(exp(-(pow(x_km - cx, 2) + pow(y_km - cy, 2)) / (2 * h * h)) / (2 * pi() * h * h)) * any_value(area) AS v FROM train, g, hs GROUP BY 1, 2, 3)""",
       "norm AS (SELECT h, sum(v) AS z FROM raw GROUP BY h)",
       """dens AS (SELECT event_id, h, ln(avg(exp(-(pow(q.x_km - t.x_km, 2) + pow(q.y_km - t.y_km, 2)) / (2 * h * h)) / (2 * pi() * h * h)) / any_value(z)) AS ld, any_value(q.origin_day) AS day
         FROM catalog q, train t, norm WHERE q.inside_study_area AND q.magnitude >= 5.5 AND q.origin_day > 19743 GROUP BY 1, 2)""",
       "folds AS (SELECT h, CAST(floor((day - 19743) / 3.0) AS INTEGER) AS fold, avg(ld) - ln(1 / CAST(960000 AS DOUBLE)) AS score, count(*) AS n FROM dens WHERE floor((day - 19743) / 3.0) BETWEEN 0 AND 3 GROUP BY 1, 2)"]
sql("kde_far_density", """SELECT event_id, h, round(ln(sum(exp((least_r2 - r2) / (2 * h * h))) / count(*) / (2 * pi() * h * h) / any_value(z)) - any_value(least_r2) / (2 * h * h), 6) AS log_density FROM
  (SELECT event_id, r2, min(r2) OVER (PARTITION BY event_id) AS least_r2 FROM (SELECT event_id, pow(q.x_km + 4000 - t.x_km, 2) + pow(q.y_km - t.y_km, 2) AS r2 FROM catalog q, train t WHERE q.inside_study_area AND q.magnitude >= 5.5 AND q.origin_day > 19743)), norm GROUP BY 1, 2""", *KDE)
sql("exposure_scores", """SELECT CAST(f AS INTEGER) AS fold, count(ld) AS n, round(coalesce(sum(ld + ln(5)), 0) - 15, 6) AS log_likelihood FROM range(6) AS r(f) LEFT JOIN
  (SELECT ld, floor((day - 19743) / 3.0) AS k FROM dens WHERE h = 150) ON k = f GROUP BY 1""", *KDE)
sql("kde_cell_mass", 'SELECT h, "row", "column", round(v / z, 9) AS mass FROM raw JOIN norm USING (h)', *KDE)
sql("kde_event_log_density", "SELECT event_id, h, round(ld, 8) AS log_density FROM dens", *KDE)
sql("kde_fold_gain", "SELECT h, fold, n, round(score, 8) AS score FROM folds", *KDE)
BEST = """means AS (SELECT h, avg(score) AS mean FROM folds GROUP BY h),
best AS (SELECT h AS bh, mean AS bm FROM means ORDER BY mean DESC, {0} LIMIT 1),
of_best AS (SELECT fold, score AS bs FROM folds, best WHERE h = bh),
paired AS (SELECT h, avg(score) AS mean, coalesce(stddev_samp(score - bs), 0) / sqrt(count(*)) AS se FROM folds JOIN of_best USING (fold) GROUP BY h),
judged AS (SELECT *, mean >= bm - se AS eligible FROM paired, best)"""
sql("kde_bandwidth_select", "SELECT h, round(mean, 8) AS mean, round(se, 8) AS se, eligible, h = (SELECT max(h) FROM judged WHERE eligible) AS selected FROM judged", *KDE, BEST.format("h DESC"))
sql("info_gain", "SELECT h, CAST(sum(n) AS BIGINT) AS n, round(sum(score * n) / sum(n), 8) AS gain FROM folds GROUP BY h", *KDE)
sql("g1_gate", """SELECT 'kde' || CAST(CAST(h AS INTEGER) AS VARCHAR) AS model, round(avg(score), 8) AS gain, count(*) FILTER (score > 0) AS positive_folds, h <> 75 AS stable, avg(score) > 0 AND count(*) FILTER (score > 0) >= 3 AND h <> 75 AS passed FROM folds GROUP BY h""", *KDE)
sql("model_select_one_se", """SELECT 'kde' || CAST(CAST(h AS INTEGER) AS VARCHAR) AS model, round(mean, 8) AS gain, round(se, 8) AS se, eligible, h = bh AS best, h = (SELECT max(h) FROM judged WHERE eligible) AS chosen FROM judged""", *KDE, BEST.format("h ASC"))

sql("omori_weights", """SELECT event_id, round(0.2 / 0.05 * pow(1 + (19754 - origin_day) / 0.05, -1.2), 9) AS density, round(1 - pow(1 + (19754 - origin_day) / 0.05, CAST(-0.2 AS DOUBLE)), 9) AS mass FROM catalog""")
POWER = "0.5 / (pi() * {s}) * pow(1 + {r} * {r} / {s}, -1.5) / (1 - pow(1 + 90000 / {s}, -0.5))"
sql("inverse_power_density", f"""SELECT event_id, round(CASE WHEN r <= 300 THEN {POWER.format(s='s', r='r')} ELSE 0 END, 12) AS density, round((1 - pow(1 + pow(least(r, 300), 2) / s, -0.5)) / (1 - pow(1 + 90000 / s, -0.5)), 9) AS mass
  FROM (SELECT event_id, sqrt(x_km * x_km + y_km * y_km) AS r, 25.0 * exp(magnitude - 3) AS s FROM catalog)""")
TRIGGER = f"0.2 * exp(m - 4.5) * (0.2 / 0.05 * pow(1 + dt / 0.05, -1.2)) * {POWER.format(s='(25.0 * exp(m - 4.5))', r='r')}"
ETAS = ["parents AS (SELECT * FROM catalog WHERE inside_external_buffer AND magnitude >= 4.5)", "targets AS (SELECT * FROM catalog WHERE inside_study_area AND magnitude >= 4.5 AND origin_day > 19733 AND origin_day <= 19743)",
        """near AS (SELECT t.event_id AS t_event_id, p.event_id AS p_event_id, t.origin_day - p.origin_day AS dt, sqrt(pow(t.x_km - p.x_km, 2) + pow(t.y_km - p.y_km, 2)) AS r, p.magnitude AS m
          FROM targets t JOIN parents p ON p.origin_day < t.origin_day AND t.origin_day - p.origin_day <= 5 AND p.available_day <= t.origin_day WHERE sqrt(pow(t.x_km - p.x_km, 2) + pow(t.y_km - p.y_km, 2)) <= 300)""",
        f"rates AS (SELECT event_id, 20.0 / 960000 + coalesce((SELECT sum({TRIGGER}) FROM near WHERE t_event_id = event_id), 0) AS intensity FROM targets)",
        GRID.format(100, -6, -4, "g"),
        """acting AS (SELECT *, 0.2 * exp(magnitude - 4.5) * (pow(1 + lower / 0.05, CAST(-0.2 AS DOUBLE)) - pow(1 + upper / 0.05, CAST(-0.2 AS DOUBLE))) AS expected FROM (
          SELECT *, greatest(greatest(CAST(19733 AS DOUBLE), available_day) - origin_day, 0) AS lower, least(CAST(5 AS DOUBLE), 19743 - origin_day) AS upper FROM parents) WHERE upper > lower)""",
        f"""spread AS (SELECT event_id, "row", "column", area, expected, CASE WHEN r <= 300 THEN {POWER.format(s='(25.0 * exp(magnitude - 4.5))', r='r')} ELSE 0 END * area AS part FROM (
          SELECT a.*, g.*, sqrt(pow(x_km - cx, 2) + pow(y_km - cy, 2)) AS r FROM acting a, g))"""]  # fmt: skip
sql("etas_pairs", "SELECT t_event_id, p_event_id, round(dt, 6) AS dt, round(r, 6) AS r FROM near", *ETAS)
sql("etas_event_intensity", "SELECT event_id, round(intensity, 10) AS intensity FROM rates", *ETAS)
sql("etas_log_likelihood", """SELECT n, round(ls, 5) AS log_sum, CAST(200 AS DOUBLE) AS background, round(tr, 5) AS triggered, round(ls - 200 - tr, 4) AS log_likelihood
  FROM (SELECT count(*) AS n, coalesce(sum(ln(intensity)), 0) AS ls FROM rates), (SELECT coalesce(sum(expected * part), 0) AS tr FROM spread)""", *ETAS)
sql("etas_cell_mass", 'SELECT "row", "column", round(sum(expected * part) + 20 * 10 / CAST(960000 AS DOUBLE) * any_value(area), 7) AS mass FROM spread GROUP BY 1, 2', *ETAS)
sql("etas_cell_mass_without_parents", 'SELECT "row", "column", round(20 * 10 / CAST(960000 AS DOUBLE) * area, 7) AS mass FROM g', GRID.format(100, -6, -4, "g"))
FIELD = f"""field AS (SELECT "row", "column", area, coalesce((SELECT sum({TRIGGER}) FROM (SELECT 19743 - origin_day AS dt, magnitude AS m, sqrt(pow(x_km - cx, 2) + pow(y_km - cy, 2)) AS r FROM parents
  WHERE origin_day < 19743 AND origin_day >= 19738 AND available_day <= 19743) WHERE r <= 300), 0) + 20.0 / 960000 AS intensity FROM g)"""
sql("layer_summary", "SELECT count(*) AS cells, round(sum(intensity * area), 5) AS total, round(min(intensity), 9) AS least, round(max(intensity), 9) AS greatest FROM field", *ETAS, FIELD)
sql("etas_issue_field", f"""SELECT "row", "column", round(sum(CASE WHEN r <= 300 THEN {TRIGGER} ELSE 0 END) + 20.0 / 960000, 9) AS intensity FROM (
  SELECT "row", "column", 19743 - origin_day AS dt, magnitude AS m, sqrt(pow(x_km - cx, 2) + pow(y_km - cy, 2)) AS r FROM parents, g WHERE origin_day < 19743 AND origin_day >= 19738 AND available_day <= 19743) GROUP BY 1, 2""", *ETAS)
#: The published scalars of the micro problem.
SCALARS = {
    "cutoff_mass_m4": 0.9725316805639023, "cutoff_mass_m3p5": 0.9786044751689525, "sigma_m4_km2": 67.95704571147613, "sigma_m3p5_km2": 41.218031767503206,
    "productivity_m4": 0.5436563656918091, "productivity_m3p5": 0.32974425414002567, "temporal_density_dt1_per_day": 0.10360884626454828,
    "temporal_density_dt2_per_day": 0.046421520707462985, "temporal_cdf_dt0p5": 0.3809560793161544, "temporal_cdf_dt1": 0.4560535571111214,
    "temporal_cdf_dt2": 0.5241794127485043, "spatial_density_r0_m4_per_km2": 0.0024081408428924503, "spatial_density_r5_m4_per_km2": 0.001505255248318638,
    "spatial_density_r5_m3p5_per_km2": 0.0019377250658923362, "spatial_mass_r30_m4": 0.7557949961304554, "spatial_mass_r30_m3p5": 0.808022138518414,
    "lambda_event_t1_r0_per_day_km2": 0.0002356448153667534, "background_compensator": 0.4241150082346221, "root_compensator": 0.05884943088561855,
    "event1_postevent_compensator": 0.12151120956373394, "total_compensator": 0.6044756486839746, "unmarked_log_likelihood": -8.957660554934703,
    "lambda_probe_t2_r5_per_day_km2": 0.00020418991778056394,
}
ORACLES["scalar_regression"] = "SELECT name, round(CAST(value AS DOUBLE), 12) AS value FROM (VALUES " + ", ".join(f"('{n}', CAST({v!r} AS DOUBLE))" for n, v in SCALARS.items()) + ") AS v(name, value)"
ORACLES["branching_ratios"] = """SELECT alpha, round(0.2 * CASE WHEN alpha = 0 THEN 1 WHEN alpha = 2 THEN 2 * 4 / (1 - exp(CAST(-8 AS DOUBLE))) ELSE 2 / (2 - alpha) * (1 - exp(-(2 - alpha) * 4)) / (1 - exp(CAST(-8 AS DOUBLE))) END, 9) AS ratio
FROM (VALUES (CAST(0 AS DOUBLE)), (0.5), (1), (1.5), (2), (2.5)) AS v(alpha)"""

sql("horizon_backtest", """SELECT horizon, issue_day, n, round(n * ln(40 / CAST(960000 AS DOUBLE)) - 40 * horizon, 6) AS log_likelihood FROM (
  SELECT horizon, issue_day, (SELECT count(*) FROM catalog WHERE inside_study_area AND magnitude >= 4 AND origin_day > issue_day AND origin_day <= issue_day + horizon) AS n
  FROM (SELECT CAST(h AS DOUBLE) AS horizon, CAST(19728 + k AS INTEGER) AS issue_day FROM (VALUES (1), (3), (7)) AS v(h), range(0, 21) AS r(k) WHERE k % h = 0))""")
FUTURE = ["future AS (SELECT *, CAST(event_id % 32 AS INTEGER) AS replicate FROM catalog WHERE inside_study_area AND magnitude >= 4)",
          """counts AS (SELECT horizon, CAST(replicate AS INTEGER) AS replicate, count(event_id) AS n FROM (SELECT CAST(h AS DOUBLE) AS horizon, r AS replicate FROM (VALUES (1), (7), (14), (30)) AS v(h), range(0, 32) AS t(r)) LEFT JOIN
            (SELECT event_id, replicate AS rep, origin_day FROM future) ON rep = replicate AND origin_day > 19723 AND origin_day - 19723 <= horizon GROUP BY 1, 2)"""]  # fmt: skip
sql("future_counts", "SELECT horizon, replicate, n FROM counts", *FUTURE)
sql("future_quantiles", "SELECT horizon, round(avg(n), 9) AS mean, round(quantile_cont(n, 0.025), 9) AS low, round(quantile_cont(n, 0.5), 9) AS middle, round(quantile_cont(n, 0.975), 9) AS high FROM counts GROUP BY horizon", *FUTURE)
sql("sparse_expected_cells", 'SELECT CAST(floor(y_km / 200) AS INTEGER) AS "row", CAST(floor(x_km / 200) AS INTEGER) AS "column", count(*) / CAST(32 AS DOUBLE) AS expected FROM future GROUP BY 1, 2', *FUTURE)

ORACLES["text_functions"] = """SELECT p_partkey, nullif(trim(p_name), '') AS name, regexp_replace(CAST(CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DECIMAL(38,18)) AS VARCHAR), '\\.?0+$', '') AS price, substr(sha256(p_name), 1, 16) AS id FROM part"""
ORACLES["loose_names"] = """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN replace(p_name, ' ', '-') || '断裂' WHEN p_partkey % 5 = 2 THEN p_name || '断裂' ELSE p_name END AS name FROM part"""
ORACLES["time_functions"] = """SELECT o_orderkey, strftime(CAST(greatest(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + CAST(o_orderkey % 3 - 1 AS INTEGER)) + 1 AS TIMESTAMP) - INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS available,
round(epoch_us(o_orderdate) / 8.64e10, 6) AS day FROM orders"""
sql("great_circle", """SELECT event_id, round(2 * 6371.0088 * asin(least(1, sqrt(pow(sin(radians(35 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(35.0)) * pow(sin(radians(105 - lon) / 2), 2)))), 3) AS km
  FROM (SELECT event_id, 105 + x_km / 100 AS lon, 35 + y_km / 100 AS lat FROM catalog)""")
from tremora.functions import geodesy  # noqa: E402

N_, C_, RHO0 = geodesy._albers_constants()
sql("albers_projection", f"""SELECT event_id, round(rho * sin(theta), 1) AS x_m, round({RHO0!r} - rho * cos(theta), 1) AS y_m FROM (
  SELECT event_id, {geodesy.SEMI_MAJOR!r} * sqrt({C_!r} - {N_!r} * (1 - {geodesy.E2!r}) * (s / (1 - {geodesy.E2!r} * s * s) + atanh({geodesy.ECC!r} * s) / {geodesy.ECC!r})) / {N_!r} AS rho, {N_!r} * radians(x_km / 100) AS theta
  FROM (SELECT event_id, x_km, sin(radians(35 + y_km / 100)) AS s FROM catalog))""")
ORACLES["text_catalog"] = """SELECT event_id, CAST(user_id % 90 AS DOUBLE) AS latitude, CAST(user_id AS DOUBLE) AS longitude, round(value, 1) AS magnitude, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(10 AS DOUBLE) END AS depth_km, 'place ' || event_type AS place,
CASE WHEN event_id % 4 = 0 THEN 'availability_optimistic,negative_depth' ELSE 'availability_optimistic' END AS flags, strftime(ts, '%Y-%m-%d %H:%M:%S') AS origin_local FROM events"""
ORACLES["best_three"] = "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INTEGER) AS place FROM events QUALIFY place <= 3"
ORACLES["regression_statistics"] = """SELECT event_type, round(avg(value), 6) AS mean, round(var_samp(value), 4) AS variance, round(max(greatest(place / CAST(n AS DOUBLE) - pit, pit - (place - 1) / CAST(n AS DOUBLE))), 9) AS ks FROM (
  SELECT event_type, value, 1 - exp(-value / 50.0) AS pit, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS place FROM events) GROUP BY 1"""
ORACLES["analytic_regression"] = "SELECT name, true AS passed FROM (VALUES " + ", ".join(f"('{n}')" for n in ("generic_branching_ratio", "root_direct_offspring_mean", "root_total_descendants_mean", "root_total_descendants_variance", "root_zero_descendant_probability", "direct_offspring_pit_ks", "minimum_pooled_direct_offspring", "event_cap_hits", "nonfinite_values")) + ") AS v(name)"
