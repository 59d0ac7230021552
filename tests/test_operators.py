"""Operators on small inputs with known results."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremora.functions import geodesy, kernels, moments, textual
from tremora.operators import completeness, dedup, etas, evaluation, filters, fitting, grid, joins, poisson, sequences, simulation
from tremora.plans.oracles import SCALARS
from tremora.sources import files, texts


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_scalars_reach_published_accuracy(spark):
    from tremora.plans.catalogue import QUERIES

    got = {r.name: r.value for r in QUERIES["scalar_regression"](spark, "").collect()}
    for name, value in SCALARS.items():
        assert math.isclose(got[name], value, rel_tol=5e-12, abs_tol=1e-12), name


def test_expectation_limit_is_continuous(spark):
    near = one(spark, kernels.truncated_gr_expectation(2.0, 2.0, 4.0).alias("a"), kernels.truncated_gr_expectation(2.0 + 1e-9, 2.0, 4.0).alias("b"), kernels.truncated_gr_expectation(0.0, 2.0, 4.0).alias("c"))
    assert near.a == pytest.approx(near.b, rel=1e-7) and near.c == 1.0
    assert one(spark, kernels.truncated_gr_expectation(1.0, 2.0, 4.0).alias("x")).x == pytest.approx(1.964027580075817, rel=1e-12)


def test_text_functions(spark):
    r = one(spark, textual.normalize_text(F.lit("  Ａ　b\t c ")).alias("a"), textual.normalize_text(F.lit(" ")).alias("b"), textual.canonical_decimal(F.lit("100.50").cast("decimal(10,2)")).alias("c"), textual.canonical_decimal(F.lit(-0.0)).alias("d"), textual.canonical_decimal(F.lit("2.5").cast("decimal(3,1)"), 0).alias("e"), textual.loose_name(F.lit("Red–_River断裂带")).alias("f"), textual.loose_name(F.lit("-12.5")).alias("g"), textual.safe_path(F.lit("a/../b")).alias("h"), textual.safe_path(F.lit("a\\b")).alias("i"), textual.cell_id(12.5, F.lit(-2), F.lit(3)).alias("j"))
    assert tuple(r) == ("A b c", None, "100.5", "0", "2", "Red-River断裂", None, None, "a/b", "g12500000_r-0000002_c+0000003")
    k = one(spark, textual.geometry_key(F.array(F.lit("1"), F.lit("2"))).alias("a"), textual.geometry_key(F.array(F.lit("2"), F.lit("1"))).alias("b"), textual.stable_token(textual.joined_parts(F.lit("x"), F.lit(1))).alias("c"))
    assert k.a == k.b and len(k.c) == 26


def test_moments(spark):
    carried = moments.local_to_utc(moments.fixed_offset_local(F.lit(1971), F.lit(11), F.lit(1), F.lit(13), F.lit(29), F.lit("60").cast("decimal(8,6)")))
    old = moments.local_to_utc(moments.fixed_offset_local(F.lit(1900), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit("0").cast("decimal(8,6)")))
    r = one(spark, carried.alias("a"), old.alias("b"), moments.conservative_available_at(F.lit("2026-07-01").cast("date"), F.lit("2026-06-30").cast("date")).alias("c"), moments.strict_date(F.lit("2024-2-1")).alias("d"), moments.elapsed_ratio(F.lit(2020), F.lit(2000), F.lit(0)).alias("e"))
    assert tuple(r) == (dt.datetime(1971, 11, 1, 5, 30), dt.datetime(1899, 12, 31, 16), dt.datetime(2026, 7, 1, 16), None, None)


def test_albers_keeps_area_and_rings_cover():
    lon, lat = np.linspace(104, 106, 200), np.linspace(34, 36, 200)
    edge = [(x, 34.0) for x in lon] + [(106.0, y) for y in lat] + [(x, 36.0) for x in lon[::-1]] + [(104.0, y) for y in lat[::-1]]
    ring = geodesy.albers_points(*np.array(edge).T)
    expected = 2 * np.pi / 180 * geodesy.SEMI_MAJOR**2 / 2 * (geodesy._q(np.sin(np.radians(36))) - geodesy._q(np.sin(np.radians(34))))
    assert geodesy.signed_area(ring) == pytest.approx(expected, rel=1e-4)
    square = np.array([[0.0, 0], [10, 0], [10, 10], [0, 10]])
    assert geodesy.covers(square, np.array([[5.0, 5], [10, 5], [0, 0], [10.1, 5], [-1, 0]])).tolist() == [True, True, True, False, False]
    assert geodesy.within(square, np.array([[13.0, 14.0], [13.1, 14.0]]), 5.0).tolist() == [True, False]
    assert geodesy.signed_area(geodesy.clip(square, 5, -5, 20, 5)) == 25
    hollow = np.array([[0.0, 0], [9, 0], [9, 9], [6, 9], [6, 3], [3, 3], [3, 9], [0, 9]])
    assert geodesy.covers(hollow, geodesy.representative_point(hollow)[None])[0]


def test_maxc_tie_goes_up_and_b(spark):
    events = spark.createDataFrame([(m,) for m, n in ((3.0, 10), (3.1, 10), (3.4, 1)) for _ in range(n)], "magnitude double")
    r = completeness.max_curvature(events).first()
    assert (r.peak, r.estimate, r.candidate) == (3.1, 3.3, 3.5)
    flat = spark.createDataFrame([(3.2,)] * 50, "magnitude double")
    assert completeness.b_values(flat, (3.2,)).first().b == pytest.approx(math.log10(math.e) / 0.05)
    assert completeness.gate(spark.createDataFrame([(4.5,)], "estimate double")).first().status == "completeness_above_limit"


def test_dedup_is_mutual_and_not_transitive(spark):
    schema = "event_id long, origin_day double, magnitude double, x_km double, y_km double, source string"
    s = 1 / 86400
    left = spark.createDataFrame([(1, 0.0, 4.0, 0.0, 0.0, "m3"), (2, 4 * s, 4.0, 0.0, 0.0, "m3"), (3, 1.0, 4.0, 0.0, 0.0, "m3"), (4, 2.0, 4.0, 0.0, 0.0, "m3")], schema)
    right = spark.createDataFrame([(11, 2 * s, 4.0, 0.0, 0.0, "m5"), (12, 1.0 + s, 4.0, 0.0, 0.0, "m5"), (13, 2.0 + 120 * s, 4.0, 0.0, 0.0, "m5")], schema)
    pairs = dedup.candidates(left, right, review=(300.0, 50.0, 0.5), auto=(5.0, 5.0, 0.1))
    got = {(r.l_event_id, r.r_event_id): r.status for r in dedup.classified(pairs).collect()}
    assert got == {(1, 11): "ambiguous", (2, 11): "ambiguous", (3, 12): "merged", (4, 13): "review"}
    assert {r.event_id for r in dedup.events(left, right, pairs).collect()} == {1, 2, 4, 11, 12, 13}
    assert "NestedLoop" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_candidates_equal_all_pairs_and_are_not_broadcast(spark):
    """The exploded side is many times what Spark takes it for, so it must not go through the driver."""
    from tremora.plans.catalogue import QUERIES

    g = np.random.default_rng(5)
    step = lambda: float(g.integers(-6, 7))  # noqa: E731  many pairs exactly on a limit
    rows = [(i, step() / 48, 4.0 + step() / 4 + float(g.choice([0.0, 4e-7])), step() * 10 - 3, step() * 10 - 7, "m3" if i % 2 else "m5") for i in range(500)]
    df = spark.createDataFrame(rows, "event_id long, origin_day double, magnitude double, x_km double, y_km double, source string")
    pairs = dedup.candidates(df.filter("source = 'm3'"), df.filter("source = 'm5'"), review=(1800.0, 20.0, 0.5))
    near = lambda a, b: abs(a[1] - b[1]) <= 1800 / 86400 and math.hypot(a[3] - b[3], a[4] - b[4]) <= 20 and round(abs(a[2] - b[2]), 6) <= 0.5
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[5] == "m3" and b[5] == "m5" and near(a, b))
    assert sorted((r.l_event_id, r.r_event_id) for r in pairs.collect()) == want and len(want) > 200
    read = QUERIES["dedup_candidates"](spark, "/root/testdata/sf0.01")
    assert "Broadcast" not in read._jdf.queryExecution().executedPlan().toString()


def test_radius_join_equals_all_pairs(spark):
    g = np.random.default_rng(3)
    rows = [(i, float(g.uniform(0, 30)), float(g.uniform(0, 30)), float(g.uniform(-900, 900)), float(g.uniform(-900, 900)), 4.0) for i in range(150)]
    rows = [(i, t, max(t, a), x, y, m) for i, t, a, x, y, m in rows]
    df = spark.createDataFrame(rows, "event_id long, origin_day double, available_day double, x_km double, y_km double, magnitude double")
    got = {(r.t_event_id, r.p_event_id) for r in joins.radius_join(df, df, 300.0, 5.0).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if 0 < a[1] - b[1] <= 5 and math.hypot(a[3] - b[3], a[4] - b[4]) <= 300 and b[2] <= a[1]}
    assert got == want


def test_late_parents_and_windows(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 4.0), (2, 1.0, 3.0, 4.0), (3, -4000.0, -4000.0, 4.0)], "event_id long, origin_day double, available_day double, magnitude double")
    got = {r.event_id: (r.lower, r.upper) for r in joins.overlap_window(p, 0.5, 2.0, 3650.0).collect()}
    assert got == {1: (0.5, 2.0)}


def test_exclusions_are_ordered(spark):
    df = spark.createDataFrame([(False, 0.0, 0.0), (True, 0.0, 0.0), (True, 20.0, 20.0), (True, 5.0, 12.0), (True, 5.0, 5.0)], "inside_study_area boolean, origin_day double, available_day double")
    assert [r[0] for r in df.select(filters.exclusion(1.0, 10.0)).collect()] == ["outside", "before_start", "future_origin", "unavailable", "included"]


def test_sequences(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, None), (1, 3, 6), (1, 4, 6)], "e int, t int, v int")
    got = [(r.retracted, r.revised) for r in sequences.revisions(df, "e", ["t"], "v").orderBy("t").collect()]
    assert got == [(False, False), (True, False), (False, True), (False, False)]
    assert one(spark, sequences.greedy_exposures(F.array(*[F.lit(float(x)) for x in (0, 1, 7, 8, 14)]), 7.0).alias("x")).x == [0.0, 7.0, 14.0]
    blocks = spark.createDataFrame([(0, 3.0, 10.0), (1, 3.3, 10.0), (2, 3.3, 30.0)], "b int, mc double, rate double")
    assert [r.changed for r in sequences.regime_changes(blocks, "b", "mc", "rate", 0.2, 2.0).orderBy("b").collect()] == [False, True, True]


def test_grid_indices_and_convergence(spark):
    points = spark.createDataFrame([(12.499999, 0.0), (12.5, 0.0), (-0.000001, 0.0), (-12.5, 0.0), (-12.500001, 0.0)], "x_km double, y_km double")
    assert [r.column for r in grid.assigned(points, 12.5).collect()] == [0, 1, -1, -1, -2]
    fine = grid.cells(spark, 25.0, 25.0, 25.0).withColumn("v", F.lit(4.0))
    r = grid.convergence(grid.cells(spark, 50.0, 25.0, 25.0).withColumn("v", F.lit(4.0)), fine, "v").first()
    assert r.passed and r.relative_total == 0


def test_uniform_and_kde_scores(spark):
    r = one(spark, poisson.uniform_score(F.lit(2), F.lit(2.0), 100.0, 3.0).alias("a"), poisson.uniform_score(F.lit(0), F.lit(0.5), 1.0, 7.0).alias("b"))
    assert r.a == pytest.approx(2 * math.log(0.02) - 6) and r.b == -3.5
    train = spark.createDataFrame([(20.0, 20.0), (80.0, 80.0)], "x_km double, y_km double")
    masses = poisson.kde_cell_masses(train, grid.cell_array(grid.cell_values(12.5, 100.0, 100.0)), (75.0, 100.0))
    for row in masses.groupBy("h").agg(F.sum("mass").alias("m"), F.first("normaliser").alias("z")).collect():
        assert row.m == pytest.approx(1.0, abs=1e-13) and row.z < 1
    folds = spark.createDataFrame([(h, f, s) for h, s in ((75.0, 1.0), (100.0, 1.0), (150.0, 0.2)) for f in range(4)], "h double, fold int, score double")
    assert {r.h for r in poisson.select_bandwidth(folds).filter("selected").collect()} == {100.0}


def test_etas_likelihood_of_the_micro_problem(spark):
    schema = "event_id string, origin_day double, available_day double, magnitude double, x_km double, y_km double"
    parents = spark.createDataFrame([("root", 0.0, 0.0, 4.0, 0.0, 0.0), ("target", 1.0, 1.0, 3.5, 0.0, 0.0), ("old", -4000.0, -4000.0, 4.0, 0.0, 0.0)], schema)
    s, w = etas.Spec(mc=3.0), etas.Parameters(mu=1e-4, k=0.2, alpha=1.0, c=0.05, p=1.2)
    t = parents.filter("event_id = 'target'")
    got = etas.intensities(t, etas.pairs(t, parents, s), s, w, F.lit(1e-4)).first().intensity
    assert got == pytest.approx(2.356448153667534e-4, rel=5e-12)
    cells = grid.cells(spark, 10.0, 30.0, 30.0)
    total = etas.cell_masses(parents, cells, s, w, 0.5, 2.0, 3600.0).agg(F.sum("mass")).first()[0]
    likelihood = etas.log_likelihood(t, parents, cells, s, w, 0.5, 2.0, 3600.0).first()
    assert likelihood.triggered + likelihood.background == pytest.approx(total, rel=1e-9)
    alone = etas.cell_masses(parents.limit(0), cells, s, w, 0.5, 2.0, 3600.0).agg(F.sum("mass"), F.count("*")).first()
    assert alone[0] == pytest.approx(1.5e-4) and alone[1] == 36


def test_density_far_from_all_training_points(spark):
    schema = "event_id int, x_km double, y_km double"
    train, far = spark.createDataFrame([(1, 0.0, 0.0), (2, 30.0, 40.0)], schema), spark.createDataFrame([(9, 4000.0, 0.0), (10, 10.0, 0.0)], schema)
    norms = spark.createDataFrame([(75.0, 1.0), (300.0, 1.0)], "h double, normaliser double")
    got = {(r.event_id, r.h): r.log_density for r in poisson.kde_log_densities(far, train, norms, (75.0, 300.0), block_rows=1).collect()}
    for (i, x), h in ((q, h) for q in ((9, 4000.0), (10, 10.0)) for h in (75.0, 300.0)):
        e = [-(x**2) / (2 * h * h), -((x - 30) ** 2 + 1600) / (2 * h * h)]
        want = max(e) + math.log(sum(math.exp(v - max(e)) for v in e) / 2 / (2 * math.pi * h * h))
        assert got[i, h] == pytest.approx(want, rel=1e-12)
    assert poisson.kde_log_densities(far, train.limit(0), norms, (75.0, 300.0)).count() == 0
    masses = poisson.kde_cell_masses(train.limit(0), grid.cell_array(grid.cell_values(50.0, 100.0, 100.0)), (75.0,))
    assert masses.count() == 16 and masses.filter("mass is not null").count() == 0


def test_cap_counts_absorbed_events():
    import pandas as pd

    nothing = pd.DataFrame({c: [] for c in ("event_id", "origin_day", "x_km", "y_km", "magnitude")})
    run = lambda cap: simulation.simulate_one(np.random.default_rng(1), nothing, etas.Spec(), etas.Parameters(mu=10.0), 0.0, 10.0, lambda x, y: "outside", lambda g: (0.0, 0.0), cap)
    assert run(1000) == []
    with pytest.raises(RuntimeError):
        run(20)


def test_repaired_places(spark):
    mangled = "四川".encode("gb18030").decode("latin-1")
    rows = spark.createDataFrame([(mangled,), ("plain",), ("云南",), ("é",), (None,)], "p string")
    assert [r[0] for r in rows.select(textual.repair_place("p")).collect()] == ["四川", "plain", "云南", "é", None]


def test_gates_and_selection(spark):
    folds = spark.createDataFrame([(m, f, g) for m, gs in (("a", (1, 1, 1, -1)), ("b", (1, 1, -1, -1))) for f, g in enumerate(gs)], "model string, fold int, gain int")
    final = spark.createDataFrame([("a", 0.5, 1, True), ("b", 0.6, 2, True)], "model string, gain double, complexity int, stable boolean")
    assert {r.model: r.passed for r in evaluation.g1(folds, final).collect()} == {"a": True, "b": False}
    chosen = {r.model: (r.best, r.chosen) for r in evaluation.select_model(folds, final).collect()}
    assert chosen == {"a": (False, True), "b": (True, False)}
    assert one(spark, evaluation.information_gain(F.lit(1.0), F.lit(0.0), F.lit(0)).alias("x")).x is None
    u = spark.createDataFrame([(1, 1, -2.0, 1.0), (1, 2, -2.0, 1.0)], "g int, event_id int, log_intensity double, compensator double")
    r = evaluation.paired_gain(u.withColumn("log_intensity", F.lit(-1.0)), u, ["g"]).first()
    assert (r.n, r.unpaired, r.gain) == (2, 0, 1.0)


def test_simulation_does_not_depend_on_partitions(spark):
    s, w = etas.Spec(mc=4.0, most=7.0), etas.Parameters(mu=2.0)
    history = spark.createDataFrame([("a", 0.0, 0.0, 6.0, 0.0, 0.0), ("b", -1.0, -1.0, 4.0, 700.0, 0.0)], "event_id string, origin_day double, available_day double, magnitude double, x_km double, y_km double")
    first = simulation.simulate(history, s, w, 1.0, 30.0, 6).orderBy("replicate", "event_id").collect()
    again = simulation.simulate(history.repartition(2), s, w, 1.0, 30.0, 6).orderBy("replicate", "event_id").collect()
    assert first == again and len({r.replicate for r in first}) == 6
    counts = simulation.horizon_replicate_counts(spark.createDataFrame(first).filter("inside"), spark.range(7).selectExpr("cast(id as int) replicate"), 1.0, (7.0, 30.0)).collect()
    by = {(r.replicate, r.horizon): r.n for r in counts}
    assert by[6, 30.0] == 0 and all(by[i, 7.0] <= by[i, 30.0] for i in range(6))


def test_branching_moments(spark):
    trees = simulation.analytic_regression(spark, 2048).toPandas()
    assert trees["descendants"].mean() == pytest.approx(0.8953578796, abs=0.16)
    assert (trees["descendants"] == 0).mean() == pytest.approx(0.5806214023, abs=0.04)


def test_fit_recovers_a_rate():
    n, days, area = 400, 100.0, 1000.0
    empty = np.zeros(0)
    d = fitting.Prepared(n, np.zeros(0, np.int64), empty, empty, empty, empty, empty, empty, empty, days, area)
    x, value, done = fitting.minimise(lambda p: np.exp(p[0]) * d.days - n * np.log(np.exp(p[0]) / area), np.array([0.0]), np.array([[-5.0, 5.0]]))
    assert done and np.exp(x[0]) == pytest.approx(4.0, rel=1e-4) and np.isfinite(value)
    assert fitting.gradient(lambda v: v[0] ** 2, np.array([1.0]), np.array([[0.0, 1.0]]))[0] == pytest.approx(2.0, rel=1e-4)
    assert fitting.hessian(lambda v: 3 * v[0] ** 2 + v[0] * v[1] + v[1] ** 2, np.array([1.0, 2.0])).round(3).tolist() == [[6.0, 1.0], [1.0, 2.0]]


def test_sources(spark, tmp_path):
    (tmp_path / "a.eqt").write_text("20240101 010203.5 30.1 100.2 4.5 -1 000 place one\n20240101 016103.5 30 100 4 10 000\nnonsense\n")
    (tmp_path / "lines.gmt").write_text("> one\n# note\n100 30\n101 31\n> two\n102 200\n")
    lines = texts.numbered_lines(spark, str(tmp_path / "a.eqt")).filter("value <> ''").withColumnRenamed("number", "source_row")
    got = {r.source_row: (r.fault, r.depth_km, r.place, tuple(r.flags)) for r in texts.parse_catalog(lines).collect()}
    assert got[1] == (None, None, "place one", ("availability_optimistic", "negative_depth"))
    assert got[2][0] == "time" and got[3][0] == "layout"
    points = texts.parse_segments(texts.numbered_lines(spark, str(tmp_path / "lines.gmt"))).collect()
    assert sorted((r.segment, r.header, r.fault) for r in points) == [(1, "one", None), (1, "one", None), (2, "two", "range")]
    inv = files.inventory(spark, {"a": str(tmp_path / "a.eqt"), "b": str(tmp_path / "lines.gmt")})
    files.write_inventory(inv.select("source_id", "path", "name", "bytes", "sha256"), str(tmp_path / "inventory"))
    recorded = files.read_inventory(spark, str(tmp_path / "inventory"))
    assert files.faults(inv, recorded, ["a", "b"]).count() == 0 and files.not_single(inv, ["a", "c"]).first().source_id == "c"
    (tmp_path / "lines.gmt").write_text("> changed\n")
    assert [r.fault for r in files.faults(files.inventory(spark, {"a": str(tmp_path / "a.eqt"), "b": str(tmp_path / "lines.gmt")}), recorded, ["a", "b"]).collect()] == ["changed"]


def test_two_tiers_and_strict_keys(spark):
    s = spark.createDataFrame([(1, "A", "a"), (2, "B", "b")], "sid int, name string, loose string")
    t = spark.createDataFrame([(10, "A", "b"), (11, "x", "a")], "tid int, name string, loose string")
    assert {(r.sid, r.tid, r.tier) for r in joins.two_tier_join(s, t, "sid", "tid", "name", "loose").collect()} == {(1, 10, "exact"), (1, 11, "loose"), (2, None, "unmatched")}
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, l string"), spark.createDataFrame([(1, "x"), (3, "z")], "k int, r string")
    assert {(r.k, r.side) for r in joins.key_difference(a, b, ["k"]).collect()} == {(2, "left"), (3, "right")}
    assert joins.strict_join(a, b, ["k"], {"l": "r"}).first().fault is None


def test_catalog_lines_keep_their_time_where_the_place_is_out_of_range(spark):
    lines = ["20240102 030405.50 30 1499 4.0 10 000 far", "20240102 030405.50 30 100 -1 10 000 small", "20240102 250000 30 1499 4.0 10 000 late", "20240102 030405.50 30 100 4.0 10 000 good"]
    got = [(r.fault, r.origin_local) for r in texts.parse_catalog(spark.createDataFrame(list(enumerate(lines)), "source_row int, value string")).orderBy("source_row").collect()]
    at = dt.datetime(2024, 1, 2, 3, 4, 5, 500_000)
    assert got == [("coordinates", at), ("magnitude", at), ("time", None), (None, at)]
