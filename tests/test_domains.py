"""Study areas, fault maps, anomaly reports, horizons, fits, publication and ingest on small inputs."""

import json
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tremora.functions import geodesy
from tremora.operators import etas, fitting, horizons, simulation, study
from tremora.plans import domains, ingest
from tremora.sources import anomalies, faultmaps, files, publication

SQUARE = {"type": "Polygon", "coordinates": [[[-100, -100], [100, -100], [100, 100], [-100, 100], [-100, -100]]]}


# --- study area ----------------------------------------------------------------------------------------------------


def test_area_covers_holes_and_boundaries():
    area = study.area_of(domains.HEXAGON, project=False)
    points = np.array([[0.0, 0], [50, 0], [60, 0], [600, 0], [601, 0], [450, 200], [451, 200], [0, 400], [0, 401]])
    assert area.covers(points).tolist() == area.exact(points).tolist() == [False, True, True, True, False, True, False, True, False]
    r = np.random.default_rng(0).uniform(-700, 700, (2000, 2))
    assert (area.covers(r) == area.exact(r)).all() and area.km2 == 720_000 - 10_000
    assert area.within(np.array([[0.0, 700], [0, 700.1], [0, 0]]), 300).tolist() == [True, False, True]


def test_area_is_read_from_every_form(spark, tmp_path):
    for document in (SQUARE, {"type": "Feature", "geometry": SQUARE}, {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": SQUARE}]}, {"type": "MultiPolygon", "coordinates": [SQUARE["coordinates"]]}):
        (tmp_path / "a.geojson").write_text(json.dumps(document))
        assert study.load(spark, str(tmp_path / "a.geojson"), project=False).km2 == 40_000
    for wrong in ({"type": "FeatureCollection", "features": []}, {"type": "Feature"}, {"type": "Point", "coordinates": [0, 0]}, {"type": "Polygon", "coordinates": [[[0, 0], [1, 1], [2, 2]]]}):
        with pytest.raises(ValueError):
            study.area_of(wrong, project=False)
    area = study.area_of(SQUARE, project=False)
    assert study.check(area, 40_000.5) == [] and study.check(area, 40_002, vertices=5) == ["area", "vertices"]
    degrees = study.area_of({"type": "Polygon", "coordinates": [[[x, 34.0] for x in np.linspace(104, 106, 99)] + [[x, 36.0] for x in np.linspace(106, 104, 99)]]})
    assert degrees.km2 == pytest.approx(2 * math.pi / 180 * geodesy.SEMI_MAJOR**2 / 2 * (geodesy._q(math.sin(math.radians(36))) - geodesy._q(math.sin(math.radians(34)))) / 1e6, rel=1e-3)


def test_clipped_cells_sum_to_the_area(spark):
    area = study.area_of(domains.HEXAGON, project=False)
    rows = study.clipped_cells(spark, area, 100.0).collect()
    assert sum(r.area_km2 for r in rows) == pytest.approx(area.km2) and len({r.cell_id for r in rows}) == len(rows)
    assert all(r.whole == (abs(r.area_km2 - 10_000) < 1e-6) for r in rows) and area.covers(np.array([(r.x_km, r.y_km) for r in rows if r.area_km2 > 2500])).all()
    overlaps = spark.createDataFrame([(1, 7, 2.0), (1, 3, 2.0), (1, 1, 1.0)], "g int, ordinal int, area_km2 double")
    assert study.largest_overlap(overlaps, ["g"]).first().ordinal == 3
    marked = study.with_domains(spark.createDataFrame([(0.0, 0.0), (100.0, 0.0), (0.0, 700.5)], "x_km double, y_km double"), area, 300.0)
    assert [(r.inside_study_area, r.inside_external_buffer) for r in marked.collect()] == [(False, True), (True, True), (False, False)]
    assert study.flag_faults(marked.withColumn("inside_study_area", F.lit(True)), area).count() == 2


# --- fault maps ----------------------------------------------------------------------------------------------------


def test_segments_need_all_three_tables(spark):
    row = lambda f, n, x, y, name="A", new=True: (f, 1, n, name, "s", float(x), float(y), new)
    points = [row(1, 1, 0, 0), row(1, 2, 0, 0), row(1, 3, 1, 1), row(2, 1, 0, 0), row(2, 3, 1, 1), row(3, 1, 0, 0), row(3, 2, 0, 0), row(4, 1, 0, 0), row(4, 2, 1, 0, "B"), row(5, 1, 0, 0), row(5, 2, 1, 0), row(6, 1, 0, 0), row(6, 2, 2, 2), row(6, 3, 2, 0), row(6, 4, 0, 2)]
    points = spark.createDataFrame(points, "fault_id int, segment_number int, point_number int, fault_name string, segment_name string, longitude double, latitude double, is_new boolean")
    attributes = spark.createDataFrame([(f, 1, "A", "s", 50.0 if f == 1 else None, 1974) for f in (1, 2, 3, 4, 6, 7)], "fault_id int, segment_number int, fault_name string, segment_name string, recurrence_years double, last_year int")
    hazards = spark.createDataFrame([(f, 1, "A", "s") for f in (1, 2, 3, 4, 6)], "fault_id int, segment_number int, fault_name string, segment_name string")
    got = {r.fault_id: r for r in faultmaps.segments(points, attributes, hazards, 2024).collect()}
    assert {k: r.fault for k, r in got.items()} == {1: None, 2: "point_numbers", 3: "one_place", 4: "names_differ_within", 5: "no_attributes", 6: None, 7: "no_points"}
    assert got[1].geometry_flags == ["adjacent_duplicate_coordinates_removed"] and got[1].elapsed_ratio == 1.0 and got[1].geometry_point_count == 2
    assert got[6].geometry_flags == ["non_simple_geometry"] and got[6].missing_fields == ["recurrence_years"] and len(got[1].fault_segment_id) == 26
    assert bytes(got[1].geometry_wkb).hex() == "010200000002000000" + "00" * 16 + "000000000000f03f" * 2
    with pytest.raises(ValueError, match="columns"):
        faultmaps.checked(hazards, ["a"])
    with pytest.raises(ValueError, match="no data"):
        faultmaps.checked(spark.createDataFrame([(None, " ")], "a string, b string"), ["a", "b"])


def test_lines_that_cross():
    line = lambda *p: faultmaps.crosses_itself(np.array(p, np.float64))
    assert not line((0, 0), (1, 0), (1, 1)) and not line((0, 0), (1, 0), (1, 1), (0, 0)) and line((0, 0), (2, 2), (2, 0), (0, 2)) and line((0, 0), (2, 0), (1, 0)) and line((0, 0), (2, 0), (2, 1), (1, 0))


# --- anomaly reports -----------------------------------------------------------------------------------------------


def test_reports_in_both_layouts(spark):
    def cells(names, **given):
        return [given.get(n) for n in names]

    good = {"序号": "1", "报告日期": "2024/01/08", "单位": " U ", "经度": "100.123456", "纬度": "30", "分量名": "m", "异常是否结束": "否", "异常起始时间": "2024-01-01", "新增_持续_取消": "新增"}
    name = "x/异常零数据All202401期周报-修改-20240108.XLS"
    rows = [
        (name, "00", "形变", 2, cells(anomalies.COMMON, **good, 台站="s", 学科="形变", 年度异常="a")), (name, "00", "跨断层", 2, cells(anomalies.CROSS_FAULT, **good, 场地="s", 年度异常="b", 趋势性异常时间="3", 震例信息="z")),
        (name, "00", "形变", 3, cells(anomalies.COMMON, **(good | {"序号": "5"}), 台站="s", 学科="流体")), ("x/other.XLS", "00", "流体", 2, cells(anomalies.COMMON, **good, 学科="流体")), (name, "00", "流体", 2, cells(anomalies.COMMON, **(good | {"异常是否结束": "?"}), 学科="流体")),
    ]
    found = anomalies.observations(spark.createDataFrame(rows, "file string, sha256 string, sheet string, source_row int, cells array<string>"))
    got = {(r.file == name, r.sheet, r.source_row): r for r in found.collect()}
    first, cross = got[True, "形变", 2], got[True, "跨断层", 2]
    assert first.fault is None and first.unit == "U" and first.annual_anomaly == "a" and str(first.longitude) == "100.12346" and str(first.available_at) == "2024-01-08 16:00:00"
    assert cross.fault is None and cross.annual_anomaly == "b" and cross.observation_period == "3" and cross.trend_time is None and "manual_prediction_fields_present" in cross.quality_flags
    assert [got[k].fault for k in ((True, "形变", 3), (False, "流体", 2), (True, "流体", 2))] == ["discipline", "file_name", "end_flag"]
    assert first.station_id == cross.station_id and first.anomaly_id != cross.anomaly_id
    assert [r.source_row for r in anomalies.serials_out_of_place(found).collect()] == [3]
    assert [r.sheet for r in anomalies.ordered(found.filter("fault is null")).collect()] == ["形变", "跨断层"]
    assert anomalies.revised(found).count() == anomalies.latest(found).count() + 0 == 5 or anomalies.latest(found).count() <= 5
    heads = [("f", i, s, list(anomalies.CROSS_FAULT if i == 3 else anomalies.COMMON)) for i, s in enumerate(anomalies.SHEETS)]
    bad = [("g", i, s, ["a"]) for i, s in enumerate(anomalies.SHEETS)] + [("h", 0, "形变", list(anomalies.COMMON))]
    faults = anomalies.header_faults(spark.createDataFrame(heads + bad, "file string, position int, sheet string, cells array<string>"))
    assert {r.file: r.fault for r in faults.collect()} == {"g": "headers", "h": "sheets"}


def test_tables_conform_and_leak_nothing(spark):
    from tremora.operators import filters
    from tremora.sources import contracts

    found = anomalies.observations(domains.report_rows(spark, "/root/testdata/sf0.001"))
    table = contracts.conform(anomalies.observation_table(found, "weekly"), "anomaly_observation")
    assert contracts.null_faults(table, "anomaly_observation").count() == 0 and table.count() == found.count()
    for rows, name in ((anomalies.period_table(found, "weekly"), "anomaly_report_period"), (anomalies.entity_audit(found), "anomaly_entity_audit")):
        assert contracts.null_faults(contracts.conform(rows, name), name).count() == 0
    quake = spark.sql("select timestamp'2024-01-01 00:00:00' as origin_time_utc, timestamp'2024-01-01 00:00:00' as available_at, array('publication_time_assumed_origin_time') as quality_flags")
    early = spark.sql("select true as historical_model_eligible union all select false")
    good = filters.leakage(table, [quake], [early.filter("not historical_model_eligible")], [])
    assert good["anomaly_available_at_rule"] == good["anomaly_occurrence_time_precision"] == good["earthquake_available_at_assumption"] == good["historical_geology_early_use"] == 0
    bad = filters.leakage(table.withColumn("available_at", F.lit(None).cast("timestamp")), [quake.withColumn("quality_flags", F.array())], [early], [spark.sql("select true as model_feature_eligible")])
    assert bad["anomaly_available_at_rule"] == table.count() and (bad["earthquake_available_at_assumption"], bad["historical_geology_early_use"], bad["basemap_model_feature_use"]) == (1, 1, 1)
    days = spark.createDataFrame([(1, True, 4.0, 1.0, 1.0), (2, True, 4.0, 1.0, 9.0), (3, True, 4.0, 0.5, 0.5)], "event_id int, inside_external_buffer boolean, magnitude double, origin_day double, available_day double")
    assert [r.event_id for r in filters.fit_parents(days, 4.0, 1.0, 5.0).collect()] == [1] and {r.event_id for r in filters.score_parents(days, 4.0, 5.0, 4.5).collect()} == {1, 2}


def test_text_sources_are_checked(spark, tmp_path):
    from tremora.sources import texts

    (tmp_path / "a.gmt").write_text("# first\n> one\n# note\n100 30\n# more\n101 31\n")
    r = texts.parse_segments(texts.numbered_lines(spark, str(tmp_path / "a.gmt"))).first()
    assert (r.header, r.comments, r.delimiter_line) == ("one", ["note", "more"], 2)
    rows = spark.createDataFrame([(2024, 1, 1, 0, 0, 60.0, 100.0, 30.0, 10.0, 4.0, "x"), (2024, 1, 1, 0, 0, 1.0, 200.0, 30.0, 10.0, 4.0, "x"), (2024, 1, 1, 0, 0, 1.0, 100.0, 30.0, None, 4.0, " ")], ", ".join(f"{c} {'string' if c == 'place' else 'double' if c in ('second', 'longitude', 'latitude', 'depth', 'magnitude') else 'int'}" for c in texts.COLUMNS))
    assert sorted(r.fault for r in texts.column_faults(rows).collect()) == ["coordinates", "missing depth,place"]
    with pytest.raises(ValueError):
        texts.column_faults(rows.drop("place"))
    found = spark.createDataFrame([("v", 7, 0.0), ("v", 7, 7.0), ("v", 7, 7.0), ("v", 7, 13.0)], "partition string, horizon int, issue_day double")
    faults = texts.calendar_faults(found, [float(x) for x in range(15)], (7,))
    assert sorted((r.issue_day, r.side) for r in faults.collect()) == [(7.0, "calendar"), (13.0, "calendar"), (14.0, "greedy")]
    (tmp_path / "b").symlink_to(tmp_path / "a.gmt")
    assert files.links([str(tmp_path / "a.gmt"), str(tmp_path / "b"), "hdfs://x/y"]) == [str(tmp_path / "b")]
    recorded = files.inventory(spark, {"a": str(tmp_path / "a.gmt")})
    assert files.stable(spark, str(tmp_path / "a.gmt"), recorded).count() == 1
    (tmp_path / "a.gmt").write_text("other")
    assert files.stable(spark, str(tmp_path / "a.gmt"), spark.createDataFrame([("x", "y")], "path string, sha256 string")).count() == 0


# --- horizons, fits and futures ------------------------------------------------------------------------------------


def test_parents_end_strictly_and_pairs_are_told_apart(spark):
    schema = "event_id int, origin_day double, available_day double, magnitude double, x_km double, y_km double, inside_study_area boolean, inside_external_buffer boolean"
    events = spark.createDataFrame([(1, 5.0, 5.0, 4.0, 0.0, 0.0, True, True), (2, 5.1, 5.1, 4.0, 0.0, 0.0, True, True), (3, 20.0, 20.0, 4.0, 0.0, 0.0, True, True)], schema)
    plan = spark.createDataFrame([(7.0, 15.0)], "horizon double, issue_day double")
    assert {r.event_id for r in horizons.score_parents(events, plan, 4.0, 10.0).collect()} == {2, 3}
    assert [r.event_id for r in horizons.targets(events, plan, 4.0).collect()] == [3]
    rows = [(0.0, 7.0, 15.0, "uniform", 1, 11, 1.0, -5.0), (0.0, 7.0, 15.0, "a", 1, 11, 1.0, -4.0), (0.0, 7.0, 15.0, "b", 1, 12, 1.0, -4.0)]
    got = {r.model: (r.gain, r.unpaired) for r in horizons.comparisons(spark.createDataFrame(rows, "delay double, horizon double, issue_day double, model string, n int, events long, compensator double, log_likelihood double")).collect()}
    assert got == {"a": (1.0, 0), "b": (None, 1)}


def test_audit_and_uncertainty():
    bounds = np.array([[-5.0, 5.0]] * 5)
    at = np.log([2.0, 0.2, 1.0, 0.1, 0.3])
    f = lambda x: float(((x - at) ** 2).sum() * 50)
    good = [(at + 1e-9 * i, f(at + 1e-9 * i), True) for i in range(5)]
    judged = fitting.audit(f, good, bounds)
    assert judged.stable and judged.converged == 5 and judged.condition == pytest.approx(1, rel=1e-3)
    out = fitting.uncertainty(etas.Parameters(2.0, 0.2, 1.0, 0.1, 1.3), judged, etas.Spec(beta=2.0, mc=3.0, most=7.0))
    assert out["mu"][1] == pytest.approx(0.2, rel=1e-3) and out["p"][1] == pytest.approx(0.03, rel=1e-3) and out["branching_ratio"][2] < out["branching_ratio"][0] < out["branching_ratio"][3]
    assert fitting.audit(f, good[:3], bounds).reasons == ("starts",) and set(fitting.audit(f, [], bounds).reasons) == {"starts", "agreement", "curvature"}
    with pytest.raises(ValueError):
        fitting.uncertainty(etas.Parameters(), fitting.audit(f, good[:3], bounds), etas.Spec())
    for a in (0.5, 1.9999, 2.0, 2.0001, 3.0):
        slope = (fitting.branching(1.0, a + 1e-5, 2.0, 4.0) - fitting.branching(1.0, a - 1e-5, 2.0, 4.0)) / 2e-5
        assert fitting.branching_slope(a, 2.0, 4.0) == pytest.approx(slope, rel=1e-5)


def test_futures_by_issue(spark):
    schema = "event_id string, origin_day double, available_day double, magnitude double, x_km double, y_km double, inside_external_buffer boolean"
    events = spark.createDataFrame([("a", 0.0, 0.0, 6.0, 0.0, 0.0, True), ("b", 4.0, 30.0, 6.0, 0.0, 0.0, True)], schema)
    args = (etas.Spec(mc=4.0, most=7.0), etas.Parameters(mu=1.0), 10.0, 3, events, 50.0)
    got = simulation.futures(events, [1.0, 5.0], *args)
    rows = simulation.in_order(got).collect()
    assert {(r.issue_day, r.replicate) for r in rows} == {(i, k) for i in (1.0, 5.0) for k in range(3)} and not any(r.event_id.startswith("b/") for r in rows)
    assert sorted(rows) == sorted(simulation.futures(events.repartition(3), [5.0, 1.0], *args).collect())
    counts = got.groupBy("issue_day", "replicate").agg(F.count("*").alias("n")).withColumn("horizon", F.lit(10.0))
    cells = spark.createDataFrame([(1.0, 10.0, "c", 0.5)], "issue_day double, horizon double, cell_id string, expected double")
    assert simulation.ensemble(counts, cells).groupBy("record_kind").count().count() == 2
    draw = simulation.kde_sampler(np.array([0.0]), np.array([0.0]), 1.0, lambda x, y: "outside", most=10)
    with pytest.raises(RuntimeError):
        draw(np.random.default_rng(0))


# --- publication ---------------------------------------------------------------------------------------------------


def test_documents_are_typed():
    assert publication.plain({"b": np.float32(0.5), "a": [np.int64(1), pd.Timestamp("2024-01-01", tz="UTC").to_pydatetime()]}) == {"a": [1, "2024-01-01T00:00:00Z"], "b": 0.5}
    assert publication.plain_mapping(etas.Parameters())["mu"] == 1.0
    for wrong in (float("nan"), {1: 2}, b"x", {"a": [object()]}):
        with pytest.raises((TypeError, ValueError)):
            publication.plain(wrong)
    assert publication.typed_json({"é": 0.1}) == publication.typed_json({"e\u0301": 0.1}) != publication.typed_json({"é": 0.1 + 1e-17 + 1e-16})
    for wrong in ({publication.TYPED: 1}, {"é": 1, "e\u0301": 2}, float("inf")):
        with pytest.raises(ValueError):
            publication.typed_json(wrong)


def test_bundles_fixed_files_and_registry(spark, tmp_path):
    home = publication.publish(tmp_path, "model", {"a": 0.1}, {"x/y.json": b"1"})
    assert publication.publish(tmp_path, "model", {"a": 0.1}, {"x/y.json": b"1"}) == home and publication.verify(home) == []
    assert sorted(p.name for p in home.parent.iterdir()) == [home.name]
    with pytest.raises(FileExistsError):
        publication.publish(tmp_path, "model", {"a": 0.1}, {"x/y.json": b"2"})
    (home / "x/y.json").write_bytes(b"3")
    (home / "more").write_bytes(b"3")
    assert publication.verify(home) == ["unknown more", "changed x/y.json"]
    for kind, name in (("other", "x"), ("model", "../x"), ("model", "/x")):
        with pytest.raises(ValueError):
            publication.publish(tmp_path, kind, {}, {name: b"1"})
    with publication.locked(home), pytest.raises(RuntimeError), publication.locked(home):
        pass
    assert publication.publish_fixed(tmp_path, "r.json", b"1") and not publication.publish_fixed(tmp_path, "r.json", b"1")
    with pytest.raises(FileExistsError):
        publication.publish_fixed(tmp_path, "r.json", b"2")
    entries = [{"model": "kde", "snapshot": "s1", "status": "scored", "gain": 0.5}, {"model": "kde", "snapshot": "s2", "status": "failed", "reasons": ["starts"]}]
    payload = publication.registry(entries[::-1], ("kde",), ("s1", "s2"))
    publication.publish_registry(tmp_path, payload, "registry.json", "report.md")
    assert b"| kde | s1 | scored | 0.500000 |" in (tmp_path / "report.md").read_bytes()
    with pytest.raises(ValueError, match="not accounted"):
        publication.registry(entries[:1], ("kde",), ("s1", "s2"))
    spoken = publication.registry([entries[0], entries[1] | {"reasons": ["a Probability"]}], ("kde",), ("s1", "s2"))
    with pytest.raises(ValueError, match="probabilities"):
        publication.publish_registry(tmp_path, spoken, "second.json", "second.md")
    assert not (tmp_path / "second.json").exists()
    schema = pa.schema([("id", pa.int64())])
    publication.write_arrow(spark.range(10).orderBy("id"), schema, tmp_path / "t.arrow", rows=4)
    with pa.OSFile(str(tmp_path / "t.arrow")) as f:
        assert pa.ipc.open_file(f).num_record_batches == 3 and pa.ipc.open_file(f).read_all().column("id").to_pylist() == list(range(10))


# --- ingest --------------------------------------------------------------------------------------------------------


def test_stage_one_and_its_checks(spark, tmp_path):
    (tmp_path / "raw.txt").write_text("raw")
    (tmp_path / "area.json").write_text(json.dumps(SQUARE))
    sources = {"raw": str(tmp_path / "raw.txt")}
    files.write_inventory(files.inventory(spark, sources).select("source_id", "path", "name", "bytes", "sha256"), str(tmp_path / "inventory"))
    given = {"sources": sources, "inventory": str(tmp_path / "inventory"), "output": str(tmp_path / "out"), "study_area": str(tmp_path / "area.json"), "study_area_km2": 40_000, "project": False}
    (tmp_path / "settings.json").write_text(json.dumps(given))
    settings = ingest.strict(ingest.Settings, ingest.load_mapping(spark, str(tmp_path / "settings.json")))
    for wrong in ({"more": 1}, {"inventory": 3}, {"buffer_km": True}):
        with pytest.raises(ValueError):
            ingest.strict(ingest.Settings, given | wrong)
    with pytest.raises(ValueError):
        ingest.strict(ingest.Settings, {"sources": {}})
    rows = [(1, 0.0, 0.0, 4.0, 0.0, 0.0, "m3"), (2, 0.00001, 0.00001, 4.0, 0.0, 0.0, "m5"), (3, 1.0, 1.0, 4.0, 300.0, 0.0, "m3")]
    records = spark.createDataFrame(rows, "event_id int, origin_day double, available_day double, magnitude double, x_km double, y_km double, source string")
    done = ingest.ingest(spark, settings, records)
    assert done["status"] == "ok" and done["events"] == 2 and done["classes"] == {"merged": 1}
    assert ingest.validate(spark, settings, done["fingerprint"]) == [] and ingest.validate(spark, settings, ["0", "0"]) == ["contents"]
    sealed = ingest.seal(spark, sources, {"a": 1})
    (tmp_path / "raw.txt").write_text("changed")
    assert ingest.ingest(spark, settings, records)["status"] == "inventory_differs"
    assert ingest.seal_faults(spark, sealed, sources, {"a": 1}) == ["files"] and ingest.seal_faults(spark, sealed, sources, {"a": 2}) == ["files", "parameters"]


def test_snapshots_gates_and_orders(spark):
    folds = [(10.0 * i, 10.0 * i, 10.0 * i + 5) for i in range(4)]
    five = ingest.snapshots(spark, folds, 50.0, (51.0, 60.0))
    assert [r.snapshot for r in five.orderBy("fit_end").collect()] == list(ingest.SNAPSHOTS)
    with pytest.raises(ValueError):
        ingest.snapshots(spark, folds[:3], 50.0, (51.0, 60.0))
    gate = ingest.global_gate(spark.createDataFrame([("a", 75.0, True, None), ("b", 75.0, False, "l1"), ("a", 100.0, True, None)], "snapshot string, h double, passed boolean, reason string"))
    assert {r.h: (r.passed, r.reasons) for r in gate.collect()} == {75.0: (False, "b: l1"), 100.0: (True, "")}
    evidence = spark.createDataFrame([("m", s, "scored") for s in ingest.SNAPSHOTS[:3]] + [("m", "fold_1", "failed"), ("m", "other", "scored")], "model string, snapshot string, status string")
    assert {(r.snapshot, r.fault) for r in ingest.unaccounted(evidence, five).collect()} == {("fold_1", "scored_and_failed"), ("fold_4", "unaccounted"), ("final_validation", "unaccounted"), ("other", "unplanned")}
    listed = spark.createDataFrame([("f", 1, 1.0, 5), ("f", 2, 1.0, 4), ("f", 3, 2.0, 1)], "file string, place int, origin_day double, event_id int")
    assert [r.place for r in ingest.out_of_order(listed).collect()] == [2]
    records = spark.createDataFrame([(1, 2, 1, "x"), (1, 1, 9, "y"), (1, 2, 1, "a")], "event_id int, priority int, source_row int, record_id string")
    assert ingest.members(records).first().record_ids == ["y", "a", "x"]
    mine = spark.createDataFrame([(1,), (2,)], "event_id int")
    parents = spark.createDataFrame([(2, True, 5.0), (3, True, 5.0), (4, False, 5.0)], "event_id int, inside_study_area boolean, origin_day double")
    assert {(r.event_id, r.only) for r in ingest.targets_missing(mine, parents, 0.0, 9.0).collect()} == {(1, "target"), (3, "parent")}
    plan = ingest.stage_two({"seal": "s"}, five, (75.0,), (50.0, 25.0), 128)
    assert len(plan["units"]) == 5 * 2 + 5 + 1


def test_flags_are_worked_out_once(spark):
    """Counting flags plans no filter that works them out before they are, and normalises the cells in one place."""
    from tremora.plans.domains import anomaly_flags

    plan = anomaly_flags(spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter (size(" not in plan and plan.count("regexp_replace(lambda") == 1
