"""Contracts, sinks and the background study."""

import json

import pytest
from pyspark.sql import functions as F

from tremora import cli
from tremora.plans import background, view
from tremora.sources import contracts, sinks


def grid_rows(spark, n=3):
    return spark.range(n).select(F.lit(25.0).alias("cell_size_km"), F.concat(F.lit("g"), "id").alias("cell_id"), F.lit(0).alias("row"), F.col("id").alias("column"), F.lit(1.0).alias("representative_x_km"), F.lit(2.0).alias("representative_y_km"), F.lit(625.0).alias("clipped_area_km2"))


def test_contract_is_closed(spark):
    rows = grid_rows(spark)
    assert contracts.matches(contracts.conform(rows, "integration_grid").schema, "integration_grid")
    with pytest.raises(ValueError, match="not in the contract"):
        contracts.conform(rows.withColumn("more", F.lit(1)), "integration_grid")
    with pytest.raises(ValueError, match="missing"):
        contracts.conform(rows.drop("row"), "integration_grid")
    assert all(set(contracts.order(n)) <= {c for c, _, _ in contracts.fields(n)} for n in contracts.COLUMNS)
    assert json.loads(contracts.document("future_ensemble"))["fields"][4] == {"name": "replicate_index", "type": "smallint", "nullable": True}


def test_tables_round_trip_and_tampering_shows(spark, tmp_path):
    path = str(tmp_path / "grid")
    sinks.write_table(grid_rows(spark), "integration_grid", path)
    mark = sinks.fingerprint(spark.read.parquet(path))
    assert sinks.verify(spark, path, "integration_grid", mark) == []
    assert sinks.fingerprint(spark.read.parquet(path).orderBy(F.desc("column"))) == mark
    assert sinks.fingerprint(spark.read.parquet(path).unionByName(spark.read.parquet(path))) != mark
    other = str(tmp_path / "other")
    sinks.write_table(grid_rows(spark, 4), "integration_grid", other, files=2)
    assert sinks.verify(spark, other, "integration_grid", mark) == ["contents"]
    with pytest.raises(ValueError, match="nulls"):
        sinks.write_table(grid_rows(spark).withColumn("cell_id", F.lit(None)), "integration_grid", str(tmp_path / "bad"))
    assert b"integration_grid" in sinks.data_catalog({"integration_grid": (path, mark)})


def test_bundles_are_addressed_by_content(tmp_path):
    home = sinks.publish_bundle(tmp_path, {"a": 1}, {"x.json": b"1"})
    assert sinks.publish_bundle(tmp_path, {"a": 1}, {"x.json": b"1"}) == home
    with pytest.raises(FileExistsError):
        sinks.publish_bundle(tmp_path, {"a": 1}, {"x.json": b"2"})
    with pytest.raises(ValueError):
        sinks.publish_bundle(tmp_path, {"a": 2}, {"../x": b"2"})
    assert b"fail" in sinks.quality_report([{"n": 1}], {"rule": 1})


def test_background_study(spark):
    events = view.catalog(spark, "/root/testdata/sf0.01")
    first = view.FIRST_DAY
    folds = tuple((first + 15 + 3 * i, first + 18 + 3 * i) for i in range(4))
    out = background.run(events, background.Study(first, first + 15, folds, (first + 27, first + 31), least=5.0))
    assert out.status == "ok" and out.bandwidth in (75.0, 100.0, 150.0, 200.0, 300.0) and out.attempts["kde"] == "ok" and out.chosen in ("uniform", "kde")
    sparse = background.run(events.limit(50), background.Study(first, first + 15, folds, (first + 27, first + 31)))
    assert sparse.status == "no_eligible_stratum" and sparse.attempts == {"uniform": "ok", "kde": "not_run", "etas": "not_run"}


def test_deferred_commands_say_so(capsys):
    assert cli.main(["train"]) == 2 and "deferred" in capsys.readouterr().out


def test_five_snapshots(spark):
    from tremora.plans import ingest
    from tremora.sources import publication

    events, first = view.catalog(spark, "/root/testdata/sf0.01"), view.FIRST_DAY
    five = ingest.snapshots(spark, [(first + 10 + i, first + 10 + i, first + 14 + i) for i in range(4)], first + 20, (first + 21, first + 31))
    out = background.kde_pipeline(events, five, 6.0, first, (view.STUDY_X, view.STUDY_Y), sizes=(200.0, 100.0), bandwidths=(300.0,))
    gate = {r.h: (r.passed, r.snapshots) for r in out["gate"].collect()}
    assert set(gate) == {300.0} and gate[300.0][1] == 5 and (out["chosen"] == 300.0) == gate[300.0][0]
    assert out["scores"].count() == 5 * sum(passed for passed, _ in gate.values())
    few = events.filter("magnitude >= 7")
    tried = background.etas_pipeline(few, five, 7.0, 1.0, first, (view.STUDY_X, view.STUDY_Y), cell_km=200.0, starts=1)
    assert [t["snapshot"] for t in tried] == list(ingest.SNAPSHOTS) and all(t["status"] == "scored" or t["reasons"] for t in tried)
    evidence = spark.createDataFrame([(t["model"], t["snapshot"], t["status"]) for t in tried], "model string, snapshot string, status string")
    assert ingest.unaccounted(evidence, five).count() == 0
    assert len(publication.registry([{k: t[k] for k in ("model", "snapshot", "status", "reasons", "gain")} for t in tried], ("etas",), ingest.SNAPSHOTS)["entries"]) == 5
