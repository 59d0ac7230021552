"""Stage one as a whole: configuration, inventory, study area, catalogue, rules, tables; and the plan of stage two."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremora.operators import dedup, filters, study
from tremora.sources import contracts, files, publication, sinks

#: The five snapshots: four folds to choose by, and the last that is only validated on.
SNAPSHOTS = ("fold_1", "fold_2", "fold_3", "fold_4", "final_validation")


@dataclass(frozen=True)
class Settings:
    """What a run of stage one is told; unknown keys and wrong types are errors."""

    sources: dict
    inventory: str
    output: str
    study_area: str
    study_area_km2: float
    area_tolerance_km2: float = 1.0
    buffer_km: float = 300.0
    project: bool = True
    review: tuple = (300.0, 50.0, 0.5)
    auto: tuple = (5.0, 5.0, 0.1)


def load_mapping(spark: SparkSession, path: str) -> dict:
    """A JSON or, where a parser is installed, YAML document whose root is a mapping, wherever Spark reads it."""
    rows = spark.read.text(path, wholetext=True).head(2)
    if len(rows) != 1:
        raise ValueError(f"{path} is not one document")
    if path.lower().endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as missing:
            raise ValueError("no parser for YAML is installed; use JSON") from missing
        found = yaml.safe_load(rows[0].value)
    else:
        found = json.loads(rows[0].value)
    if not isinstance(found, dict):
        raise ValueError(f"the root of {path} is no mapping")
    return found


def strict(kind: type, given: dict):
    """An instance of a data class from a mapping with exactly its fields, those with defaults optional."""
    known = {f.name: f for f in fields(kind)}
    if unknown := sorted(set(given) - set(known)):
        raise ValueError(f"unknown settings {unknown}")
    ready = {}
    for name, value in given.items():
        wanted = {"str": str, "float": (int, float), "int": int, "bool": bool, "dict": dict, "tuple": (list, tuple)}[known[name].type]
        if not isinstance(value, wanted) or (isinstance(value, bool) and known[name].type != "bool"):
            raise ValueError(f"{name} is a {type(value).__name__}, not a {known[name].type}")
        ready[name] = tuple(value) if known[name].type == "tuple" else value
    try:
        return kind(**ready)
    except TypeError as missing:
        raise ValueError(str(missing)) from missing


def recheck(spark: SparkSession, settings: Settings) -> list[str]:
    """Differences between the sources as they are now and the recorded inventory."""
    now = files.inventory(spark, settings.sources)
    return [f"{r.source_id}: {r.fault} {r.path}" for r in files.faults(now, files.read_inventory(spark, settings.inventory), list(settings.sources)).collect()]


def rules(events: DataFrame, area: study.Area) -> dict[str, int]:
    """Violations of what must hold of every event, all 0 in a good run."""
    found = {r.rule: r.violations for r in filters.violations(events, {
        "available_before_origin": F.col("available_day") < F.col("origin_day"), "inside_but_not_in_buffer": F.col("inside_study_area") & ~F.col("inside_external_buffer"),
        "missing_time": F.col("origin_day").isNull(), "missing_magnitude": F.col("magnitude").isNull(),
    }).collect()}
    repeated = events.groupBy("event_id").agg(F.count("*").alias("n")).filter("n > 1").count()
    return found | {"repeated_id": repeated, "study_flag_differs": study.flag_faults(events, area).count()}


def out_of_order(events: DataFrame) -> DataFrame:
    """Rows of a catalogue file that break its order by origin and id; ``place`` is their number in the file."""
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("place")
    before = F.struct(F.lag("origin_day").over(w).alias("origin_day"), F.lag("event_id").over(w).alias("event_id"))
    rows = events.withColumn("__before", before)
    return rows.filter(F.col("__before.event_id").isNotNull() & (F.struct("origin_day", "event_id") < F.col("__before"))).drop("__before")


def members(records: DataFrame) -> DataFrame:
    """event_id and record_ids, the ids of its source records in order of priority, row and id."""
    listed = F.array_sort(F.collect_list(F.struct("priority", "source_row", "record_id")))
    return records.groupBy("event_id").agg(F.transform(listed, lambda x: x["record_id"]).alias("record_ids"))


def ingest(spark: SparkSession, settings: Settings, records: DataFrame) -> dict:
    """Physical events of two sources as a table, with everything that is checked on the way. records: event_id,
    origin_day, available_day, magnitude, x_km, y_km and source (m3 or m5).

    The inventory is checked before and after, so that a file that changes meanwhile fails the run."""
    if faults := recheck(spark, settings):
        return {"status": "inventory_differs", "faults": faults}
    area = study.load(spark, settings.study_area, settings.project)
    if faults := study.check(area, settings.study_area_km2, settings.area_tolerance_km2):
        return {"status": "study_area_differs", "faults": faults}
    placed = study.with_domains(records, area, settings.buffer_km)
    left, right = placed.filter("source = 'm3'"), placed.filter("source = 'm5'")
    pairs = dedup.candidates(left, right, settings.review, settings.auto)
    events = dedup.events(left, right, pairs).withColumn("sources", F.array_join("sources", "+"))
    path = f"{settings.output}/events"
    events.orderBy("origin_day", "event_id").write.mode("errorifexists").option("compression", "zstd").parquet(path)
    done = spark.read.parquet(path)
    broken = rules(done, area)
    if faults := recheck(spark, settings):
        return {"status": "inventory_changed", "faults": faults}
    status = "ok" if not any(broken.values()) else "rules_broken"
    return {"status": status, "events": done.count(), "fingerprint": [str(x) for x in sinks.fingerprint(done)], "rules": broken, "classes": {r.status: r["count"] for r in dedup.classified(pairs).groupBy("status").count().collect()}}


def validate(spark: SparkSession, settings: Settings, recorded: list[str]) -> list[str]:
    """What is wrong with a finished stage one: its inventory, its study area, its rules, its contents."""
    area = study.load(spark, settings.study_area, settings.project)
    done = spark.read.parquet(f"{settings.output}/events")
    faults = recheck(spark, settings) + study.check(area, settings.study_area_km2, settings.area_tolerance_km2)
    faults += [k for k, n in rules(done, area).items() if n]
    return faults + ([] if [str(x) for x in sinks.fingerprint(done)] == recorded else ["contents"])


def snapshots(spark: SparkSession, folds: list[tuple[float, float, float]], fit_end: float, validation: tuple[float, float]) -> DataFrame:
    """snapshot, fit_end, start, end, model and is_validation of the five snapshots, as rows. Raises where a fold's
    assessment begins before its fit ends, or there are not four."""
    if len(folds) != len(SNAPSHOTS) - 1:
        raise ValueError("four folds are needed")
    rows = [(n, *f, f"etas/{n}", False) for n, f in zip(SNAPSHOTS, folds, strict=False)] + [(SNAPSHOTS[-1], fit_end, *validation, f"etas/{SNAPSHOTS[-1]}", True)]
    if any(start < fitted or end <= start for _, fitted, start, end, _, _ in rows):
        raise ValueError("an assessment begins after its fit ends, and ends after it begins")
    return spark.createDataFrame(rows, "snapshot string, fit_end double, start double, end double, model string, is_validation boolean")


def global_gate(evidence: DataFrame) -> DataFrame:
    """From (snapshot, h, passed, reason): each bandwidth passes where it does in all snapshots; reasons in order."""
    said = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.concat_ws(": ", "snapshot", "reason"))))
    return evidence.groupBy("h").agg(F.bool_and("passed").alias("passed"), F.count_distinct("snapshot").alias("snapshots"), F.array_join(said, "; ").alias("reasons"))


def unaccounted(evidence: DataFrame, planned: DataFrame) -> DataFrame:
    """model, snapshot and fault: planned snapshots that are neither scored nor failed, that are both, and unplanned ones.
    evidence: model, snapshot, status."""
    each = evidence.groupBy("model", "snapshot").agg(F.collect_set("status").alias("as_"))
    wanted = evidence.select("model").distinct().join(F.broadcast(planned.select("snapshot")), how="cross")  # models by five snapshots
    both = wanted.withColumn("planned", F.lit(True)).join(each, ["model", "snapshot"], "full")
    fault = F.when(F.col("planned").isNull(), "unplanned").when(F.col("as_").isNull(), "unaccounted").when(F.size("as_") > 1, "scored_and_failed")
    return both.withColumn("fault", fault).filter("fault is not null").select("model", "snapshot", "fault")


def targets_missing(targets: DataFrame, parents: DataFrame, start: float, end: float) -> DataFrame:
    """Events that are target or study-area parent of (start, end] but not both."""
    within = parents.filter(F.col("inside_study_area") & (F.col("origin_day") > start) & (F.col("origin_day") <= end)).select("event_id")
    mine = targets.select("event_id")
    return mine.exceptAll(within).withColumn("only", F.lit("target")).unionByName(within.exceptAll(mine).withColumn("only", F.lit("parent")))


def seal(spark: SparkSession, inputs: dict[str, str], parameters: dict) -> dict:
    """What a run depends on: digests of its input files, its parameters and the versions it runs under."""
    rows = files.inventory(spark, inputs).select("source_id", "name", "bytes", "sha256").collect()
    body = {"files": [r.asDict() for r in rows], "parameters": publication.plain_mapping(parameters), "spark": spark.version}
    return body | {"seal": sinks.content_address(body)}


def seal_faults(spark: SparkSession, sealed: dict, inputs: dict[str, str], parameters: dict) -> list[str]:
    """Parts of a seal that no longer hold."""
    now = seal(spark, inputs, parameters)
    return [k for k in ("files", "parameters", "spark") if now[k] != sealed[k]]


def stage_two(sealed: dict, snapshots_: DataFrame, bandwidths: tuple[float, ...], grids: tuple[float, ...], replicates: int) -> dict:
    """The plan of stage two: every unit of work, and the address that its artifacts will have."""
    names = [r.snapshot for r in snapshots_.orderBy("fit_end", "snapshot").collect()]
    units = [{"step": "kde", "snapshot": s, "h": h, "grid_km": g} for s in names for h in bandwidths for g in grids] + [{"step": "etas", "snapshot": s} for s in names] + [{"step": "futures", "replicates": replicates}]
    return {"seal": sealed["seal"], "units": units, "address": sinks.content_address({"seal": sealed["seal"], "units": units})}


def deliverables(spark: SparkSession, project: str, grid_rows: DataFrame, intensity_rows: DataFrame, ensemble_rows: DataFrame, inputs: dict) -> dict:
    """The three tables of a result under their contracts, with fingerprints, and the bundle that names them."""
    made = {}
    for name, rows in (("integration_grid", grid_rows), ("representative_intensity", intensity_rows), ("future_ensemble", ensemble_rows)):
        path = str(Path(project) / "tables" / sinks.content_address(inputs) / name)
        sinks.write_table(rows, name, path)
        made[name] = (path, sinks.fingerprint(spark.read.parquet(path)))
        if faults := sinks.verify(spark, path, name, made[name][1]):
            raise ValueError(f"{name}: {faults}")
    documents = {f"contracts/{n}.json": contracts.document(n).encode() for n in made}
    home = publication.publish(project, "processed", inputs, {"catalog.json": sinks.data_catalog(made), **documents})
    return {"bundle": str(home), "tables": {n: p for n, (p, _) in made.items()}}
