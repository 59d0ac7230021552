"""The background study as one plan: completeness, uniform and kernel models, the self-exciting model, selection. An
expected scientific failure is a result with its code; anything else raises."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.operators import completeness, etas, evaluation, filters, fitting, grid, poisson
from tremora.plans import ingest


@dataclass(frozen=True)
class Study:
    start: float
    fit_end: float
    folds: tuple[tuple[float, float], ...]
    validation: tuple[float, float]
    half_x: float = 600.0
    half_y: float = 400.0
    cell_km: float = 100.0
    block_days: float = 7.0
    least_block: int = 200
    bandwidths: tuple[float, ...] = poisson.BANDWIDTHS
    least: float | None = None  # magnitude of completeness, where it is not to be estimated

    @property
    def area(self) -> float:
        return 4 * self.half_x * self.half_y


@dataclass
class Outcome:
    status: str = "ok"
    mc: float | None = None
    b: float | None = None
    bandwidth: float | None = None
    gains: dict = field(default_factory=dict)
    etas: fitting.Fit | None = None
    attempts: dict = field(default_factory=dict)
    chosen: str | None = None
    passed: bool = False


def kde_gains(catalog: DataFrame, study: Study, mc: float) -> DataFrame:
    """h, fold (folds, then validation as the last) and gain an event over the uniform model, for all bandwidths from
    one set of distances."""
    cells = grid.cell_array(grid.cell_values(study.cell_km, study.half_x, study.half_y))
    training = filters.training(catalog, mc, study.start, study.fit_end)
    masses = poisson.kde_cell_masses(training, cells, study.bandwidths)
    norms = masses.groupBy("h").agg(F.first("normaliser").alias("normaliser"))
    spans = [*study.folds, study.validation]
    fold = F.coalesce(*[F.when((F.col("origin_day") > a) & (F.col("origin_day") <= b), i) for i, (a, b) in enumerate(spans)])
    targets = catalog.filter(F.col("inside_study_area") & (F.col("magnitude") >= mc)).withColumn("fold", fold).filter("fold is not null")
    scored = poisson.kde_log_densities(targets, training, norms, study.bandwidths).join(targets.select("event_id", "fold"), "event_id")
    return scored.groupBy("h", "fold").agg((F.avg("log_density") - F.log(F.lit(1 / study.area))).alias("gain"), F.count("*").alias("n"))


def run(catalog: DataFrame, study: Study) -> Outcome:
    out = Outcome(attempts={"uniform": "ok", "kde": "not_run", "etas": "not_run"})
    inside = catalog.filter("inside_study_area").filter(F.col("available_day") <= study.fit_end)
    blocks = completeness.temporal_blocks(inside, study.start, study.fit_end, study.block_days, study.least_block, study.block_days / 2)
    verdict = completeness.gate(blocks.filter("eligible").select("estimate")).first()
    out.mc = study.least or verdict.mc
    if verdict.status != "ok" and study.least is None:
        out.status = verdict.status
        return out
    out.b = completeness.b_values(inside, (out.mc,)).first().b
    gains = kde_gains(catalog, study, out.mc).cache()
    folds = gains.filter(F.col("fold") < len(study.folds)).select("h", "fold", F.col("gain").alias("score"))
    chosen = poisson.select_bandwidth(folds).filter("selected").collect()
    if not chosen:
        out.status = "evidence_insufficient"
        return out
    out.bandwidth, out.attempts["kde"] = chosen[0].h, "ok"
    mine = gains.filter(F.col("h") == out.bandwidth)
    by_fold = mine.filter(F.col("fold") < len(study.folds)).select(F.lit("kde").alias("model"), "fold", "gain")
    final = mine.filter(F.col("fold") == len(study.folds)).select(F.lit("kde").alias("model"), "gain", F.lit(1).alias("complexity"), F.lit(True).alias("stable"))
    spec = etas.Spec.from_b(out.b, mc=out.mc, lag=study.fit_end - study.start)
    parents = catalog.filter(F.col("inside_external_buffer") & (F.col("magnitude") >= out.mc) & (F.col("origin_day") <= study.fit_end))
    targets = filters.targets(catalog, out.mc, study.start, study.fit_end)
    cells = grid.cells(catalog.sparkSession, study.cell_km, study.half_x, study.half_y)
    try:
        out.etas = fitting.fit(fitting.prepare(targets, parents, cells, spec, study.start, study.fit_end, study.area), spec)
        out.attempts["etas"] = "ok" if out.etas.stable else "failed_" + out.etas.reason
    except ValueError as failure:  # too large for the driver, or no valid gradient: an attempt that failed
        out.attempts["etas"] = f"failed_{failure}"
    out.gains = {r.fold: r.gain for r in mine.collect()}
    out.passed = any(r.passed for r in evaluation.g1(by_fold, final, min(3, len(study.folds))).collect())
    uniform = by_fold.select(F.lit("uniform").alias("model"), "fold", F.lit(0.0).alias("gain"))
    zero = final.select(F.lit("uniform").alias("model"), F.lit(0.0).alias("gain"), F.lit(0).alias("complexity"), F.lit(True).alias("stable"))
    picked = evaluation.select_model(by_fold.unionByName(uniform), final.unionByName(zero)).filter("chosen").collect()
    out.chosen = picked[0].model if picked else None
    return out


def kde_pipeline(catalog: DataFrame, snapshots: DataFrame, mc: float, start: float, half: tuple[float, float], sizes: tuple[float, ...] = (50.0, 25.0, 12.5), bandwidths: tuple[float, ...] = poisson.BANDWIDTHS) -> dict:
    """Every bandwidth at every snapshot (snapshot, fit_end, start, end, is_validation): fit, gate on three grids, score.
    A bandwidth is scored only if it passes in all snapshots, and has no gain where a snapshot has no event; the choice
    is made on the folds alone.

    Returns gate and scores as tables, and the chosen bandwidth or None."""
    area = 4 * half[0] * half[1]
    gates = scores = None
    rows = snapshots.orderBy("fit_end", "snapshot").collect()  # five of them
    norms = {}
    for s in rows:
        training = filters.training(catalog, mc, start, s.fit_end)
        masses = {size: poisson.kde_cell_masses(training, grid.cell_array(grid.cell_values(size, *half)), bandwidths).select("h", "row", "column", "raw", "normaliser") for size in sizes}
        norms[s.snapshot] = masses[min(sizes)].groupBy("h").agg(F.first("normaliser").alias("normaliser"))
        for a, b in zip(sizes, sizes[1:], strict=False):
            one = grid.convergence_by(masses[a], masses[b], "raw", ["h"]).select(F.lit(s.snapshot).alias("snapshot"), "h", F.coalesce("passed", F.lit(False)).alias("passed"), F.lit(f"{a:g} to {b:g} km").alias("reason"))
            gates = one if gates is None else gates.unionByName(one)
    evidence = gates.groupBy("snapshot", "h").agg(F.bool_and("passed").alias("passed"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("reason")))), ", ").alias("reason"))
    gate = ingest.global_gate(evidence).cache()
    passed = gate.filter("passed").select("h")
    for s in rows:
        training = filters.training(catalog, mc, start, s.fit_end)
        targets = filters.targets(catalog, mc, s.start, s.end)
        logs = poisson.kde_log_densities(targets, training, norms[s.snapshot], bandwidths).join(F.broadcast(passed), "h")  # a few bandwidths
        one = logs.groupBy("h").agg(F.count("*").alias("n"), (F.avg("log_density") + F.log(F.lit(area))).alias("gain"))
        one = passed.join(one, "h", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "snapshot": F.lit(s.snapshot), "is_validation": F.lit(s.is_validation)})
        scores = one if scores is None else scores.unionByName(one)
    scores = scores.cache()
    chosen = poisson.select_bandwidth(scores.filter("not is_validation").select("h", F.col("snapshot").alias("fold"), F.col("gain").alias("score"))).filter("selected").collect()
    return {"gate": gate, "scores": scores, "chosen": chosen[0].h if chosen else None}


def etas_pipeline(catalog: DataFrame, snapshots: DataFrame, mc: float, b: float, start: float, half: tuple[float, float], cell_km: float = 100.0, starts: int = 5) -> list[dict]:
    """An attempt at every snapshot, in order. One that fails is recorded with its reasons and does not stop the others:
    model, snapshot, status, reasons, gain (the log-likelihood of a stable fit an event) and the parameters."""
    spark, area, out = catalog.sparkSession, 4 * half[0] * half[1], []
    cells = grid.cells(spark, cell_km, *half)
    for s in snapshots.orderBy("fit_end", "snapshot").collect():
        spec = etas.Spec.from_b(b, mc=mc, lag=s.fit_end - start)
        entry = {"model": "etas", "snapshot": s.snapshot, "status": "failed", "gain": None, "parameters": None}
        try:
            targets = filters.targets(catalog, mc, start, s.fit_end)
            found = fitting.fit(fitting.prepare(targets, filters.fit_parents(catalog, mc, start, s.fit_end), cells, spec, start, s.fit_end, area), spec, model=s.model, starts=starts)
        except (ValueError, ArithmeticError) as failure:
            out.append(entry | {"reasons": [str(failure)]})
            continue
        if not found.stable:
            out.append(entry | {"reasons": list(found.audit.reasons)})
            continue
        scored = filters.targets(catalog, mc, s.start, s.end)
        parents = filters.score_parents(catalog, mc, s.end, spec.lag)
        likelihood = etas.log_likelihood(scored, parents, cells, spec, found.parameters, s.start, s.end, area).first()
        gain = float(likelihood.log_likelihood) / likelihood.n if likelihood.n else 0.0
        out.append(entry | {"status": "scored", "reasons": [], "gain": gain, "parameters": found.parameters})
    return out
