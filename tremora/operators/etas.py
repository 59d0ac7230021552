"""Self-exciting rates: intensities, likelihood, cell masses and fields, all from radius joins and sums."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremora.functions import kernels
from tremora.operators.joins import near_cells, overlap_window, radius_join


@dataclass(frozen=True)
class Spec:
    """Constants of a model. b-value and beta are tied: beta = b ln 10."""

    mc: float = 3.2
    d: float = 25.0
    q: float = 1.5
    gamma: float = 1.0
    cutoff: float = 300.0
    lag: float = 3650.0
    beta: float = 2.0
    most: float = 9.5

    @classmethod
    def from_b(cls, b: float, **given) -> Spec:
        return cls(beta=b * math.log(10), **given)


@dataclass(frozen=True)
class Parameters:
    """mu: background rate a day; the others shape the triggered part."""

    mu: float = 1.0
    k: float = 0.2
    alpha: float = 1.0
    c: float = 0.05
    p: float = 1.2


def trigger(dt: Column, r: Column, m: Column, s: Spec, w: Parameters) -> Column:
    return kernels.productivity(m, w.k, w.alpha, s.mc) * kernels.omori_density(dt, w.c, w.p) * kernels.spatial_density(r, m, s.d, s.q, s.gamma, s.mc, s.cutoff)


def pairs(targets: DataFrame, parents: DataFrame, s: Spec) -> DataFrame:
    """Event-parent pairs that can interact: the sparse table of a likelihood, built once and kept for a fit."""
    return radius_join(targets, parents, s.cutoff, s.lag)


def intensities(targets: DataFrame, pair_table: DataFrame, s: Spec, w: Parameters, background: Column) -> DataFrame:
    """event_id and intensity: background plus the sum over visible parents; targets without any keep the former."""
    excited = pair_table.groupBy(F.col("t_event_id").alias("event_id")).agg(F.sum(trigger(F.col("dt"), F.col("r"), F.col("p_magnitude"), s, w)).alias("excited"))
    return targets.join(excited, "event_id", "left").withColumn("intensity", background + F.coalesce("excited", F.lit(0.0)))


def density_at(s: Spec) -> Column:
    return kernels.spatial_density(F.col("r"), F.col("magnitude"), s.d, s.q, s.gamma, s.mc, s.cutoff)


def parent_masses(parents: DataFrame, cells: DataFrame, s: Spec) -> DataFrame:
    """spatial_mass of each parent: its density summed over the grid's cells within the cutoff; 0 where there is none.
    cells: row, column, area_km2, x_km and y_km, as grid.cells gives them."""
    met = near_cells(parents.select("event_id", "x_km", "y_km", "magnitude"), cells, s.cutoff)
    sums = met.groupBy("event_id").agg(F.sum(density_at(s) * F.col("c_area_km2")).alias("mass"))
    return parents.select("event_id").join(sums, "event_id", "left").select("event_id", F.coalesce("mass", F.lit(0.0)).alias("spatial_mass"))


def on_grid(cells: DataFrame, sums: DataFrame, value: str) -> DataFrame:
    """Sums by (c_row, c_column) on every cell of the grid, 0 where there is none."""
    named = sums.withColumnsRenamed({"c_row": "row", "c_column": "column"})
    return cells.select("row", "column", "area_km2").join(named, ["row", "column"], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def acting(parents: DataFrame, start: float, end: float, s: Spec, w: Parameters) -> DataFrame:
    """Parents with ``expected``, their mean number of offspring in the interval before space is looked at."""
    windows = overlap_window(parents, start, end, s.lag)
    return windows.withColumn("expected", kernels.productivity(F.col("magnitude"), w.k, w.alpha, s.mc) * (kernels.omori_cdf(F.col("upper"), w.c, w.p) - kernels.omori_cdf(F.col("lower"), w.c, w.p)))


def log_likelihood(targets: DataFrame, parents: DataFrame, cells: DataFrame, s: Spec, w: Parameters, start: float, end: float, area: float, background_mass: float = 1.0) -> DataFrame:
    """One row: n, log_sum, background and trigger compensators, log_likelihood."""
    scored = intensities(targets, pairs(targets, parents, s), s, w, F.lit(w.mu / area)).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.log("intensity")), F.lit(0.0)).alias("log_sum"))
    active = acting(parents, start, end, s, w)
    excited = active.join(parent_masses(active, cells, s), "event_id").agg(F.coalesce(F.sum(F.col("expected") * F.col("spatial_mass")), F.lit(0.0)).alias("triggered"))
    out = scored.crossJoin(excited)  # one row each
    return out.withColumn("background", F.lit(w.mu * (end - start) * background_mass)).withColumn("log_likelihood", F.col("log_sum") - F.col("background") - F.col("triggered"))


def cell_masses(parents: DataFrame, cells: DataFrame, s: Spec, w: Parameters, start: float, end: float, area: float) -> DataFrame:
    """row, column and mass: expected events of each cell in the interval; the background's alone where no parent acts."""
    met = near_cells(acting(parents, start, end, s, w).select("x_km", "y_km", "magnitude", "expected"), cells, s.cutoff)
    sums = met.groupBy("c_row", "c_column").agg(F.sum(F.col("expected") * density_at(s) * F.col("c_area_km2")).alias("triggered"))
    return on_grid(cells, sums, "triggered").select("row", "column", (F.col("triggered") + w.mu * (end - start) / area * F.col("area_km2")).alias("mass"))


def field(parents: DataFrame, cells: DataFrame, s: Spec, w: Parameters, at: float, area: float) -> DataFrame:
    """row, column, area_km2, background, excited and intensity at one moment, from what was available then."""
    seen = parents.filter((F.col("origin_day") < at) & (F.col("origin_day") >= at - s.lag) & (F.col("available_day") <= at))
    met = near_cells(seen.select("x_km", "y_km", "magnitude", "origin_day"), cells, s.cutoff)
    sums = met.groupBy("c_row", "c_column").agg(F.sum(trigger(F.lit(at) - F.col("origin_day"), F.col("r"), F.col("magnitude"), s, w)).alias("excited"))
    return on_grid(cells, sums, "excited").select("row", "column", "area_km2", F.lit(w.mu / area).alias("background"), "excited", (F.col("excited") + w.mu / area).alias("intensity"))


def layer_summary(intensities_: DataFrame, value: str = "intensity") -> DataFrame:
    """cells, total (sum of value times area), least and greatest of a field."""
    return intensities_.agg(F.count("*").alias("cells"), F.sum(F.col(value) * F.col("area_km2")).alias("total"), F.min(value).alias("least"), F.max(value).alias("greatest"))
