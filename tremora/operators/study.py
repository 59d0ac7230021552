"""Study areas: polygons with holes on the plane, domain classes of points, grids clipped to them, largest overlaps.

A ring goes along with the Arrow functions; its points are looked up by squares first, so that a point far from the
boundary costs one table look-up whatever the number of vertices.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremora.functions import geodesy
from tremora.functions.textual import cell_id

#: Side in km of the squares by which points are looked up.
SQUARE = 25.0


@dataclass(frozen=True)
class Area:
    """Polygons as (outer ring, holes), counter-clockwise, in km; the last point does not repeat the first."""

    parts: tuple
    squares: dict = field(default_factory=dict, compare=False)

    @property
    def rings(self) -> list[np.ndarray]:
        return [r for outer, holes in self.parts for r in (outer, *holes)]

    @property
    def km2(self) -> float:
        return sum(geodesy.signed_area(outer) - sum(geodesy.signed_area(h) for h in holes) for outer, holes in self.parts)

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        every = np.concatenate([outer for outer, _ in self.parts])
        return (*every.min(0).tolist(), *every.max(0).tolist())

    def exact(self, points: np.ndarray) -> np.ndarray:
        """Whether each point lies in the area or on its boundary, from all edges."""
        out = np.zeros(len(points), bool)
        for outer, holes in self.parts:
            inside = geodesy.covers(outer, points)
            for hole in holes:
                inside &= ~geodesy.covers(hole, points) | (geodesy.ring_distance(hole, points) <= 1e-9)
            out |= inside
        return out

    def edge_squares(self) -> set[tuple[int, int]]:
        """Squares that the box of some edge meets: only there can two points of one square differ."""
        if "edges" not in self.squares:
            met = set()
            for ring in self.rings:
                for (x0, y0), (x1, y1) in zip(ring, np.roll(ring, -1, 0), strict=True):
                    for i in range(math.floor(min(x0, x1) / SQUARE), math.floor(max(x0, x1) / SQUARE) + 1):
                        met.update((i, j) for j in range(math.floor(min(y0, y1) / SQUARE), math.floor(max(y0, y1) / SQUARE) + 1))
            self.squares["edges"] = met
        return self.squares["edges"]

    def covers(self, points: np.ndarray) -> np.ndarray:
        """As exact(): a square that no edge meets is decided once, by its middle."""
        out = np.zeros(len(points), bool)
        if not len(points):
            return out
        edges, known = self.edge_squares(), self.squares.setdefault("whole", {})
        own = np.floor(points / SQUARE).astype(np.int64)
        different, place = np.unique(own, axis=0, return_inverse=True)
        place = place.ravel()
        keys = [tuple(k) for k in different.tolist()]
        fresh = [k for k in keys if k not in edges and k not in known]
        if fresh:
            known.update(zip(fresh, self.exact((np.array(fresh) + 0.5) * SQUARE).tolist(), strict=True))
        out[:] = np.array([known.get(k, False) for k in keys])[place]
        near = np.flatnonzero(np.array([k in edges for k in keys])[place])
        for a in range(0, len(near), 512):
            some = near[a : a + 512]
            out[some] = self.exact(points[some])
        return out

    def within(self, points: np.ndarray, buffer: float) -> np.ndarray:
        """Whether each point lies in the area or at most ``buffer`` km from it."""
        out = self.covers(points)
        x0, y0, x1, y1 = self.bounds
        near = np.flatnonzero(~out & (points[:, 0] >= x0 - buffer) & (points[:, 0] <= x1 + buffer) & (points[:, 1] >= y0 - buffer) & (points[:, 1] <= y1 + buffer))
        for a in range(0, len(near), 512):
            some = near[a : a + 512]
            out[some] = np.min([geodesy.ring_distance(r, points[some]) for r in self.rings], 0) <= buffer
        return out


def ring_of(points) -> np.ndarray:
    ring = np.asarray(points, np.float64)[:, :2]
    if len(ring) > 1 and (ring[0] == ring[-1]).all():
        ring = ring[:-1]
    if len(ring) < 3 or not np.isfinite(ring).all() or not geodesy.signed_area(ring):
        raise ValueError("a ring needs three different, finite points and an area")
    return geodesy.oriented(ring)


def area_of(document: dict, project: bool = True) -> Area:
    """The area of a GeoJSON geometry, Feature or collection of one Feature. project: coordinates are degrees and go
    through the equal-area projection; else they are km."""
    kind = document.get("type")
    if kind == "FeatureCollection":
        if len(document.get("features") or ()) != 1:
            raise ValueError("a study area is one feature")
        return area_of(document["features"][0], project)
    if kind == "Feature":
        if not isinstance(document.get("geometry"), dict):
            raise ValueError("the feature has no geometry")
        return area_of(document["geometry"], project)
    polygons = {"Polygon": lambda c: [c], "MultiPolygon": lambda c: c}.get(kind)
    if polygons is None:
        raise ValueError(f"{kind} is no area")
    place = (lambda p: geodesy.albers_points(*np.asarray(p, np.float64)[:, :2].T) / 1000) if project else (lambda p: p)
    parts = tuple((ring_of(place(rings[0])), tuple(ring_of(place(h)) for h in rings[1:])) for rings in polygons(document["coordinates"]))
    area = Area(parts)
    if not parts or area.km2 <= 0:
        raise ValueError("the study area is empty")
    return area


def load(spark: SparkSession, path: str, project: bool = True) -> Area:
    """From a GeoJSON file, wherever Spark can read it."""
    rows = spark.read.text(path, wholetext=True).head(2)
    if len(rows) != 1:
        raise ValueError("one file holds the study area")
    return area_of(json.loads(rows[0].value), project)


def check(area: Area, expected_km2: float, tolerance_km2: float = 1.0, vertices: int | None = None) -> list[str]:
    """What differs from the record: area, number of vertices."""
    faults = [] if abs(area.km2 - expected_km2) <= tolerance_km2 else ["area"]
    return faults + ([] if vertices is None or sum(map(len, area.rings)) == vertices else ["vertices"])


def domain(area: Area, buffer: float, x: Column, y: Column) -> Column:
    """study, buffer or outside of each point (km): points on the boundary or at the buffer's end count in."""

    @F.pandas_udf("string")
    def run(px: pd.Series, py: pd.Series) -> pd.Series:
        points = np.column_stack((px.to_numpy(np.float64), py.to_numpy(np.float64)))
        return pd.Series(np.where(area.covers(points), "study", np.where(area.within(points, buffer), "buffer", "outside")))

    return run(x, y)


def with_domains(points: DataFrame, area: Area, buffer: float) -> DataFrame:
    """points with the two flags that catalogues have, from x_km and y_km."""
    marked = points.withColumn("__domain", domain(area, buffer, F.col("x_km"), F.col("y_km")))
    return marked.withColumns({"inside_study_area": F.col("__domain") == "study", "inside_external_buffer": F.col("__domain") != "outside"}).drop("__domain")


def flag_faults(points: DataFrame, area: Area) -> DataFrame:
    """Rows whose recorded inside_study_area disagrees with the polygon."""
    return points.filter((domain(area, 0.0, F.col("x_km"), F.col("y_km")) == "study") != F.col("inside_study_area"))


def clipped_cells(spark: SparkSession, area: Area, size: float) -> DataFrame:
    """row, column, cell_id, area_km2, x_km, y_km (a point of the clipped cell) and whole of the cells that the area
    meets: candidates are rows, and each is clipped by the task that holds it."""
    x0, y0, x1, y1 = area.bounds
    span = lambda a, b: F.sequence(F.lit(math.floor(a / size)), F.lit(math.floor(b / size)))
    candidates = spark.range(1).select(F.explode(span(y0, y1)).alias("row")).repartition("row").select("row", F.explode(span(x0, x1)).alias("column"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row, column in zip(batch["row"].tolist(), batch["column"].tolist(), strict=True):
                box = (column * size, row * size, (column + 1) * size, (row + 1) * size)
                total, largest, best = 0.0, 0.0, None
                for outer, holes in area.parts:
                    piece = geodesy.clip(outer, *box)
                    own = abs(geodesy.signed_area(piece)) if len(piece) > 2 else 0.0
                    cut = [geodesy.clip(h, *box) for h in holes]
                    own -= sum(abs(geodesy.signed_area(c)) for c in cut if len(c) > 2)
                    total += own
                    if own > largest:
                        largest, best = own, piece
                if total > 1e-9:
                    whole = abs(total - size * size) <= 1e-9 * size * size
                    point = np.array([(column + 0.5) * size, (row + 0.5) * size]) if whole else geodesy.representative_point(geodesy.oriented(best))
                    rows.append((row, column, total, float(point[0]), float(point[1]), whole))
            yield pd.DataFrame(rows, columns=["row", "column", "area_km2", "x_km", "y_km", "whole"])

    cells = candidates.mapInPandas(run, "row int, column int, area_km2 double, x_km double, y_km double, whole boolean")
    return cells.withColumn("cell_id", cell_id(size, F.col("row"), F.col("column")))


def largest_overlap(overlaps: DataFrame, by: list[str], ordinal: str = "ordinal", area: str = "area_km2") -> DataFrame:
    """The polygon with the largest area of each group, the lowest ordinal of equal ones."""
    return overlaps.groupBy(*by).agg(F.max_by(ordinal, F.struct(F.col(area), -F.col(ordinal))).alias(ordinal), F.max(area).alias(area))
