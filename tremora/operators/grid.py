"""Equal-area grids: half-open cells from the origin, clipped to a study box, and sums from fine to coarse."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremora.functions.textual import cell_id


def cells(spark: SparkSession, size: float, half_x: float, half_y: float) -> DataFrame:
    """row, column, cell_id, area_km2, x_km and y_km (the clipped cell's centre) of cells that meet the box."""
    span = lambda half: (math.floor(-half / size), math.ceil(half / size) - 1)
    (c0, c1), (r0, r1) = span(half_x), span(half_y)
    grid = spark.range(1).select(F.explode(F.sequence(F.lit(r0), F.lit(r1))).alias("row")).select("row", F.explode(F.sequence(F.lit(c0), F.lit(c1))).alias("column"))
    low = lambda c, half: F.greatest(F.col(c) * size, F.lit(-half))
    high = lambda c, half: F.least((F.col(c) + 1) * size, F.lit(half))
    x0, x1, y0, y1 = low("column", half_x), high("column", half_x), low("row", half_y), high("row", half_y)
    out = grid.withColumns({"area_km2": (x1 - x0) * (y1 - y0), "x_km": (x0 + x1) / 2, "y_km": (y0 + y1) / 2})
    return out.withColumn("cell_id", cell_id(size, F.col("row"), F.col("column"))).filter("area_km2 > 0")


def cell_values(size: float, half_x: float, half_y: float) -> list[tuple[int, int, float, float, float]]:
    """The same cells as values (row, column, area, x, y), for array literals: a grid has a fixed number of cells."""
    out = []
    for row in range(math.floor(-half_y / size), math.ceil(half_y / size)):
        for column in range(math.floor(-half_x / size), math.ceil(half_x / size)):
            x0, x1 = max(column * size, -half_x), min((column + 1) * size, half_x)
            y0, y1 = max(row * size, -half_y), min((row + 1) * size, half_y)
            if x1 > x0 and y1 > y0:
                out.append((row, column, (x1 - x0) * (y1 - y0), (x0 + x1) / 2, (y0 + y1) / 2))
    return out


def cell_array(values):
    """The cells as one array literal, parsed from text: thousands of single literals would take seconds to pass on."""
    cells = (f"named_struct('row', {r}, 'column', {c}, 'area_km2', {a!r}D, 'cx', {x!r}D, 'cy', {y!r}D)" for r, c, a, x, y in values)
    return F.expr(f"array({', '.join(cells)})")


def assigned(events: DataFrame, size: float) -> DataFrame:
    """Adds row, column and cell_id of each point."""
    out = events.withColumns({"row": F.floor(F.col("y_km") / size).cast("int"), "column": F.floor(F.col("x_km") / size).cast("int")})
    return out.withColumn("cell_id", cell_id(size, F.col("row"), F.col("column")))


def coarser(fine: DataFrame, value: str, ratio: int = 2) -> DataFrame:
    """Sums of a value over the aligned parents, by floor of row and column."""
    parent = lambda c: F.floor(F.col(c) / ratio).cast("int").alias(c)
    return fine.select(parent("row"), parent("column"), value).groupBy("row", "column").agg(F.sum(value).alias(value))


def filled(coarse_cells: DataFrame, fine: DataFrame, value: str, ratio: int = 2) -> DataFrame:
    """A fine value summed to every cell of the coarse grid, 0 where it has none; ``orphan`` marks sums whose parent the
    coarse grid lacks: there must be none."""
    sums = coarser(fine, value, ratio)
    both = coarse_cells.select("row", "column", F.lit(True).alias("there")).join(sums, ["row", "column"], "full")
    return both.select("row", "column", F.coalesce(value, F.lit(0.0)).alias(value), F.col("there").isNull().alias("orphan"))


def convergence(coarse: DataFrame, fine: DataFrame, value: str, total_limit: float = 0.02, l1_limit: float = 0.05) -> DataFrame:
    """relative_total, density_l1 and passed: a coarse field against its finer one, summed to the same parents."""
    return convergence_by(coarse.withColumn("__all", F.lit(0)), fine.withColumn("__all", F.lit(0)), value, ["__all"], total_limit, l1_limit).drop("__all")


def convergence_by(coarse: DataFrame, fine: DataFrame, value: str, by: list[str], total_limit: float = 0.02, l1_limit: float = 0.05) -> DataFrame:
    """The same for each group of fields. Two passes: the totals (a row a group), then the sum of differences. A field
    without anything on either grid converges."""
    parent = lambda c: F.floor(F.col(c) / 2).cast("int").alias(c)
    summed = fine.select(*by, parent("row"), parent("column"), value).groupBy(*by, "row", "column").agg(F.sum(value).alias("f"))
    both = coarse.select(*by, "row", "column", F.col(value).alias("c")).join(summed, [*by, "row", "column"], "full")
    both = both.select(*by, F.coalesce("c", F.lit(0.0)).alias("c"), F.coalesce("f", F.lit(0.0)).alias("f"))
    totals = both.groupBy(*by).agg(F.sum("c").alias("tc"), F.sum("f").alias("tf"))
    share = lambda x, t: F.when(F.col(t) > 0, F.col(x) / F.col(t)).otherwise(0.0)
    out = both.join(totals, by).groupBy(*by).agg(F.first("tc").alias("tc"), F.first("tf").alias("tf"), F.sum(F.abs(share("c", "tc") - share("f", "tf"))).alias("density_l1"))
    out = out.select(*by, (F.abs(F.col("tc") - F.col("tf")) / F.greatest(F.abs("tf"), F.lit(1e-12))).alias("relative_total"), "density_l1")
    return out.withColumn("passed", (F.col("relative_total") <= total_limit) & (F.col("density_l1") <= l1_limit))


def three_grids(fields: dict[float, DataFrame], value: str) -> DataFrame:
    """The comparisons of each grid with the next finer one: coarse_km, fine_km and what convergence gives. All must
    pass."""
    sizes = sorted(fields, reverse=True)
    rows = None
    for a, b in zip(sizes, sizes[1:], strict=False):
        one = convergence(fields[a], fields[b], value).select(F.lit(a).alias("coarse_km"), F.lit(b).alias("fine_km"), "relative_total", "density_l1", "passed")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def to_cells(points: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """Points with the row, column and cell_id of the grid's own cell; ``missing`` marks those that the grid has no cell
    for: an error, unless points may lie outside."""
    placed = assigned(points, size)
    known = cells.select("row", "column", F.lit(False).alias("missing"))
    return placed.join(known, ["row", "column"], "left").withColumn("missing", F.coalesce("missing", F.lit(True)))
