"""Fault maps from row extracts: points, attributes and hazards of segments by one key, and lines that come twice."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType

from tremora.functions.moments import elapsed_ratio
from tremora.functions.textual import flags, geometry_key, joined_parts, stable_token, without_adjacent_repeats

KEY = ["fault_id", "segment_number"]


def checked(extract: DataFrame, headers: list[str]) -> DataFrame:
    """An extract with exactly these columns, in order, without rows that are blank throughout. Raises for other columns
    and where no row is left."""
    if extract.columns != headers:
        raise ValueError(f"columns {extract.columns} instead of {headers}")
    blank = lambda c: F.col(f"`{c}`").isNull() | (F.trim(F.col(f"`{c}`").cast("string")) == "")
    everything = blank(headers[0])
    for c in headers[1:]:
        everything = everything & blank(c)
    rows = extract.filter(~everything)
    if rows.isEmpty():
        raise ValueError("the extract has no data rows")
    return rows


@F.pandas_udf(BinaryType())
def line_wkb(points: pd.Series) -> pd.Series:
    """Well-known binary of a line, little-endian."""

    def pack(line) -> bytes:
        flat = [v for p in line for v in (p["longitude"], p["latitude"])]
        return struct.pack(f"<BII{len(flat)}d", 1, 2, len(flat) // 2, *flat)

    return points.map(pack)


def crosses_itself(line: np.ndarray) -> bool:
    """Whether two edges of a line that are no neighbours meet, or neighbours run back over each other. The ends of a
    closed line may meet."""
    a, b = line[:-1], line[1:]
    n, closed = len(a), bool((line[0] == line[-1]).all())
    side = lambda p, q, r: (q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0])
    on = lambda p, q, r: (np.minimum(p, q) <= r).all(-1) & (r <= np.maximum(p, q)).all(-1)
    for i in range(n - 1):
        if side(a[i], b[i], b[i + 1]) == 0 and np.dot(b[i] - a[i], b[i + 1] - b[i]) < 0:
            return True
        last = n - 1 if closed and i == 0 else n
        p, q = a[i + 2 : last], b[i + 2 : last]
        if not len(p):
            continue
        d1, d2, d3, d4 = side(a[i], b[i], p), side(a[i], b[i], q), side(p, q, a[i]), side(p, q, b[i])
        touch = ((d1 == 0) & on(a[i], b[i], p)) | ((d2 == 0) & on(a[i], b[i], q)) | ((d3 == 0) & on(p, q, a[i])) | ((d4 == 0) & on(p, q, b[i]))
        if (touch | ((d1 * d2 < 0) & (d3 * d4 < 0))).any():
            return True
    return False


@F.pandas_udf(BooleanType())
def is_simple(points: pd.Series) -> pd.Series:
    return points.map(lambda line: not crosses_itself(np.array([(p["longitude"], p["latitude"]) for p in line], np.float64)) if len(line) > 1 else False)


def segments(points: DataFrame, attributes: DataFrame, hazards: DataFrame, year: int) -> DataFrame:
    """One row a key of any of the three tables, with ``fault``: what is wrong with it, null for a good one.

    points: KEY, point_number, fault_name, segment_name, longitude, latitude, is_new. attributes and hazards: KEY,
    fault_name, segment_name and more; attributes also recurrence_years and last_year. The three key sets must be equal,
    point numbers run from 1, names agree, and a line has two different points. A segment's points are one array."""
    spot = F.struct("longitude", "latitude")
    grouped = points.groupBy(*KEY).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("point_number", "longitude", "latitude"))), lambda x: F.struct(x["longitude"].alias("longitude"), x["latitude"].alias("latitude"))).alias("raw"),
        F.count("*").alias("raw_point_count"), F.count_distinct("point_number").alias("numbers"), F.min("point_number").alias("first"), F.max("point_number").alias("last"),
        F.count_distinct("fault_name", "segment_name").alias("names"), F.min("fault_name").alias("fault_name"), F.min("segment_name").alias("segment_name"),
        F.count_distinct("is_new").alias("news"), F.first("is_new").alias("is_new"), F.count_distinct(spot).alias("places"),
    )
    renamed = lambda df, p: df.select(*KEY, *[F.col(c).alias(p + c) for c in df.columns if c not in KEY], F.lit(True).alias(p + "there"))
    both = grouped.join(renamed(attributes, "a_"), KEY, "full").join(renamed(hazards, "h_"), KEY, "full")
    other = lambda p: ~F.col(f"{p}fault_name").eqNullSafe(F.col("fault_name")) | ~F.col(f"{p}segment_name").eqNullSafe(F.col("segment_name"))
    fault = (
        F.when(F.col("raw").isNull(), "no_points").when(F.col("a_there").isNull(), "no_attributes").when(F.col("h_there").isNull(), "no_hazards")
        .when((F.col("first") != 1) | (F.col("last") != F.col("raw_point_count")) | (F.col("numbers") != F.col("raw_point_count")), "point_numbers")
        .when(F.col("names") != 1, "names_differ_within").when(F.col("news") != 1, "new_flags_differ").when(other("a_") | other("h_"), "names_differ_across").when(F.col("places") < 2, "one_place")
    )
    out = both.withColumn("fault", fault).withColumn("line", without_adjacent_repeats(F.coalesce("raw", F.array().cast("array<struct<longitude double, latitude double>>"))))
    out = out.withColumn("geometry_point_count", F.size("line"))
    good = F.col("fault").isNull()
    simple = F.when(good, is_simple("line"))
    missing = flags(recurrence_years=F.col("a_recurrence_years").isNull(), last_year=F.col("a_last_year").isNull())
    marks = flags(adjacent_duplicate_coordinates_removed=F.col("geometry_point_count") < F.col("raw_point_count"), non_simple_geometry=~simple)
    return out.withColumns({
        "fault_segment_id": stable_token(joined_parts(F.lit("fault_segment"), *[F.col(c) for c in KEY])), "geometry_wkb": F.when(good, line_wkb("line")), "geometry_flags": F.when(good, marks),
        "missing_fields": F.when(good, missing), "elapsed_ratio": elapsed_ratio(F.lit(year), F.col("a_last_year"), F.col("a_recurrence_years")),
    }).drop("raw", "numbers", "first", "last", "names", "news", "places", "a_there", "h_there")


def with_duplicates(lines: DataFrame, points: Column, name: str) -> DataFrame:
    """Adds duplicate_group_id, duplicate_geometry and duplicate_name_conflict: lines with the same vertices in either
    direction, and whether such lines bear different names (no name is a name of its own)."""
    w = Window.partitionBy("__line")
    keyed = lines.withColumn("__line", geometry_key(points))
    names = F.size(F.collect_set(F.coalesce(F.concat(F.lit("="), F.col(name)), F.lit(""))).over(w))
    out = keyed.withColumns({"duplicate_geometry": F.count("*").over(w) > 1, "duplicate_name_conflict": names > 1})
    return out.withColumn("duplicate_group_id", F.when(F.col("duplicate_geometry"), F.substring("__line", 1, 26))).drop("__line")
