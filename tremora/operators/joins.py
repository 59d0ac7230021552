"""Joins that Spark does not plan well by itself: band and radius joins as equi-joins of buckets, matches by degree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def band_join(left: DataFrame, right: DataFrame, on: str, width: float, residual: Column | None = None) -> DataFrame:
    """Pairs with abs(l_on - r_on) <= width; columns get the prefixes l_ and r_.

    Each right row goes to the three buckets next to its own, so the join is one on equal buckets: a hash or merge join
    whose shuffle is by time, instead of a nested loop."""
    bucket = lambda c: F.floor(F.col(c) / width)
    l, r = with_prefix(left, "l_").withColumn("bucket", bucket(f"l_{on}")), with_prefix(right, "r_")  # noqa: E741
    r = r.withColumn("bucket", F.explode(F.array(*[bucket(f"r_{on}") + i for i in (-1, 0, 1)])))
    near = F.abs(F.col(f"l_{on}") - F.col(f"r_{on}")) <= width
    return l.join(r, "bucket").filter(near if residual is None else near & residual).drop("bucket")


def radius_join(targets: DataFrame, parents: DataFrame, radius: float, lag: float, visible: bool = True) -> DataFrame:
    """Pairs of a target (t_) and an earlier parent (p_) within radius km and lag days; visible: and whose parent was
    available at the target's time. Adds dt and r.

    A parent goes to its cell and the eight around it, and to its span of ``lag`` days and the next: both sides meet on
    equal (cell, span), so the join shuffles by place and time and a dense year is many keys."""
    cell = lambda c: F.floor(F.col(c) / radius)
    t = with_prefix(targets, "t_").withColumns({"bx": cell("t_x_km"), "by": cell("t_y_km"), "bt": F.floor(F.col("t_origin_day") / lag)})
    p = with_prefix(parents, "p_")
    around = F.array(*[F.struct((cell("p_x_km") + i).alias("bx"), (cell("p_y_km") + j).alias("by"), (F.floor(F.col("p_origin_day") / lag) + k).alias("bt")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (0, 1)])
    p = p.withColumn("key", F.explode(around)).select("*", "key.*").drop("key")
    dt, r = F.col("t_origin_day") - F.col("p_origin_day"), F.sqrt((F.col("t_x_km") - F.col("p_x_km")) ** 2 + (F.col("t_y_km") - F.col("p_y_km")) ** 2)
    pairs = t.join(p, ["bx", "by", "bt"]).withColumns({"dt": dt, "r": r}).filter((F.col("dt") > 0) & (F.col("dt") <= lag) & (F.col("r") <= radius)).drop("bx", "by", "bt")
    return pairs.filter("p_available_day <= t_origin_day") if visible else pairs


def near_cells(points: DataFrame, cells: DataFrame, radius: float) -> DataFrame:
    """Points with each cell (c_) whose centre is within radius km, and r: both sides meet on equal squares of that
    size, so the work follows the pairs that count and not points times cells."""
    square = lambda c: F.floor(F.col(c) / radius)
    c = with_prefix(cells.select("row", "column", "area_km2", "x_km", "y_km"), "c_")
    around = F.array(*[F.struct((square("c_x_km") + i).alias("bx"), (square("c_y_km") + j).alias("by")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    c = c.withColumn("key", F.explode(around)).select("*", "key.*").drop("key")
    r = F.sqrt((F.col("x_km") - F.col("c_x_km")) ** 2 + (F.col("y_km") - F.col("c_y_km")) ** 2)
    met = points.withColumns({"bx": square("x_km"), "by": square("y_km")}).join(c, ["bx", "by"]).withColumn("r", r)
    return met.filter(F.col("r") <= radius).drop("bx", "by")


def band_place_join(left: DataFrame, right: DataFrame, days: float, km: float, dm: float, residual: Column) -> DataFrame:
    """As band_join on origin_day, but both sides also meet on equal squares of ``km`` and steps of ``dm`` in
    magnitude: a swarm within one time bucket is many keys.

    Steps are twice the limits wide, so a right row goes to two of each kind, 16 in all. Spark's estimate of that side
    leaves the copies out, so without the hint it might be sent to the driver to be broadcast."""
    kinds = [("kt", "origin_day", days), ("kx", "x_km", km), ("ky", "y_km", km), ("km", "magnitude", dm)]
    step = lambda c, w, reach: F.floor(F.col(c) / (2 * w) + F.lit(reach)).cast("long")
    more = 0.5 + 1e-5  # residuals compare rounded differences: these may pass the limit a little
    l, r = with_prefix(left, "l_"), with_prefix(right, "r_")  # noqa: E741
    for name, c, w in kinds:
        l = l.withColumn(name, step(f"l_{c}", w, 0.0))  # noqa: E741
        r = r.withColumn(name, F.explode(F.sequence(step(f"r_{c}", w, -more), step(f"r_{c}", w, more))))
    names = [name for name, _, _ in kinds]
    return l.join(r.hint("merge"), names).filter((F.abs(F.col("l_origin_day") - F.col("r_origin_day")) <= days) & residual).drop(*names)


def mutual_degree_one(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """The pairs whose both ends have no other pair."""
    degree = lambda c: F.count("*").over(Window.partitionBy(c))
    return pairs.withColumns({"l_degree": degree(left), "r_degree": degree(right)}).filter("l_degree = 1 and r_degree = 1").drop("l_degree", "r_degree")


def key_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has: side and the key. Empty where both sets are equal."""
    l, r = (x.select(*keys).distinct() for x in (left, right))  # noqa: E741
    return l.join(r, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(r.join(l, keys, "left_anti").withColumn("side", F.lit("right")))


def strict_join(left: DataFrame, right: DataFrame, keys: list[str], agree: dict[str, str] | None = None) -> DataFrame:
    """One to one: an inner join with ``fault`` telling keys that repeat or columns that should agree and don't."""
    once = lambda x, n: x.withColumn(n, F.count("*").over(Window.partitionBy(*keys)))
    both = once(left, "l_rows").join(once(right, "r_rows"), keys)
    differ = F.lit(False)
    for a, b in (agree or {}).items():
        differ = differ | ~F.col(a).eqNullSafe(F.col(b))
    return both.withColumn("fault", F.when((F.col("l_rows") > 1) | (F.col("r_rows") > 1), "repeated").when(differ, "differs")).drop("l_rows", "r_rows")


def two_tier_join(segments: DataFrame, traces: DataFrame, segment_id: str, trace_id: str, exact: str, loose: str) -> DataFrame:
    """Left join by the exact name, else by the loose one; for a trace that has both, the exact match stands alone.
    tier is exact, loose or unmatched."""
    s, t = segments.select(segment_id, exact, loose), traces.select(trace_id, exact, loose)
    tiers = [s.join(t.drop(other), key).select(segment_id, trace_id, F.lit(name).alias("tier")) for key, other, name in ((exact, loose, "exact"), (loose, exact, "loose"))]
    best = Window.partitionBy(trace_id).orderBy("tier")
    found = tiers[0].unionByName(tiers[1]).withColumn("first", F.min("tier").over(best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).filter("tier = first").drop("first")
    return s.select(segment_id).join(found, segment_id, "left").withColumn("tier", F.coalesce("tier", F.lit("unmatched")))


def overlap_window(parents: DataFrame, start: float, end: float, lag: float) -> DataFrame:
    """lower and upper: the ages at which a parent acts on (start, end], from its availability on and up to lag."""
    lower = F.greatest(F.lit(start), F.col("available_day")) - F.col("origin_day")
    upper = F.least(F.lit(lag), F.lit(end) - F.col("origin_day"))
    return parents.withColumns({"lower": F.greatest(lower, F.lit(0.0)), "upper": upper}).filter("upper > lower")


def union_sources(**frames: DataFrame) -> DataFrame:
    """Rows of all roles with their role; a path that comes twice is marked."""
    rows = None
    for role, df in frames.items():
        one = df.withColumn("role", F.lit(role))
        rows = one if rows is None else rows.unionByName(one)
    return rows.withColumn("repeated", F.count("*").over(Window.partitionBy("path")) > 1)
