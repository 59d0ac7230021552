"""Branching simulations, one group for each replicate: seeds come from text fields, so neither the number of workers
nor their order changes a result."""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremora.operators.etas import Parameters, Spec

EVENTS = "replicate int, event_id string, parent_id string, generation int, origin_day double, x_km double, y_km double, magnitude double, inside boolean"


def seed(*fields: str, replicate: int = 0) -> int:
    """The first 16 bytes of the SHA-256 of NUL-separated fields, as a number."""
    return int.from_bytes(hashlib.sha256("\0".join([*fields, f"{replicate:08d}"]).encode()).digest()[:16], "big")


def generator(*fields: str, replicate: int = 0) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(seed(*fields, replicate=replicate)))


def gr_magnitude(g: np.random.Generator, mc: float, most: float, beta: float) -> float:
    """Inverse of the truncated exponential law."""
    return mc - np.log1p(g.random() * np.expm1(-beta * (most - mc))) / beta


def omori_time(g: np.random.Generator, lower: float, upper: float, c: float, p: float) -> float:
    """A delay in (lower, upper], by the inverse of the conditional law."""
    survive = lambda t: 0.0 if np.isinf(t) else (1 + t / c) ** (1 - p)
    s = survive(lower) + g.random() * (survive(upper) - survive(lower))
    return float(min(max(c * (s ** (1 / (1 - p)) - 1), lower), upper))


def power_offset(g: np.random.Generator, m: float, s: Spec) -> tuple[float, float]:
    """A displacement under the cut inverse power law."""
    sigma = s.d * np.exp(s.gamma * (m - s.mc))
    whole = -np.expm1((1 - s.q) * np.log1p(s.cutoff**2 / sigma))
    r = np.sqrt(sigma * np.expm1(np.log1p(-g.random() * whole) / (1 - s.q)))
    angle = 2 * np.pi * g.random()
    return float(r * np.cos(angle)), float(r * np.sin(angle))


def omori_mass(lower: float, upper: float, c: float, p: float) -> float:
    survive = lambda t: 0.0 if np.isinf(t) else (1 + t / c) ** (1 - p)
    return survive(lower) - survive(upper)


def simulate_one(g: np.random.Generator, history: pd.DataFrame, s: Spec, w: Parameters, start: float, days: float, domain, immigrant, most_events: int) -> list[tuple]:
    """One future: immigrants first, then all descendants in order of time, generation, parent and child number.
    Events beyond the buffer are absorbed: they have no offspring and are no output, but count to the cap like all that
    are made. Raises at the cap."""
    out, count = [], 0
    queue: list[tuple] = []

    def push(name, parent, generation, child, t, x, y):
        nonlocal count
        count += 1
        if count > most_events:
            raise RuntimeError("the simulation reached its cap of events")
        m = gr_magnitude(g, s.mc, s.most, s.beta)
        where = domain(x, y)
        if where != "outside":
            heapq.heappush(queue, (t, generation, parent, child, name, x, y, m, where))

    for i in range(g.poisson(w.mu * days)):
        x, y = immigrant(g)
        push(f"b{i}", "", 0, i, start + days * g.random(), x, y)
    for name, t0, x0, y0, m0 in zip(*[history[c] for c in ("event_id", "origin_day", "x_km", "y_km", "magnitude")], strict=True):
        lower, upper = start - t0, min(s.lag, start + days - t0)
        if upper > lower:
            for j in range(g.poisson(w.k * np.exp(w.alpha * (m0 - s.mc)) * omori_mass(lower, upper, w.c, w.p))):
                dx, dy = power_offset(g, m0, s)
                push(f"{name}/{j}", str(name), 1, j, t0 + omori_time(g, lower, upper, w.c, w.p), x0 + dx, y0 + dy)
    while queue:
        t, generation, parent, child, name, x, y, m, where = heapq.heappop(queue)
        out.append((name, parent, generation, t, x, y, m, where == "study"))
        upper = min(s.lag, start + days - t)
        for j in range(g.poisson(w.k * np.exp(w.alpha * (m - s.mc)) * omori_mass(0.0, upper, w.c, w.p)) if upper > 0 else 0):
            dx, dy = power_offset(g, m, s)
            push(f"{name}/{j}", name, generation + 1, j, t + omori_time(g, 0.0, upper, w.c, w.p), x + dx, y + dy)
    return out


def box_domain(half_x: float, half_y: float, buffer: float):
    def where(x: float, y: float) -> str:
        dx, dy = max(abs(x) - half_x, 0.0), max(abs(y) - half_y, 0.0)
        return "study" if dx == dy == 0 else "buffer" if np.hypot(dx, dy) <= buffer else "outside"

    return where


def simulate(history: DataFrame, s: Spec, w: Parameters, start: float, days: float, replicates: int, half: tuple[float, float] = (600.0, 400.0), buffer: float = 300.0, model: str = "etas", most_events: int = 100_000, most_history: int = 100_000) -> DataFrame:
    """EVENTS of every replicate, each a group of its own. The visible history is what every replicate starts from;
    its size is checked before it goes along."""
    spark = history.sparkSession
    seen = history.filter((F.col("available_day") <= start) & (F.col("origin_day") <= start) & (F.col("origin_day") >= start - s.lag) & (F.col("magnitude") >= s.mc)).select("event_id", "origin_day", "x_km", "y_km", "magnitude")
    if seen.limit(most_history + 1).count() > most_history:
        raise ValueError("the history is too large to go to every replicate")
    given = seen.orderBy("origin_day", "event_id").toPandas()
    domain = box_domain(*half, buffer)

    def immigrant(g):
        return float(g.uniform(-half[0], half[0])), float(g.uniform(-half[1], half[1]))

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        i = int(key[0])
        rows = simulate_one(generator("tremora", "future_simulation", model, replicate=i), given, s, w, start, days, domain, immigrant, most_events)
        return pd.DataFrame([(i, *r) for r in rows], columns=["replicate", "event_id", "parent_id", "generation", "origin_day", "x_km", "y_km", "magnitude", "inside"])

    return spark.range(replicates).select(F.col("id").cast("int").alias("replicate")).groupBy("replicate").applyInPandas(run, EVENTS)


def kde_sampler(x: np.ndarray, y: np.ndarray, h: float, domain, most: int = 1_000_000):
    """Draws places of immigrants from a kernel density, given that they lie in the study area: a training point, a
    Gaussian step of width h, and again until it is inside. Raises after ``most`` tries."""
    if not len(x):
        raise ValueError("no training points to draw from")

    def draw(g: np.random.Generator) -> tuple[float, float]:
        for _ in range(most):
            i = int(g.integers(0, len(x)))
            at = float(g.normal(x[i], h)), float(g.normal(y[i], h))
            if domain(*at) == "study":
                return at
        raise RuntimeError("no place inside the study area was found")

    return draw


def futures(catalog: DataFrame, issues: list[float], s: Spec, w: Parameters, days: float, replicates: int, training: DataFrame, h: float, half: tuple[float, float] = (600.0, 400.0), buffer: float = 300.0, most_events: int = 100_000, most_points: int = 100_000) -> DataFrame:
    """issue_day and EVENTS of every replicate of every issue. Each (issue, replicate) is a group of its own, seeded by
    both; it starts from the history visible at its issue, and immigrants come from the kernel density of ``training``.

    The events that some issue may see and the training points go to every task; their number is checked first."""
    spark = catalog.sparkSession
    first, last = min(issues) - s.lag, max(issues)
    seen = catalog.filter(F.col("inside_external_buffer") & (F.col("magnitude") >= s.mc) & (F.col("origin_day") > first) & (F.col("origin_day") <= last)).select("event_id", "origin_day", "available_day", "x_km", "y_km", "magnitude")
    points = training.select("x_km", "y_km")
    if seen.limit(most_points + 1).count() > most_points or points.limit(most_points + 1).count() > most_points:
        raise ValueError("the history or the training set is too large to go to every task")
    given, places = seen.orderBy("origin_day", "event_id").toPandas(), points.orderBy("x_km", "y_km").toPandas()
    domain = box_domain(*half, buffer)
    immigrant = kde_sampler(places["x_km"].to_numpy(), places["y_km"].to_numpy(), h, domain)

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        issue, i = float(key[0]), int(key[1])
        history = given[(given["origin_day"] <= issue) & (given["origin_day"] > issue - s.lag) & (given["available_day"] <= issue)]
        g = generator("tremora", "future_simulation", f"{issue:.6f}", replicate=i)
        rows = simulate_one(g, history, s, w, issue, days, domain, immigrant, most_events)
        return pd.DataFrame([(issue, i, *r) for r in rows], columns=["issue_day", "replicate", "event_id", "parent_id", "generation", "origin_day", "x_km", "y_km", "magnitude", "inside"])

    plan = spark.range(replicates).select(F.col("id").cast("int").alias("replicate"), F.explode(F.array(*[F.lit(float(x)) for x in issues])).alias("issue_day"))
    return plan.groupBy("issue_day", "replicate").applyInPandas(run, "issue_day double, " + EVENTS)


def in_order(events: DataFrame) -> DataFrame:
    """Simulated events in their total order: time, generation, parent, number of the child."""
    child = F.substring_index("event_id", "/", -1).try_cast("int")
    return events.orderBy("replicate", "origin_day", "generation", "parent_id", child, "event_id")


def ensemble(counts: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """The long table of a result: rows of kind replicate_count (issue_day, horizon, replicate, n) and, with cells
    (issue_day, horizon, cell_id, expected), of kind expected_cell."""
    blank = lambda kind: F.lit(None).cast(kind)
    rows = counts.select(F.lit("replicate_count").alias("record_kind"), "issue_day", "horizon", F.col("replicate").cast("smallint").alias("replicate_index"), F.col("n").cast("int").alias("replicate_count"), blank("string").alias("cell_id"), blank("double").alias("expected_count"))
    if cells is None:
        return rows
    return rows.unionByName(cells.select(F.lit("expected_cell").alias("record_kind"), "issue_day", "horizon", blank("smallint").alias("replicate_index"), blank("int").alias("replicate_count"), "cell_id", F.col("expected").alias("expected_count")))


def horizon_replicate_counts(events: DataFrame, replicates: DataFrame, start: float, horizons: tuple[float, ...]) -> DataFrame:
    """horizon, replicate, n: one simulation serves all horizons; replicates without events count 0."""
    rows = replicates.select("replicate", F.explode(F.array(*[F.lit(float(h)) for h in horizons])).alias("horizon"))
    reached = F.filter(F.array(*[F.lit(float(h)) for h in horizons]), lambda h: F.col("origin_day") - start <= h)
    counts = events.filter(F.col("origin_day") > start).withColumn("horizon", F.explode(reached)).groupBy("replicate", "horizon").agg(F.count("*").alias("n"))
    return rows.join(counts, ["replicate", "horizon"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def count_quantiles(counts: DataFrame, levels: tuple[float, ...] = (0.025, 0.5, 0.975)) -> DataFrame:
    return counts.groupBy("horizon").agg(F.avg("n").alias("mean"), *[F.percentile("n", F.lit(q)).alias(f"q{round(q * 1000)}") for q in levels])


def expected_cells(events: DataFrame, replicates: int, by: list[str]) -> DataFrame:
    """Mean number of events a replicate; cells without any are left out."""
    return events.groupBy(*by).agg((F.count("*") / F.lit(float(replicates))).alias("expected"))


#: What the branching process of the regression gives in closed form, and how far it may be off.
ANALYTIC = {
    "generic_branching_ratio": 0.3928055160151634, "root_direct_offspring_mean": 0.5436563656918091, "root_total_descendants_mean": 0.8953578796104242,
    "root_total_descendants_variance": 2.8311915410643453, "root_zero_descendant_probability": 0.580621402297363,
}
MEAN_OFF, VARIANCE_OFF, ZERO_OFF, MOST_KS, LEAST_POOLED = 0.08, 0.25, 0.03, 0.035, 3500


def poisson_pit(n: int, mean: float, u: float) -> float:
    """A uniform number if n is a draw from the Poisson law: between the law's values below and at n."""
    below, at = 0.0, np.exp(-mean)
    for i in range(n):
        below, at = below + at, at * mean / (i + 1)
    return float(below + u * at)


def analytic_regression(spark: SparkSession, replicates: int = 8192, blocks: int = 64, s: Spec = Spec(mc=3.0, most=7.0, beta=2.0), w: Parameters = Parameters(), root: float = 4.0, cap: int = 100_000) -> DataFrame:
    """replicate, descendants, direct, capped and pits of a single root event, bred to extinction: its moments are known
    in closed form, and each parent's number of children gives one uniform number."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for i in pdf["id"]:
            g, waiting, n, direct, pits, capped = generator("tremora", "simulation_regression", replicate=int(i)), [root], 0, None, [], False
            while waiting and not capped:
                mean = w.k * np.exp(w.alpha * (waiting.pop() - s.mc))
                children = int(g.poisson(mean))
                pits.append(poisson_pit(children, mean, g.random()))
                direct = children if direct is None else direct
                n, capped = n + children, n + children > cap
                waiting += [gr_magnitude(g, s.mc, s.most, s.beta) for _ in range(children)]
            out.append((int(i), n, direct, capped, pits))
        return pd.DataFrame(out, columns=["replicate", "descendants", "direct", "capped", "pits"])

    return spark.range(replicates, numPartitions=blocks).mapInPandas(lambda it: (run(x) for x in it), "replicate long, descendants long, direct long, capped boolean, pits array<double>")


def analytic_checks(trees: DataFrame, s: Spec = Spec(mc=3.0, most=7.0, beta=2.0), w: Parameters = Parameters()) -> DataFrame:
    """name, value and passed of the nine checks of the branching process against its closed form."""
    from pyspark.sql import Window

    from tremora.functions import kernels

    pits = trees.filter("not capped").select(F.explode("pits").alias("pit"))
    place, n = F.row_number().over(Window.orderBy("pit")), F.count("*").over(Window.partitionBy(F.lit(0)))  # thousands of numbers
    ks = pits.select("pit", place.alias("place"), n.alias("n")).agg(F.max(F.greatest(F.col("place") / F.col("n") - F.col("pit"), F.col("pit") - (F.col("place") - 1) / F.col("n"))).alias("ks"), F.count("*").alias("pooled"))
    d = F.when(~F.col("capped"), F.col("descendants"))
    whole = trees.agg(F.avg(F.when(~F.col("capped"), F.col("direct"))).alias("direct"), F.avg(d).alias("mean"), F.var_samp(d).alias("variance"), F.avg((d == 0).cast("double")).alias("zero"), F.count_if("capped").alias("caps"), F.count_if(~F.col("capped") & F.col("descendants").isNull()).alias("nonfinite")).crossJoin(ks)
    ratio = kernels.branching_ratio(w.k, F.lit(w.alpha), s.beta, s.most - s.mc)
    near = lambda c, name, off, relative=False: F.abs(F.col(c) - ANALYTIC[name]) / (ANALYTIC[name] if relative else 1.0) <= off
    checks = [
        ("generic_branching_ratio", ratio, F.abs(ratio - ANALYTIC["generic_branching_ratio"]) <= 5e-12), ("root_direct_offspring_mean", F.col("direct"), near("direct", "root_direct_offspring_mean", MEAN_OFF)),
        ("root_total_descendants_mean", F.col("mean"), near("mean", "root_total_descendants_mean", MEAN_OFF)), ("root_total_descendants_variance", F.col("variance"), near("variance", "root_total_descendants_variance", VARIANCE_OFF, True)),
        ("root_zero_descendant_probability", F.col("zero"), near("zero", "root_zero_descendant_probability", ZERO_OFF)), ("direct_offspring_pit_ks", F.col("ks"), F.col("ks") <= MOST_KS),
        ("minimum_pooled_direct_offspring", F.col("pooled"), F.col("pooled") >= LEAST_POOLED), ("event_cap_hits", F.col("caps"), F.col("caps") == 0), ("nonfinite_values", F.col("nonfinite"), F.col("nonfinite") == 0),
    ]
    return whole.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("value"), F.coalesce(p, F.lit(False)).alias("passed")) for n, v, p in checks])).alias("x")).select("x.*")


def bootstrap_gains(contributions: DataFrame, replicates: int = 2000, blocks: int = 32, most: int = 1_000_000) -> DataFrame:
    """replicate and gain: means of resampled per-event contributions. Their number is checked before they go along."""
    spark = contributions.sparkSession
    if contributions.limit(most + 1).count() > most:
        raise ValueError("too many contributions for a bootstrap by replicate")
    values = np.sort(contributions.select("contribution").toPandas()["contribution"].to_numpy(np.float64))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        draws = [(int(i), float(values[generator("tremora", "bootstrap", replicate=int(i)).integers(0, len(values), len(values))].mean())) for i in pdf["id"]] if len(values) else []
        return pd.DataFrame(draws, columns=["replicate", "gain"])

    return spark.range(replicates, numPartitions=blocks).mapInPandas(lambda it: (run(x) for x in it), "replicate long, gain double")


def interval(gains: DataFrame, level: float = 0.95) -> DataFrame:
    low = (1 - level) / 2
    return gains.agg(F.percentile("gain", F.lit(low)).alias("low"), F.avg("gain").alias("mean"), F.percentile("gain", F.lit(1 - low)).alias("high"))


def settings(s: Spec, w: Parameters) -> dict:
    return asdict(s) | asdict(w)
