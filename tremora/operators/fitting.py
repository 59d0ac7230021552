"""Maximum likelihood for the self-exciting model: several seeded starts of a projected L-BFGS, and its audit."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.functions import kernels
from tremora.operators.etas import Parameters, Spec, acting, pairs, parent_masses
from tremora.operators.simulation import generator

#: Bounds of mu, K, alpha, c and p - 1.
BOUNDS = np.log(np.array([[0.01, 10.0], [1e-4, 0.5], [0.05, 2.0], [1e-3, 30.0], [0.01, 1.5]]))


class Prepared(NamedTuple):
    """What the likelihood needs, as arrays: pairs by target, parents with their windows and masses."""

    n: int
    target: np.ndarray
    dt: np.ndarray
    m: np.ndarray
    density: np.ndarray
    parent_m: np.ndarray
    lower: np.ndarray
    upper: np.ndarray
    mass: np.ndarray
    days: float
    area: float


def prepare(targets: DataFrame, parents: DataFrame, cells: DataFrame, s: Spec, start: float, end: float, area: float, most: int = 5_000_000) -> Prepared:
    """Builds the pair table and the parents' masses with Spark, once for a fit; only the finished arrays, whose size
    is checked, come to the driver, where the optimizer runs."""
    near = pairs(targets, parents, s)
    rows = near.select(F.col("t_event_id").alias("target"), "dt", F.col("p_magnitude").alias("m"), kernels.spatial_density(F.col("r"), F.col("p_magnitude"), s.d, s.q, s.gamma, s.mc, s.cutoff).alias("density"))
    if near.limit(most + 1).count() > most:
        raise ValueError("more pairs than the driver may hold; fit on a shorter interval")
    table = rows.toPandas()
    active = acting(parents, start, end, s, Parameters())
    held = active.join(parent_masses(active, cells, s), "event_id").select("magnitude", "lower", "upper", "spatial_mass").toPandas()
    a = lambda x: x.to_numpy(np.float64)
    target = np.unique(table["target"].to_numpy(), return_inverse=True)[1].astype(np.int64)
    return Prepared(targets.count(), target, a(table["dt"]), a(table["m"]), a(table["density"]), a(held["magnitude"]), a(held["lower"]), a(held["upper"]), a(held["spatial_mass"]), end - start, area)


def branching(k: float, alpha: float, beta: float, span: float) -> float:
    if abs(alpha - beta) <= 1e-12:
        return k * beta * span / -np.expm1(-beta * span)
    return k * beta / (beta - alpha) * np.expm1(-(beta - alpha) * span) / np.expm1(-beta * span)


def objective(x: np.ndarray, d: Prepared, s: Spec) -> float:
    """Negative log-likelihood at logged parameters; infinite where a branching ratio of 0.95 is reached."""
    mu, k, alpha, c, p1 = np.exp(x)
    if branching(k, alpha, s.beta, s.most - s.mc) >= 0.95:
        return np.inf
    excited = k * np.exp(alpha * (d.m - s.mc)) * p1 / c * (1 + d.dt / c) ** (-p1 - 1) * d.density
    rate = np.bincount(d.target, excited, d.n) + mu / d.area
    mass = (1 + d.lower / c) ** -p1 - (1 + d.upper / c) ** -p1
    triggered = float((k * np.exp(alpha * (d.parent_m - s.mc)) * mass * d.mass).sum())
    out = mu * d.days + triggered - float(np.log(rate).sum())
    return out if np.isfinite(out) else np.inf


def gradient(f: Callable, x: np.ndarray, bounds: np.ndarray, step: float = 1e-6) -> np.ndarray:
    """Central differences; at a bound or beside an invalid point second-order one-sided ones."""
    out, here = np.zeros(len(x)), f(x)
    for i in range(len(x)):
        h = step * max(1.0, abs(x[i]))
        at = lambda t: x + t * h * np.eye(len(x))[i]  # noqa: B023, E731
        up = f(at(1)) if x[i] + h <= bounds[i, 1] else np.inf
        down = f(at(-1)) if x[i] - h >= bounds[i, 0] else np.inf
        if np.isfinite(up) and np.isfinite(down):
            out[i] = (up - down) / (2 * h)
        elif np.isfinite(up):
            out[i] = (4 * up - 3 * here - f(at(2))) / (2 * h)
        elif np.isfinite(down):
            out[i] = (3 * here - 4 * down + f(at(-2))) / (2 * h)
        else:
            raise ValueError("no valid stencil for the gradient")
    return out


def minimise(f: Callable, x: np.ndarray, bounds: np.ndarray, steps: int = 500, tolerance: float = 1e-6, memory: int = 10) -> tuple[np.ndarray, float, bool]:
    """Projected L-BFGS with backtracking: bounds hold at every point."""
    clip = lambda v: np.clip(v, bounds[:, 0], bounds[:, 1])
    x = clip(x)
    value, g, past = f(x), gradient(f, x, bounds), []
    for _ in range(steps):
        if np.abs(clip(x - g) - x).max() <= tolerance:
            return x, value, True
        free = ~(((x <= bounds[:, 0]) & (g > 0)) | ((x >= bounds[:, 1]) & (g < 0)))
        q, alphas = np.where(free, g, 0.0), []
        for ds, dg in reversed(past):
            a = ds @ q / (ds @ dg)
            alphas.append(a)
            q = q - a * dg
        if past:
            q = q * (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (ds, dg), a in zip(past, reversed(alphas), strict=True):
            q = q + (a - dg @ q / (ds @ dg)) * ds
        direction = np.where(free, -q, 0.0)
        if direction @ g >= 0:
            direction, past = np.where(free, -g, 0.0), []
        size = 1.0 if past else min(1.0, 1.0 / max(np.abs(g).sum(), 1e-12))
        while size > 1e-14:
            new = clip(x + size * direction)
            found = f(new)
            if found <= value + 1e-4 * (g @ (new - x)):
                break
            size /= 2
        else:
            return x, value, np.abs(clip(x - g) - x).max() <= 100 * tolerance
        new_g = gradient(f, new, bounds)
        ds, dg = new - x, new_g - g
        if ds @ dg > 1e-12:
            past = [*past[-memory + 1 :], (ds, dg)]
        x, g, change, value = new, new_g, value - found, found
        if change <= 1e-12 * max(1.0, abs(value)):
            return x, value, np.abs(clip(x - g) - x).max() <= 1e-4
    return x, value, False


def hessian(f: Callable, x: np.ndarray, step: float = 1e-4) -> np.ndarray:
    """Central second differences, made symmetric."""
    n, h = len(x), step * np.maximum(1.0, np.abs(x))
    e, here = np.diag(h), f(x)
    out = np.zeros((n, n))
    for i in range(n):
        out[i, i] = (f(x + e[i]) - 2 * here + f(x - e[i])) / h[i] ** 2
        for j in range(i):
            out[i, j] = out[j, i] = (f(x + e[i] + e[j]) - f(x + e[i] - e[j]) - f(x - e[i] + e[j]) + f(x - e[i] - e[j])) / (4 * h[i] * h[j])
    return out


class Audit(NamedTuple):
    """What a stable fit must show, and by how much."""

    stable: bool
    reasons: tuple[str, ...]
    converged: int
    spread: float | None  # relative range of the best three objectives
    parameter_range: float | None  # greatest range of a logged parameter among them
    least_eigenvalue: float | None
    condition: float | None
    curvature: np.ndarray | None


#: Starts that must converge, greatest gradient, ranges of the best three, least eigenvalue, greatest
#: condition number.
LEAST_CONVERGED, MOST_GRADIENT, MOST_SPREAD, MOST_RANGE, LEAST_EIGENVALUE, MOST_CONDITION = 4, 1e-4, 1e-4, 0.1, 1e-8, 1e10


def audit(f: Callable, results: list[tuple[np.ndarray, float, bool]], bounds: np.ndarray) -> Audit:
    """Judges the starts of a fit, each (point, objective, converged)."""
    clip = lambda v: np.clip(v, bounds[:, 0], bounds[:, 1])
    done = sorted((r for r in results if r[2] and np.isfinite(r[1])), key=lambda r: r[1])
    reasons, spread, reach, least, condition, curve = [], None, None, None, None, None
    if len(done) < LEAST_CONVERGED:
        reasons.append("starts")
    if any(np.abs(clip(x - gradient(f, x, bounds)) - x).max() > MOST_GRADIENT for x, _, _ in done):
        reasons.append("gradient")
    if len(done) >= 3:
        spread = (done[2][1] - done[0][1]) / max(1.0, abs(done[0][1]))
        reach = float(np.ptp(np.array([r[0] for r in done[:3]]), 0).max())
        reasons += ["spread"] * int(spread > MOST_SPREAD) + ["parameters"] * int(reach > MOST_RANGE)
    else:
        reasons.append("agreement")
    if done:
        x = done[0][0]
        inside = ((x - bounds[:, 0]) > 1e-3) & ((bounds[:, 1] - x) > 1e-3)
        curve = hessian(f, x) if inside.all() else None
        if curve is not None and np.isfinite(curve).all():
            eigen = np.linalg.eigvalsh(curve)
            least, condition = float(eigen[0]), float(eigen[-1] / eigen[0]) if eigen[0] > 0 else float("inf")
        if least is None or least < LEAST_EIGENVALUE or condition > MOST_CONDITION:
            reasons.append("curvature")
    else:
        reasons.append("curvature")
    return Audit(not reasons, tuple(reasons), len(done), spread, reach, least, condition, curve)


def branching_slope(alpha: float, beta: float, span: float) -> float:
    """The derivative by alpha of the mean productivity exp(alpha (m - mc)) under the truncated law, exactly: near
    alpha = beta, where the closed form divides by a vanishing number, by its series."""
    z = (beta - alpha) * span
    scale = beta * span / -np.expm1(-beta * span)
    if abs(z) < 1e-3:  # of (1 - exp(-z)) / z
        return scale * span * (1 / 2 - z / 3 + z**2 / 8 - z**3 / 30)
    return scale * span * (-np.expm1(-z) - z * np.exp(-z)) / z**2


def uncertainty(w: Parameters, judged: Audit, s: Spec) -> dict[str, tuple[float, float, float, float]]:
    """Value, deviation and 95 % interval of mu, K, alpha, c, p and the branching ratio by the delta method, from the
    curvature at the logged parameters. Only for a stable fit."""
    if not judged.stable or judged.curvature is None:
        raise ValueError("only a stable fit has an uncertainty")
    values = np.array([w.mu, w.k, w.alpha, w.c, w.p - 1])
    covariance = values[:, None] * np.linalg.inv(judged.curvature) * values[None, :]
    covariance = (covariance + covariance.T) / 2
    span = s.most - s.mc
    ratio = branching(w.k, w.alpha, s.beta, span)
    slope = np.array([0.0, ratio / w.k, w.k * branching_slope(w.alpha, s.beta, span), 0.0, 0.0])
    named = {n: (v, c) for n, v, c in zip(("mu", "k", "alpha", "c", "p"), (w.mu, w.k, w.alpha, w.c, w.p), np.diag(covariance), strict=True)}
    named["branching_ratio"] = (ratio, slope @ covariance @ slope)
    out = {}
    for n, (v, c) in named.items():
        if not c >= 0:
            raise ValueError(f"the variance of {n} is negative")
        d = float(np.sqrt(c))
        out[n] = (float(v), d, float(v - 1.959963984540054 * d), float(v + 1.959963984540054 * d))
    return out


class Fit(NamedTuple):
    parameters: Parameters
    log_likelihood: float
    converged: int
    stable: bool
    reason: str
    audit: Audit
    intervals: dict | None  # of a stable fit


def fit(d: Prepared, s: Spec, model: str = "etas", starts: int = 5, bounds: np.ndarray = BOUNDS) -> Fit:
    """Seeded starts, the best one, its audit and, where that is passed, its uncertainty."""
    f = lambda x: objective(x, d, s)
    results = []
    for i in range(starts):
        x = bounds[:, 0] + generator("tremora", "optimizer_start", model, replicate=i).random(len(bounds)) * (bounds[:, 1] - bounds[:, 0])
        while not np.isfinite(f(x)):
            x[1] -= 0.5  # less productive, until the branching ratio is valid
            x = np.clip(x, bounds[:, 0], bounds[:, 1])
        results.append(minimise(f, x, bounds))
    judged = audit(f, results, bounds)
    x, value, _ = min(results, key=lambda r: r[1])
    mu, k, alpha, c, p1 = np.exp(x)
    w = Parameters(mu, k, alpha, c, p1 + 1)
    return Fit(w, -value, judged.converged, judged.stable, ",".join(judged.reasons), judged, uncertainty(w, judged, s) if judged.stable else None)
