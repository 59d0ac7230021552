"""Point-process kernels as column expressions: all of them stay inside whole-stage code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def productivity(m, k, alpha, mc) -> Column:
    """Mean number of direct offspring: K exp(alpha (m - Mc))."""
    return number(k) * F.exp(number(alpha) * (number(m) - number(mc)))


def omori_density(dt, c, p) -> Column:
    """((p - 1) / c) (1 + t / c) ** -p for t > 0, else 0."""
    t, c, p = number(dt), number(c), number(p)
    return F.when(t > 0, (p - 1) / c * F.exp(-p * F.log1p(t / c))).otherwise(0.0)


def omori_cdf(dt, c, p) -> Column:
    """1 - (1 + t / c) ** (1 - p) for t > 0, else 0; by expm1 and log1p, exact for short times."""
    t, c, p = number(dt), number(c), number(p)
    return F.when(t > 0, -F.expm1((1 - p) * F.log1p(t / c))).otherwise(0.0)


def spatial_scale(m, d, gamma, mc) -> Column:
    """sigma = D exp(gamma (m - Mc)), in km²."""
    return number(d) * F.exp(number(gamma) * (number(m) - number(mc)))


def untruncated_mass(r, sigma, q) -> Column:
    return -F.expm1((1 - number(q)) * F.log1p(number(r) * number(r) / sigma))


def cutoff_mass(m, d, q, gamma, mc, cutoff) -> Column:
    """The mass of the untruncated inverse power law within the cutoff radius."""
    return untruncated_mass(cutoff, spatial_scale(m, d, gamma, mc), q)


def spatial_density(r, m, d, q, gamma, mc, cutoff) -> Column:
    """Inverse power density, cut at the radius and renormalised; 0 beyond it."""
    r, q, sigma = number(r), number(q), spatial_scale(m, d, gamma, mc)
    inside = (q - 1) / (math.pi * sigma) * F.exp(-q * F.log1p(r * r / sigma)) / untruncated_mass(cutoff, sigma, q)
    return F.when(r <= number(cutoff), inside).otherwise(0.0)


def spatial_mass(r, m, d, q, gamma, mc, cutoff) -> Column:
    """Mass within r of the cut and renormalised law."""
    sigma = spatial_scale(m, d, gamma, mc)
    return untruncated_mass(F.least(number(r), number(cutoff)), sigma, q) / untruncated_mass(cutoff, sigma, q)


def log_one_minus_exp(x) -> Column:
    """log(1 - exp(-x)) for x > 0 without cancellation."""
    return F.when(x > math.log(2), F.log1p(-F.exp(-x))).otherwise(F.log(-F.expm1(-x)))


def truncated_gr_expectation(alpha, beta, span, tolerance: float = 1e-12) -> Column:
    """E exp(alpha X) for magnitudes above the least, exponential with beta and cut at span."""
    alpha, beta, span = number(alpha), number(beta), number(span)
    gap = F.abs(alpha - beta)
    rising = gap * span + log_one_minus_exp(gap * span) - F.log(gap)
    falling = log_one_minus_exp(gap * span) - F.log(gap)
    integral = F.when(gap <= tolerance, F.log(span)).when(alpha > beta, rising).otherwise(falling)
    return F.when(alpha == 0, 1.0).otherwise(F.exp(F.log(beta) + integral - log_one_minus_exp(beta * span)))


def branching_ratio(k, alpha, beta, span) -> Column:
    return number(k) * truncated_gr_expectation(alpha, beta, span)


def truncated_gr_expectation_slope(alpha, beta, span, step: float = 1e-5) -> Column:
    """Derivative of the expectation by alpha, by a central difference."""
    return (truncated_gr_expectation(number(alpha) + step, beta, span) - truncated_gr_expectation(number(alpha) - step, beta, span)) / (2 * step)


#: The completeness magnitudes that a study may use.
CANDIDATES = (3.0, 3.2, 3.5, 4.0)


def candidate_magnitude(estimate: Column) -> Column:
    """The least candidate not below the estimate; null above all of them."""
    out = F.lit(None).cast("double")
    for c in reversed(CANDIDATES):
        out = F.when(estimate <= c + 1e-12, c).otherwise(out)
    return out


def magnitude_bin(m: Column) -> Column:
    """Bins of 0.1, halves up, as an exact decimal."""
    return F.round(m.cast("decimal(12,4)"), 1)
