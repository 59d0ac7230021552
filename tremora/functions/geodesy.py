"""Distances, projection and polygons: expressions for columns, NumPy for rings of any shape."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6371.0088
#: The WGS84 ellipsoid and the parallels of the equal-area projection.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
LAT_1, LAT_2, LAT_0, LON_0 = 25.0, 47.0, 0.0, 105.0
E2 = FLATTENING * (2 - FLATTENING)
ECC = math.sqrt(E2)


def great_circle_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Haversine distance, to nine decimals; 0 for the same point."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.sin(dlat / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon / 2) ** 2
    return F.round(2 * RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h))), 9)


def _q(sin: float) -> float:
    return (1 - E2) * (sin / (1 - E2 * sin * sin) + math.atanh(ECC * sin) / ECC)


def _albers_constants() -> tuple[float, float, float]:
    m = [math.cos(math.radians(x)) / math.sqrt(1 - E2 * math.sin(math.radians(x)) ** 2) for x in (LAT_1, LAT_2)]
    q = [_q(math.sin(math.radians(x))) for x in (LAT_1, LAT_2, LAT_0)]
    n = (m[0] ** 2 - m[1] ** 2) / (q[1] - q[0])
    c = m[0] ** 2 + n * q[0]
    return n, c, SEMI_MAJOR * math.sqrt(c - n * q[2]) / n


def albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Metres east and north in the equal-area projection."""
    n, c, rho0 = _albers_constants()
    s = F.sin(F.radians(lat))
    q = (1 - E2) * (s / (1 - E2 * s * s) + F.atanh(ECC * s) / ECC)
    rho, theta = SEMI_MAJOR * F.sqrt(c - n * q) / n, n * F.radians(lon - LON_0)
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def albers_points(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    n, c, rho0 = _albers_constants()
    s = np.sin(np.radians(lat))
    q = (1 - E2) * (s / (1 - E2 * s * s) + np.arctanh(ECC * s) / ECC)
    rho, theta = SEMI_MAJOR * np.sqrt(c - n * q) / n, n * np.radians(np.asarray(lon) - LON_0)
    return np.column_stack((rho * np.sin(theta), rho0 - rho * np.cos(theta)))


def signed_area(ring: np.ndarray) -> float:
    """Shoelace: positive if the ring runs counter-clockwise."""
    x, y = ring[:, 0], ring[:, 1]
    return float(np.dot(x, np.roll(y, -1)) - np.dot(np.roll(x, -1), y)) / 2


def oriented(ring: np.ndarray) -> np.ndarray:
    return ring if signed_area(ring) >= 0 else ring[::-1]


def covers(ring: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Whether each point lies in the ring or on it."""
    a, b = ring, np.roll(ring, -1, 0)
    px, py = points[:, :1], points[:, 1:]
    cross = (b[:, 0] - a[:, 0]) * (py - a[:, 1]) - (b[:, 1] - a[:, 1]) * (px - a[:, 0])
    between = (np.minimum(a[:, 0], b[:, 0]) <= px) & (px <= np.maximum(a[:, 0], b[:, 0])) & (np.minimum(a[:, 1], b[:, 1]) <= py) & (py <= np.maximum(a[:, 1], b[:, 1]))
    edge = ((cross == 0) & between).any(1)
    spans = (a[:, 1] > py) != (b[:, 1] > py)
    left = spans & ((cross > 0) == (b[:, 1] > a[:, 1]))
    return edge | (left.sum(1) % 2 == 1)


def ring_distance(ring: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distance of each point to the ring's line."""
    a, d = ring, np.roll(ring, -1, 0) - ring
    length = np.maximum((d**2).sum(1), 1e-300)
    t = np.clip(((points[:, None, :] - a) * d).sum(2) / length, 0, 1)
    return np.sqrt((((a + t[..., None] * d) - points[:, None, :]) ** 2).sum(2)).min(1)


def within(ring: np.ndarray, points: np.ndarray, buffer: float) -> np.ndarray:
    """Whether each point lies in the ring or at most ``buffer`` from it."""
    return covers(ring, points) | (ring_distance(ring, points) <= buffer)


def clip(ring: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """The part of a ring in a rectangle, cut by one side after another."""
    out = ring
    for axis, bound, keep in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        if not len(out):
            return out
        d, nxt = keep * (out[:, axis] - bound), np.roll(out, -1, 0)
        dn = keep * (nxt[:, axis] - bound)
        pieces = []
        for p, q, i, j in zip(out, nxt, d, dn, strict=True):
            if i >= 0:
                pieces.append(p)
            if (i > 0) != (j > 0) and i != j and i * j < 0:
                pieces.append(p + (q - p) * (i / (i - j)))
        out = np.array(pieces).reshape(-1, 2)
    return out


def representative_point(ring: np.ndarray) -> np.ndarray:
    """The area centroid if the ring covers it, else the middle of the longest run of a scan line inside."""
    area = signed_area(ring)
    nxt = np.roll(ring, -1, 0)
    w = ring[:, 0] * nxt[:, 1] - nxt[:, 0] * ring[:, 1]
    centre = ((ring + nxt) * w[:, None]).sum(0) / (6 * area) if area else ring.mean(0)
    if covers(ring, centre[None])[0]:
        return centre
    y = (ring[:, 1].min() + ring[:, 1].max()) / 2
    a, b = ring, nxt
    hit = (a[:, 1] > y) != (b[:, 1] > y)
    x = np.sort(a[hit, 0] + (y - a[hit, 1]) / (b[hit, 1] - a[hit, 1]) * (b[hit, 0] - a[hit, 0]))
    runs = x[1::2] - x[::2]
    i = int(runs.argmax())
    return np.array([(x[2 * i] + x[2 * i + 1]) / 2, y])
