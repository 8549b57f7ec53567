"""Great-circle geometry as Column expressions.

Joins use unit vectors: the squared chord between two points costs three
subtractions and three products per pair, the sines and cosines are paid once
per row, and the one arcsine is only taken for pairs that survive the filter.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle kilometres between two points given in degrees."""
    phi1, phi2 = F.radians(lat1), F.radians(lat2)
    half_dlat = (phi2 - phi1) / 2
    half_dlon = (F.radians(lon2) - F.radians(lon1)) / 2
    h = F.pow(F.sin(half_dlat), 2) + F.cos(phi1) * F.cos(phi2) * F.pow(F.sin(half_dlon), 2)
    h = F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0))
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(h))


def unit_vector(lat, lon) -> tuple[Column, Column, Column]:
    """Cartesian position on the unit sphere."""
    phi, lam = F.radians(lat), F.radians(lon)
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)


def chord_sq(a: tuple, b: tuple) -> Column:
    """Squared straight-line distance of two unit vectors."""
    dx, dy, dz = (F.col(p) - F.col(q) if isinstance(p, str) else p - q for p, q in zip(a, b))
    return dx * dx + dy * dy + dz * dz


SERIES_KM = 500.0  # up to here the arcsine series to the 11th power is exact to double precision
ARCSINE = 1 / 6, 3 / 40, 15 / 336, 105 / 3456, 945 / 42240


def chord_sq_limit(radius_km: Column) -> Column:
    """The squared chord that corresponds to a great-circle radius."""
    half_angle = F.least(radius_km / (2 * EARTH_RADIUS_KM), F.lit(math.pi / 2))
    return F.pow(2 * F.sin(half_angle), 2)


def chord_sq_to_km(c: Column, max_km: float | None = None) -> Column:
    """Great-circle kilometres of a squared chord.

    Up to 500 km the arcsine series to the 11th power is exact to double
    precision and needs only products, where the arcsine is a library call.
    """
    if max_km is not None and max_km <= SERIES_KM:
        s = c / 4
        series = 1 + s * (1 / 6 + s * (3 / 40 + s * (15 / 336 + s * (105 / 3456 + s * (945 / 42240)))))
        return EARTH_RADIUS_KM * F.sqrt(c) * series
    return 2 * EARTH_RADIUS_KM * F.asin(F.least(F.sqrt(c) / 2, F.lit(1.0)))


def distance_totals(x: np.ndarray, y: np.ndarray, radius_km: float, block: tuple[int, int]) -> np.ndarray:
    """For each unit vector (row) of ``x``: how many of ``y`` are within the radius, the sum of their kilometres, and the least (inf for none).

    Every pair is measured by its squared chord, around the centre of ``y``, so that small distances keep their digits; the closest are
    taken from the differences of the vectors.
    """
    limit = (2 * math.sin(min(radius_km / (2 * EARTH_RADIUS_KM), math.pi / 2))) ** 2
    terms = [c / 4**k for k, c in enumerate(ARCSINE, 1) if c * (limit / 4) ** k > 1e-18]
    lost = [~np.isfinite(v).all(axis=1) for v in (x, y)]  # no position
    x, y = (np.where(no[:, None], 0.0, v) for no, v in zip(lost, (x, y)))
    u, v = x - y.mean(axis=0), y - y.mean(axis=0)
    uu, vv = (u * u).sum(axis=1), (v * v).sum(axis=1)
    close = 1e-8 * (uu[~lost[0]].max(initial=0.0) + vv[~lost[1]].max(initial=0.0)) ** 2
    uu[lost[0]], vv[lost[1]] = 1e3, 1e3  # further than any
    u, v = np.column_stack([-2 * u, uu, np.ones(len(u))]), np.column_stack([v, np.ones(len(v)), vv])
    out, nearest = np.zeros((len(x), 3)), np.full(len(x), np.inf)
    for i in range(0, len(x), block[0]):
        r = slice(i, i + block[0])
        for j in range(0, len(y), block[1]):
            gap = u[r] @ v[j : j + block[1]].T
            least = gap.min(axis=1)
            if least.min() > limit:
                continue
            if least.min() < close:
                p, q = np.nonzero(gap < close)
                gap[p, q] = ((x[i + p] - y[j + q]) ** 2).sum(axis=1)
                least = gap.min(axis=1)
            np.minimum(nearest[r], least, out=nearest[r])
            inside = gap <= limit
            out[r, 0] += inside.sum(axis=1)
            gap *= inside
            chord = np.sqrt(gap)
            if radius_km <= SERIES_KM:
                series = np.full_like(gap, terms[-1]) if terms else np.zeros_like(gap)
                for c in [*terms[-2::-1], 1.0]:
                    series *= gap
                    series += c
                chord *= series
            else:
                chord = 2 * np.arcsin(np.minimum(chord / 2, 1.0))
            out[r, 1] += chord.sum(axis=1)
    out[:, 1] *= EARTH_RADIUS_KM
    near = nearest <= limit
    out[:, 2] = np.where(near, 2 * EARTH_RADIUS_KM * np.arcsin(np.minimum(np.sqrt(np.where(near, nearest, 0.0)) / 2, 1.0)), np.inf)
    return out


def nearest_point_km(lat, lon, points: list[tuple[float, float]]) -> Column:
    """Kilometres to the closest of a fixed short list of (lat, lon) points.

    The list is code, not data: the minimum is taken over squared chords so
    that a row needs one arcsine whatever the length of the list.
    """
    if not points or len(points) > 512:
        raise ValueError("nearest_point_km takes 1 to 512 points; join a table beyond that")
    here = unit_vector(lat, lon)
    gaps = []
    for plat, plon in points:
        phi, lam = math.radians(plat), math.radians(plon)
        there = (math.cos(phi) * math.cos(lam), math.cos(phi) * math.sin(lam), math.sin(phi))
        gaps.append(chord_sq(here, tuple(F.lit(v) for v in there)))
    return chord_sq_to_km(F.least(*gaps) if len(gaps) > 1 else gaps[0])


def in_box(lat, lon, box: dict) -> Column:
    """Inclusive bounding-box predicate; ``box`` has lat_min, lat_max, lon_min, lon_max."""
    return F.col(lat).between(box["lat_min"], box["lat_max"]) & F.col(lon).between(
        box["lon_min"], box["lon_max"]
    )

