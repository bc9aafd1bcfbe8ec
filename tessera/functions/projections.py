"""Map projections on the GRS80 ellipsoid as column expressions: Lambert azimuthal equal-area and transverse Mercator."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: GRS80; fixed values.
A, FLAT = 6378137.0, 1 / 298.257222101
E2 = FLAT * (2 - FLAT)
E = math.sqrt(E2)


def _q(sin_lat, log):
    return (1 - E2) * (sin_lat / (1 - E2 * sin_lat * sin_lat) - log((1 - E * sin_lat) / (1 + E * sin_lat)) / (2 * E))


_QP = _q(1.0, math.log)
_RQ = A * math.sqrt(_QP / 2)


def _frame(lat0: float) -> tuple[float, float, float]:
    s = math.sin(math.radians(lat0))
    beta = math.asin(_q(s, math.log) / _QP)
    d = A * math.cos(math.radians(lat0)) / math.sqrt(1 - E2 * s * s) / (_RQ * math.cos(beta))
    return math.sin(beta), math.cos(beta), d


def laea(lon: Column, lat: Column, lon0: float, lat0: float, fe: float = 0.0, fn: float = 0.0) -> tuple[Column, Column]:
    """Degrees -> metres (x, y)."""
    sb0, cb0, d = _frame(lat0)
    beta = F.asin(_q(F.sin(F.radians(lat)), F.log) / _QP)
    dl = F.radians(lon - lon0)
    b = _RQ * F.sqrt(2 / (1 + sb0 * F.sin(beta) + cb0 * F.cos(beta) * F.cos(dl)))
    return fe + b * d * F.cos(beta) * F.sin(dl), fn + b / d * (cb0 * F.sin(beta) - sb0 * F.cos(beta) * F.cos(dl))


def laea_inverse(x: Column, y: Column, lon0: float, lat0: float, fe: float = 0.0, fn: float = 0.0) -> tuple[Column, Column]:
    """Metres -> degrees (lon, lat); the series for latitude is good to below a millimetre."""
    sb0, cb0, d = _frame(lat0)
    u, v = (x - fe) / d, (y - fn) * d
    rho = F.hypot(u, v)
    c = 2 * F.asin(rho / (2 * _RQ))
    beta = F.when(rho == 0, F.lit(math.asin(sb0))).otherwise(F.asin(F.cos(c) * sb0 + v * F.sin(c) * cb0 / rho))
    lon = lon0 + F.degrees(F.atan2((x - fe) / d * F.sin(c), rho * cb0 * F.cos(c) - v * sb0 * F.sin(c)))
    e4, e6 = E2**2, E2**3
    lat = beta + (E2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta) + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta) + 761 * e6 / 45360 * F.sin(6 * beta)
    return F.when(rho == 0, F.lit(float(lon0))).otherwise(lon), F.degrees(lat)


def _kruger(n: float) -> tuple[float, list[float], list[float]]:
    """Rectifying radius factor, forward and inverse coefficients to the fourth order in the third flattening."""
    radius = (1 + n**2 / 4 + n**4 / 64) / (1 + n)
    ahead = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    return radius, ahead, back


def transverse_mercator(lon: Column, lat: Column, lon0: float, k0: float, fe: float, fn: float, a: float = A, f: float = FLAT) -> tuple[Column, Column]:
    """Degrees -> metres (east, north), by Krüger's series."""
    e = math.sqrt(f * (2 - f))
    radius, ahead, _ = _kruger(f / (2 - f))
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    dl = F.radians(lon - lon0)
    xi, eta = F.atan2(t, F.cos(dl)), F.asinh(F.sin(dl) / F.hypot(t, F.cos(dl)))
    x, y = eta, xi
    for j, c in enumerate(ahead, 1):
        y = y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        x = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return fe + k0 * a * radius * x, fn + k0 * a * radius * y


def transverse_mercator_inverse(x: Column, y: Column, lon0: float, k0: float, fe: float, fn: float, a: float = A, f: float = FLAT) -> tuple[Column, Column]:
    radius, _, back = _kruger(f / (2 - f))
    xi0, eta0 = (y - fn) / (k0 * a * radius), (x - fe) / (k0 * a * radius)
    xi, eta = xi0, eta0
    for j, c in enumerate(back, 1):
        xi = xi - c * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - c * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    e2 = f * (2 - f)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    e4, e6, e8 = e2**2, e2**3, e2**4
    lat = (
        chi + (e2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360) * F.sin(2 * chi) + (7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520) * F.sin(4 * chi)
        + (7 * e6 / 120 + 81 * e8 / 1120) * F.sin(6 * chi) + 4279 * e8 / 161280 * F.sin(8 * chi)
    )
    return lon0 + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(lat)
