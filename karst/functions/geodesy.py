"""Closed-form projections as column expressions: UTM by the Krueger series, Lambert's conformal conic and the polar stereographic, there and back."""

from __future__ import annotations

import math

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS 84 ellipsoid and UTM's scale and false origin.
A, FLATTENING, SCALE, EAST, NORTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0


def utm(lon: Column, lat: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Easting and northing in metres from degrees; accurate to well under a millimetre within the zone."""
    n = FLATTENING / (2 - FLATTENING)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    # third-order coefficients of the series
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    phi, lam = F.radians(lat), F.radians(lon - F.lit(6.0 * zone - 183.0))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - F.lit(e) * F.atanh(F.lit(e) * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(alpha, 1):
        x = x + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.lit(SCALE * radius) * x + F.lit(EAST), F.lit(SCALE * radius) * y + F.lit(NORTH if south else 0.0)


def inverse_utm(x: Column, y: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Longitude and latitude in degrees from metres."""
    n = FLATTENING / (2 - FLATTENING)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    xi, eta = (y - F.lit(NORTH if south else 0.0)) / F.lit(SCALE * radius), (x - F.lit(EAST)) / F.lit(SCALE * radius)
    a, b = xi, eta
    for j, k in enumerate(beta, 1):
        a = a - F.lit(k) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        b = b - F.lit(k) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    conformal = F.asin(F.sin(a) / F.cosh(b))
    lat = _latitude(F.tan(F.lit(math.pi / 4) - conformal / 2), FLATTENING)
    return F.degrees(F.atan2(F.sinh(b), F.cos(a))) + F.lit(6.0 * zone - 183.0), F.degrees(lat)


def _isometric(phi: Column, flattening: float) -> Column:
    """tan of half the conformal colatitude."""
    e = math.sqrt(flattening * (2 - flattening))
    s = F.lit(e) * F.sin(phi)
    return F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(e / 2))


def _plain_isometric(phi: float, flattening: float) -> float:
    e = math.sqrt(flattening * (2 - flattening))
    s = e * math.sin(phi)
    return math.tan(math.pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (e / 2)


def _width(phi: float, flattening: float) -> float:
    """Radius of a parallel over the equator's."""
    return math.cos(phi) / math.sqrt(1 - flattening * (2 - flattening) * math.sin(phi) ** 2)


def _latitude(t: Column, flattening: float) -> Column:
    """The latitude (radians) from _isometric, by the series of Adams in twice the conformal latitude."""
    e2 = flattening * (2 - flattening)
    chi = F.lit(math.pi / 2) - 2 * F.atan(t)
    series = (e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360, 7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520, 7 * e2**3 / 120 + 81 * e2**4 / 1120, 4279 * e2**4 / 161280)
    out = chi
    for j, k in enumerate(series, 1):
        out = out + F.lit(k) * F.sin(2 * j * chi)
    return out


#: Fixed values of two national grids (flattening, parallels, origin, false origin) and of a polar one (true parallel, meridian).
CONES = {3057: (1 / 298.257222101, (64.25, 65.75), (65.0, -19.0), (500000.0, 500000.0)), 8088: (1 / 298.257222101, (64.25, 65.75), (65.0, -19.0), (2700000.0, 300000.0))}
POLES = {3413: (FLATTENING, 70.0, -45.0)}


def _cone(code: int) -> tuple[float, float, float, float, Sequence[float], float]:
    flattening, parallels, (lat0, lon0), false = CONES[code]
    p, q = map(math.radians, parallels)
    n = math.log(_width(p, flattening) / _width(q, flattening)) / math.log(_plain_isometric(p, flattening) / _plain_isometric(q, flattening))
    f = A * _width(p, flattening) / (n * _plain_isometric(p, flattening) ** n)
    return flattening, n, f, f * _plain_isometric(math.radians(lat0), flattening) ** n, false, lon0


def cone(lon: Column, lat: Column, code: int) -> tuple[Column, Column]:
    flattening, n, f, r0, false, lon0 = _cone(code)
    r, turn = F.lit(f) * F.pow(_isometric(F.radians(lat), flattening), F.lit(n)), F.lit(n) * F.radians(lon - F.lit(lon0))
    return F.lit(false[0]) + r * F.sin(turn), F.lit(false[1] + r0) - r * F.cos(turn)


def inverse_cone(x: Column, y: Column, code: int) -> tuple[Column, Column]:
    flattening, n, f, r0, false, lon0 = _cone(code)
    dx, dy = x - F.lit(false[0]), F.lit(r0 + false[1]) - y
    t = F.pow(F.hypot(dx, dy) / F.lit(f), F.lit(1 / n))
    return F.degrees(F.atan2(dx, dy)) / F.lit(n) + F.lit(lon0), F.degrees(_latitude(t, flattening))


def polar(lon: Column, lat: Column, code: int) -> tuple[Column, Column]:
    flattening, true, lon0 = POLES[code]
    k = A * _width(math.radians(true), flattening) / _plain_isometric(math.radians(true), flattening)
    r, turn = F.lit(k) * _isometric(F.radians(lat), flattening), F.radians(lon - F.lit(lon0))
    return r * F.sin(turn), -r * F.cos(turn)


def inverse_polar(x: Column, y: Column, code: int) -> tuple[Column, Column]:
    flattening, true, lon0 = POLES[code]
    k = A * _width(math.radians(true), flattening) / _plain_isometric(math.radians(true), flattening)
    return F.degrees(F.atan2(x, -y)) + F.lit(lon0), F.degrees(_latitude(F.hypot(x, y) / F.lit(k), flattening))


def reproject(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """Between systems by their codes: 4326 (degrees), 32601 to 32660 and 32701 to 32760 (UTM), 3057, 8088 and 3413. Datums that differ by less than a metre are taken as one."""
    if source == target:
        return x, y
    zone = lambda code: (code % 100, code // 100 == 327) if code // 100 in (326, 327) and 1 <= code % 100 <= 60 else None
    for code in (source, target):
        if code != 4326 and code not in CONES and code not in POLES and zone(code) is None:
            raise ValueError(f"no projection for {code}")
    lon, lat = (x, y) if source == 4326 else inverse_cone(x, y, source) if source in CONES else inverse_polar(x, y, source) if source in POLES else inverse_utm(x, y, *zone(source))
    if target == 4326:
        return lon, lat
    return cone(lon, lat, target) if target in CONES else polar(lon, lat, target) if target in POLES else utm(lon, lat, *zone(target))
