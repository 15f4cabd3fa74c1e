"""Transverse Mercator as column expressions.

Series in the third flattening (Krueger), to the fourth order (four terms each); far under a
millimetre within a UTM zone and its neighbours. WGS 84 ellipsoid, UTM scale and false easting.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_A, _F = 6_378_137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_RECT = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
_K0, _FALSE_E = 0.9996, 500_000.0
_E = (_F * (2 - _F)) ** 0.5
#: Metres of a unit of the rectified sphere.
SCALE = _K0 * _RECT
#: Series coefficients of the forward and the inverse mapping.
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _let(f, **values) -> Column:
    """``f`` of named values, each worked out once: series nest, and repeated expressions would grow with every step."""
    bound = F.struct(*[v.alias(k) for k, v in values.items()])
    return F.get(F.transform(F.array(bound), lambda s: f(**{k: s[k] for k in values})), F.lit(0))


def _geographic(easting, northing, zone) -> Column:
    def conformal(xi, eta):
        xi2 = xi - sum(b * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, b in enumerate(_BETA))
        eta2 = eta - sum(b * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, b in enumerate(_BETA))
        return _let(angles, xi2=xi2, eta2=eta2)

    def angles(xi2, eta2):
        lat = lambda chi: chi + sum(d * F.sin(2 * (j + 1) * chi) for j, d in enumerate(_DELTA))
        lon = F.radians(6.0 * _c(zone) - 183.0) + F.atan2(F.sinh(eta2), F.cos(xi2))
        return F.struct(F.degrees(lon).alias("lon"), F.degrees(_let(lat, chi=F.asin(F.sin(xi2) / F.cosh(eta2)))).alias("lat"))

    return _let(conformal, xi=_c(northing) / SCALE, eta=(_c(easting) - _FALSE_E) / SCALE)


def _projected(lon, lat, zone) -> Column:
    def rectified(s, lam):
        return _let(series_of, t=F.sinh(F.atanh(s) - _E * F.atanh(_E * s)), lam=lam)

    def series_of(t, lam):
        return _let(plane, xi=F.atan2(t, F.cos(lam)), eta=F.atanh(F.sin(lam) / F.sqrt(1 + t * t)))

    def plane(xi, eta):
        xi2 = xi + sum(a * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, a in enumerate(_ALPHA))
        eta2 = eta + sum(a * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, a in enumerate(_ALPHA))
        return F.struct((_FALSE_E + SCALE * eta2).alias("x"), (SCALE * xi2).alias("y"))

    return _let(rectified, s=F.sin(F.radians(_c(lat))), lam=F.radians(_c(lon)) - F.radians(6.0 * _c(zone) - 183.0))


def to_geographic(easting, northing, zone) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of UTM coordinates (northern half)."""
    got = _geographic(easting, northing, zone)
    return got["lon"], got["lat"]


def from_geographic(lon, lat, zone) -> tuple[Column, Column]:
    """Easting and northing in a UTM zone (northern half)."""
    got = _projected(lon, lat, zone)
    return got["x"], got["y"]


def change_zone(easting, northing, source, target) -> tuple[Column, Column]:
    """UTM coordinates of one zone in another."""
    number = lambda z: F.lit(z) if isinstance(z, int) else _c(z)
    at = _geographic(easting, northing, number(source))
    got = _let(lambda p: _projected(p["lon"], p["lat"], number(target)), p=at)
    return got["x"], got["y"]


def centre_label(xmin, ymin, xmax, ymax, zone) -> Column:
    """Centre as a file-name label: absolute degrees, points replaced by underscores."""
    lon, lat = to_geographic((_c(xmin) + _c(xmax)) / 2, (_c(ymin) + _c(ymax)) / 2, zone)
    part = lambda v: F.replace(F.round(F.abs(v), 6).cast("string"), F.lit("."), F.lit("_"))
    return F.concat_ws("_", part(lat), part(lon))
