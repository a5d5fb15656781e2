"""Map projections and ground measures as column expressions (published formulas)."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6378137.0
SPHERE = 6371000.0
_F = 1 / 298.257223563
_N = _F / (2 - _F)
_A = EARTH / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_K0 = 0.9996


def utm_zone(lon: Column) -> Column:
    return F.floor((lon + 180) / 6).cast("int") + 1


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)


def utm_forward(lon: Column, lat: Column, zone: Column) -> Column:
    """Easting and northing in a zone (Krueger series to the third order)."""
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    c = 2 * _N**0.5 / (1 + _N)
    atanh = lambda v: F.log((1 + v) / (1 - v)) / 2
    t = F.sinh(atanh(F.sin(phi)) - c * atanh(c * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    e, n = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        e = e + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        n = n + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((500000 + _K0 * _A * e).alias("x"), (F.when(lat >= 0, 0.0).otherwise(1e7) + _K0 * _A * n).alias("y"))


def utm_inverse(x: Column, y: Column, zone: Column, north: Column) -> Column:
    xi = (y - F.when(north, 0.0).otherwise(1e7)) / (_K0 * _A)
    eta = (x - 500000) / (_K0 * _A)
    u, v = xi, eta
    for j, b in enumerate(_BETA, 1):
        u = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.struct((F.degrees(F.atan2(F.sinh(v), F.cos(u))) + zone * 6 - 183).alias("lon"), F.degrees(lat).alias("lat"))


def local_forward(lon: Column, lat: Column, lon0: Column, lat0: Column) -> Column:
    """Equirectangular metres around an origin."""
    return F.struct((F.radians(lon - lon0) * EARTH * F.cos(F.radians(lat0))).alias("x"), (F.radians(lat - lat0) * EARTH).alias("y"))


def local_inverse(x: Column, y: Column, lon0: Column, lat0: Column) -> Column:
    return F.struct((lon0 + F.degrees(x / (EARTH * F.cos(F.radians(lat0))))).alias("lon"), (lat0 + F.degrees(y / EARTH)).alias("lat"))


def tile_of(lon: Column, lat: Column, zoom: int) -> Column:
    """Slippy-map tile that holds a position."""
    n = 1 << zoom
    y = (1 - F.asinh(F.tan(F.radians(lat))) / pi) / 2 * n
    return F.struct(F.floor((lon + 180) / 360 * n).cast("int").alias("x"), F.floor(y).cast("int").alias("y"))


def tile_corner(x: Column, y: Column, zoom: int) -> Column:
    """North-west corner of a tile in degrees."""
    n = 1 << zoom
    return F.struct((x / n * 360 - 180).alias("lon"), F.degrees(F.atan(F.sinh(pi * (1 - 2 * y / n)))).alias("lat"))


def tile_pixel_size(lat: Column, zoom: Column) -> Column:
    """Ground metres of a 256-pixel tile's pixel."""
    return 2 * pi * EARTH * F.cos(F.radians(lat)) / (256 * F.pow(F.lit(2.0), zoom))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * SPHERE * F.asin(F.sqrt(a))


def geo_box(lat: Column, lon: Column, width_m: Column, aspect: Column) -> Column:
    """Degrees of a box of a ground width (height: width times ``aspect``) around its centre."""
    dx, dy = width_m / 2 / (111320 * F.cos(F.radians(lat))), width_m * aspect / 2 / 110574
    return F.struct((lon - dx).alias("west"), (lat - dy).alias("south"), (lon + dx).alias("east"), (lat + dy).alias("north"))


def pixel_to_ground(col: Column, row: Column, origin_x: Column, origin_y: Column, gsd: Column) -> Column:
    """Centre of a north-up raster's pixel."""
    return F.struct((origin_x + (col + 0.5) * gsd).alias("x"), (origin_y - (row + 0.5) * gsd).alias("y"))


def lonlat_ring_area(ring: Column) -> Column:
    """Square metres of a lon/lat ring, with metres a degree at its first vertex."""
    from cadaspark.functions.geometry import signed_ring_area

    k = 111320 * 110574 * F.cos(F.radians(F.element_at(ring, 1)["y"]))
    return F.abs(signed_ring_area(ring)) * k


def area_km2(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Square kilometres of a box in degrees, at 111.32 km a degree."""
    return (east - west) * 111.32 * F.cos(F.radians((south + north) / 2)) * (north - south) * 111.32
