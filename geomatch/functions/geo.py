"""Coordinates: affine pixels, reference systems, ECEF, ENU and homographies, all as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tiles import RADIUS

FLATTENING = 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
MEAN_RADIUS = 6371008.8
DEGREE_M = 111000.0


def pixel_to_map(col: Column, row: Column, a, b, c, d, e, f) -> Column:
    """Map place of the middle of a pixel."""
    x, y = col + 0.5, row + 0.5
    return F.struct((a * x + b * y + c).alias("x"), (d * x + e * y + f).alias("y"))


def map_to_pixel(x: Column, y: Column, a, b, c, d, e, f) -> Column:
    """Pixel that holds a map place; null where the affine has no inverse."""
    det = a * e - b * d
    safe = F.when(det != 0, det)
    return F.struct(F.floor((e * (x - c) - b * (y - f)) / safe).alias("col"), F.floor((a * (y - f) - d * (x - c)) / safe).alias("row"))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * MEAN_RADIUS * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def utm_epsg(lon: Column, lat: Column) -> Column:
    """Zone by longitude alone; the exceptions around Norway are not made."""
    zone = F.least(F.floor((lon + 180) / 6), F.lit(59)) + 1
    return (F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + zone).cast("int")


# series of the transverse Mercator projection in the third flattening
_N = FLATTENING / (2 - FLATTENING)
_A = RADIUS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_K0, _EAST, _SOUTH = 0.9996, 500000.0, 10000000.0


def _is_utm(epsg: Column) -> Column:
    return epsg.between(32601, 32660) | epsg.between(32701, 32760)


def _meridian(epsg: Column) -> Column:
    return F.radians((epsg % 100) * 6.0 - 183)


def to_wgs84(epsg: Column, x: Column, y: Column) -> Column:
    """lon, lat and reason: null lon, lat with a reason where the system has no closed form here."""
    xi = (y - F.when(epsg >= 32700, F.lit(_SOUTH)).otherwise(0.0)) / (_K0 * _A)
    eta = (x - _EAST) / (_K0 * _A)
    xi1, eta1 = xi, eta
    for j, b in enumerate(_BETA, 1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    lon = F.when(epsg == 4326, x).when(epsg == 3857, F.degrees(x / RADIUS)).when(_is_utm(epsg), F.degrees(_meridian(epsg) + F.atan2(F.sinh(eta1), F.cos(xi1))))
    lat = F.when(epsg == 4326, y).when(epsg == 3857, F.degrees(2 * F.atan(F.exp(y / RADIUS)) - math.pi / 2)).when(_is_utm(epsg), F.degrees(phi))
    reason = F.when(~((epsg == 4326) | (epsg == 3857) | _is_utm(epsg)) | epsg.isNull(), F.concat(F.lit("unsupported EPSG:"), F.coalesce(epsg.cast("string"), F.lit("null"))))
    return F.struct(lon.alias("lon"), lat.alias("lat"), reason.alias("reason"))


def from_wgs84(epsg: Column, lon: Column, lat: Column) -> Column:
    """x, y and reason, the inverse of to_wgs84."""
    phi, lam = F.radians(lat), F.radians(lon) - _meridian(epsg)
    k = 2 * math.sqrt(_N) / (1 + _N)
    atanh = lambda v: F.log((1 + v) / (1 - v)) / 2
    t = F.sinh(atanh(F.sin(phi)) - k * atanh(k * F.sin(phi)))
    xi0, eta0 = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    xi, eta = xi0, eta0
    for j, a in enumerate(_ALPHA, 1):
        xi = xi + a * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta + a * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    x = F.when(epsg == 4326, lon).when(epsg == 3857, F.radians(lon) * RADIUS).when(_is_utm(epsg), _EAST + _K0 * _A * eta)
    y = F.when(epsg == 4326, lat).when(epsg == 3857, RADIUS * F.log(F.tan(math.pi / 4 + phi / 2))).when(_is_utm(epsg), F.when(epsg >= 32700, F.lit(_SOUTH)).otherwise(0.0) + _K0 * _A * xi)
    reason = F.when(~((epsg == 4326) | (epsg == 3857) | _is_utm(epsg)) | epsg.isNull(), F.concat(F.lit("unsupported EPSG:"), F.coalesce(epsg.cast("string"), F.lit("null"))))
    return F.struct(x.alias("x"), y.alias("y"), reason.alias("reason"))


def resample_size(left, bottom, right, top, rx, ry) -> Column:
    """width and height at a new resolution, halves to even; the origin stays."""
    return F.struct(F.bround((right - left) / rx).cast("int").alias("width"), F.bround((top - bottom) / ry).cast("int").alias("height"))


def geodetic_to_ecef(lat: Column, lon: Column, alt: Column) -> Column:
    p, q = F.radians(lat), F.radians(lon)
    n = RADIUS / F.sqrt(1 - E2 * F.sin(p) * F.sin(p))
    return F.struct(((n + alt) * F.cos(p) * F.cos(q)).alias("x"), ((n + alt) * F.cos(p) * F.sin(q)).alias("y"), ((n * (1 - E2) + alt) * F.sin(p)).alias("z"))


def ecef_to_enu(p: Column, o: Column) -> Column:
    """East, north, up about an origin; up points away from the Earth's centre."""
    r = F.sqrt(o["x"] * o["x"] + o["y"] * o["y"] + o["z"] * o["z"])
    h = F.sqrt(o["x"] * o["x"] + o["y"] * o["y"])
    dx, dy, dz = p["x"] - o["x"], p["y"] - o["y"], p["z"] - o["z"]
    east = (o["x"] * dy - o["y"] * dx) / h
    along = (o["x"] * dx + o["y"] * dy) / h
    return F.struct(east.alias("e"), ((dz * h - along * o["z"]) / r).alias("n"), ((along * h + dz * o["z"]) / r).alias("u"))


def distance3(a: Column, b: Column, names: tuple[str, str, str] = ("x", "y", "z")) -> Column:
    return F.sqrt(sum(((a[n] - b[n]) * (a[n] - b[n]) for n in names), F.lit(0.0)))


def track_cost(distance: Column, inliers: Column) -> Column:
    return distance + 10.0 / (inliers + 1)


def apply_homography(h: Column, x: Column, y: Column) -> Column:
    """Place of (x, y) under a row-major 3x3 array; null where it goes to infinity."""
    w = h[6] * x + h[7] * y + h[8]
    safe = F.when(w != 0, w)
    return F.struct(((h[0] * x + h[1] * y + h[2]) / safe).alias("x"), ((h[3] * x + h[4] * y + h[5]) / safe).alias("y"))


def project_center(lon0, lat0, px, py, res_x, res_y, cx, cy, h: Column) -> Column:
    """Location of a frame's middle (cx, cy in the tile) by metres a degree; missing resolution is 0.5."""
    rx, ry = F.coalesce(res_x, F.lit(0.5)), F.coalesce(res_y, F.lit(0.5))
    lat = lat0 - cy * ry / DEGREE_M
    lon = lon0 + cx * rx / (DEGREE_M * F.cos(F.radians(lat0)))
    whole = lambda v: F.greatest(F.lit(0), v.cast("long"))
    return F.struct(lat.alias("lat"), lon.alias("lon"), (px + whole(cx)).alias("pixel_x"), (py + whole(cy)).alias("pixel_y"), F.degrees(F.atan2(h[3], h[0])).alias("yaw"), geodetic_to_ecef(lat, lon, F.lit(0.0)).alias("ecef"))


def _product(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)]


def pose_homography(w, h, pitch, roll, yaw, fov, scale=1.0) -> Column:
    """K Rz Ry Rx K^-1 for angles in degrees, with an optional scale about the middle; row-major."""
    zero, one = F.lit(0.0), F.lit(1.0)
    f, cx, cy = (w / 2) / F.tan(F.radians(fov) / 2), w / 2, h / 2
    turn = lambda v: (F.cos(F.radians(v)), F.sin(F.radians(v)))
    (cp, sp), (cr, sr), (cw, sw) = turn(pitch), turn(roll), turn(yaw)
    rx = [one, zero, zero, zero, cp, -sp, zero, sp, cp]
    ry = [cr, zero, sr, zero, one, zero, -sr, zero, cr]
    rz = [cw, -sw, zero, sw, cw, zero, zero, zero, one]
    k, inverse = [f, zero, cx, zero, f, cy, zero, zero, one], [1 / f, zero, -cx / f, zero, 1 / f, -cy / f, zero, zero, one]
    s = F.lit(float(scale))
    zoom = [s, zero, cx * (1 - s), zero, s, cy * (1 - s), zero, zero, one]
    m = k
    for x in (rz, ry, rx, inverse):
        m = _product(m, x)
    return F.array(*_product(zoom, m))


def rotated_size(w: Column, h: Column, degrees: Column) -> Column:
    c, s = F.abs(F.cos(F.radians(degrees))), F.abs(F.sin(F.radians(degrees)))
    return F.struct(F.floor(h * s + w * c).alias("width"), F.floor(h * c + w * s).alias("height"))


def center_crop_plan(w: Column, h: Column, size: Column) -> Column:
    """Window about the middle; what lacks is padded, the odd pixel after."""
    pad = lambda n: F.greatest(size - n, F.lit(0))
    start = lambda n: F.floor(F.greatest(n - size, F.lit(0)) / 2)
    half = lambda n: F.floor(pad(n) / 2)
    return F.struct(start(w).alias("x"), start(h).alias("y"), F.least(w, size).alias("width"), F.least(h, size).alias("height"), half(w).alias("left"), (pad(w) - half(w)).cast("long").alias("right"), half(h).alias("top"), (pad(h) - half(h)).cast("long").alias("bottom"))
