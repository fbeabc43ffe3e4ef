"""A space-filling curve over longitude and latitude, and circles as ranges of it."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from geomatch.functions.geo import MEAN_RADIUS

#: Bits of each coordinate: cells of 0.6 m by 0.3 m at the equator.
BITS = 26
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _step(value, low: float, span: float):
    return (value - low) / span * (1 << BITS)


def curve(lon: Column, lat: Column) -> Column:
    """Place on the curve, with the bits of both coordinates in turn; -1 where there is no place."""
    top = (1 << BITS) - 1
    at = lambda c, low, span: F.least(F.greatest(F.floor(_step(c, low, span)), F.lit(0)), F.lit(top)).cast("long")

    def spread(c: Column) -> Column:
        for shift, mask in _SPREAD:
            c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
        return c

    placed = lon.isNotNull() & lat.isNotNull() & ~F.isnan(lon) & ~F.isnan(lat)
    east = F.when(lon == 180.0, lon).otherwise(F.pmod(lon + 180.0, F.lit(360.0)) - 180.0)
    z = spread(at(east, -180.0, 360.0)).bitwiseOR(F.shiftleft(spread(at(lat, -90.0, 180.0)), 1))
    return F.when(placed, z).otherwise(F.lit(-1).cast("long"))


def boxes(lon: float, lat: float, radius_m: float) -> list[tuple[float, float, float, float]]:
    """(west, south, east, north) around a circle: one box, or two across the date line."""
    d = radius_m / MEAN_RADIUS * 1.000001 + 1e-9
    south, north = lat - math.degrees(d), lat + math.degrees(d)
    if south <= -90 or north >= 90 or d >= math.pi / 2:
        return [(-180.0, max(south, -90.0), 180.0, min(north, 90.0))]
    half = math.degrees(math.asin(min(1.0, math.sin(d) / math.cos(math.radians(lat))))) * 1.000001 + 1e-9
    lon = (lon + 180.0) % 360.0 - 180.0
    if half >= 180:
        return [(-180.0, south, 180.0, north)]
    if lon - half < -180:
        return [(-180.0, south, lon + half, north), (lon - half + 360, south, 180.0, north)]
    if lon + half > 180:
        return [(lon - half, south, 180.0, north), (-180.0, south, lon + half - 360, north)]
    return [(lon - half, south, lon + half, north)]


def ranges(lon: float, lat: float, radius_m: float, most: int = 64) -> list[tuple[int, int]]:
    """Ranges of the curve, both ends included, that hold every point of a circle; about ``most`` of them.

    Squares of the curve that meet the circle's box are quartered, level by level, as long as there
    are few enough; neighbouring ones become one range.
    """
    top = (1 << BITS) - 1
    cell = lambda v, low, span: min(max(math.floor(_step(v, low, span)), 0), top)
    # in cells, as a point is placed by the same arithmetic
    wanted = [(cell(w, -180.0, 360.0), cell(s, -90.0, 180.0), cell(e, -180.0, 360.0), cell(n, -90.0, 180.0)) for w, s, e, n in boxes(lon, lat, radius_m)]
    done: list[tuple[int, int]] = []
    open_ = [(0, 0, 0, BITS)]

    def meets(x: int, y: int, size: int) -> int:
        """0: no box, 1: part of one, 2: all inside one."""
        best = 0
        for w, s, e, n in wanted:
            if x <= e and x + size - 1 >= w and y <= n and y + size - 1 >= s:
                best = max(best, 2 if w <= x and x + size - 1 <= e and s <= y and y + size - 1 <= n else 1)
        return best

    while open_ and len(open_) + len(done) <= most:
        after = []
        for z, x, y, level in open_:
            if level == 0:
                done.append((z, z))
                continue
            half, part = 1 << (level - 1), 1 << 2 * (level - 1)
            for k in range(4):
                cx, cy, cz = x + (k & 1) * half, y + (k >> 1) * half, z + k * part
                kind = meets(cx, cy, half)
                if kind == 2:
                    done.append((cz, cz + part - 1))
                elif kind:
                    after.append((cz, cx, cy, level - 1))
        open_ = after
    out: list[tuple[int, int]] = []
    for low, high in sorted(done + [(z, z + (1 << 2 * level) - 1) for z, _, _, level in open_]):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out
