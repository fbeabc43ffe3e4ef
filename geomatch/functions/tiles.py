"""Web-map tile arithmetic as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6378137.0
CIRCUMFERENCE = 2 * math.pi * RADIUS


def zoom_for_resolution(res: Column) -> Column:
    """The zoom whose pixels are nearest to ``res`` metres, halves to the even zoom."""
    return F.bround(F.log2(F.lit(CIRCUMFERENCE / 256) / res)).cast("int")


def tile_size(z: Column) -> Column:
    return F.lit(CIRCUMFERENCE) / F.pow(F.lit(2.0), z)


def tile_bounds(z: Column, x: Column, y: Column) -> Column:
    """west, south, east, north in EPSG:3857; y counts from the north."""
    half, size = F.lit(CIRCUMFERENCE / 2), tile_size(z)
    return F.struct((x * size - half).alias("west"), (half - (y + 1) * size).alias("south"), ((x + 1) * size - half).alias("east"), (half - y * size).alias("north"))


def tile_name(z: Column, x: Column, y: Column) -> Column:
    return F.format_string("%d_%d_%d.tif", z, x, y)


def tile_url(template: str, z: Column, x: Column, y: Column) -> Column:
    url = F.lit(template)
    for mark, value in (("{z}", z), ("{x}", x), ("{y}", y)):
        url = F.replace(url, F.lit(mark), value.cast("string"))
    return url


def tile_column(lon: Column, z: Column) -> Column:
    n = F.pow(F.lit(2.0), z)
    return F.least(F.greatest(F.floor((lon + 180) / 360 * n), F.lit(0)), (n - 1).cast("long"))


def tile_row(lat: Column, z: Column) -> Column:
    n, s = F.pow(F.lit(2.0), z), F.sin(F.radians(lat))
    y = (F.lit(0.5) - F.log((1 + s) / (1 - s)) / (4 * math.pi)) * n
    return F.least(F.greatest(F.floor(y), F.lit(0)), (n - 1).cast("long"))
