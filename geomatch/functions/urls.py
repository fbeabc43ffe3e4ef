"""What a resource URL is, by the first rule that holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def classify_imagery(url: Column) -> Column:
    """provider and layer (of the national WMTS only)."""
    low = F.lower(url)
    national = url.contains("tianditu.gov.cn")
    named = F.regexp_extract(url, r"/([a-z]+)_w/wmts", 1)
    provider = (
        F.when(national & url.contains("DataServer"), "tianditu-template")
        .when(national, "tianditu-wmts")
        .when(url.contains("{z}") & url.contains("{x}") & url.contains("{y}"), "template")
        .when(low.contains("service=wms") | low.contains("request=getmap"), "wms")
        .when(low.contains("service=wmts") | low.contains("request=getcapabilities"), "wmts")
        .otherwise("unknown")
    )
    return F.struct(provider.alias("provider"), F.when(provider == "tianditu-wmts", F.when(named != "", named).otherwise("img")).alias("layer"))


def classify_vector(url: Column) -> Column:
    path = F.substring_index(F.lower(url), "?", 1)
    return F.when(path.endswith(".kml"), "kml").when(path.endswith(".czml"), "czml").otherwise("geojson")


def is_pointcloud(url: Column) -> Column:
    return F.lower(url).contains("pointcloud")
