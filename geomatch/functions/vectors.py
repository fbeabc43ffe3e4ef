"""Dense vectors in array columns; sums are made in double, from the left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    # bound once, as what a lambda holds is worked out for every element
    bound = F.transform(F.array(v), lambda w: F.struct(w.alias("v"), F.greatest(norm(w), F.lit(eps)).alias("n")))
    return F.transform(bound, lambda s: F.transform(s["v"], lambda x: x.cast("double") / s["n"]))[0]


def cosine(a: Column, b: Column, eps: float = 1e-12) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def imagenet_normalize(v: Column, mean: tuple = (0.485, 0.456, 0.406), std: tuple = (0.229, 0.224, 0.225), channels: int = 3) -> Column:
    """Channel-last pixels: scaled from 0..255 if any is over 1, then (x - mean) / std of the channel."""
    scale = F.when(F.array_max(v) > 1, F.lit(255.0)).otherwise(F.lit(1.0))
    m, s = F.array(*map(F.lit, mean)), F.array(*map(F.lit, std))
    return F.transform(v, lambda x, i: (x / scale - F.get(m, i % channels)) / F.get(s, i % channels))


def minmax_u8(v: Column) -> Column:
    """To 0..255 by range; a constant array keeps its values, cut to bytes."""
    lo, hi = F.array_min(v), F.array_max(v)
    return F.when(hi > lo, F.transform(v, lambda x: ((x - lo) / (hi - lo) * 255).cast("int"))).otherwise(F.transform(v, lambda x: x.cast("int")))
