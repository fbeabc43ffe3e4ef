"""Generators and plans over rasters: tiles, patches, crops and training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geomatch.functions.tiles import tile_column, tile_row


def tile_cover(bboxes: DataFrame, zoom: int) -> DataFrame:
    """(z, x, y) of the tiles that meet west, south, east, north; a box over the antimeridian is two."""
    west, east = F.col("west"), F.col("east")
    parts = F.when(west > east, F.array(F.struct(west.alias("w"), F.lit(180.0).alias("e")), F.struct(F.lit(-180.0).alias("w"), east.alias("e")))).otherwise(F.array(F.struct(west.alias("w"), east.alias("e"))))
    b = bboxes.withColumn("_p", F.explode(parts)).withColumn("z", F.lit(zoom))
    tiny = 1e-11
    z = F.col("z")
    b = b.withColumn("x", F.explode(F.sequence(tile_column(F.col("_p.w"), z), tile_column(F.col("_p.e") - tiny, z))))
    return b.withColumn("y", F.explode(F.sequence(tile_row(F.col("north"), z), tile_row(F.col("south") + tiny, z)))).drop("_p")


def patch_grid(rasters: DataFrame, crop: int = 256, overlap: float = 0.66) -> DataFrame:
    """(x, y) of whole patches at each stride; a raster smaller than a patch has none."""
    stride = max(1, int(crop * (1 - overlap)))
    fits = rasters.where((F.col("width") >= crop) & (F.col("height") >= crop))
    return fits.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - crop, F.lit(stride)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - crop, F.lit(stride))))


def drop_nodata(patches: DataFrame, data: str = "data") -> DataFrame:
    return patches.where(F.exists(data, lambda v: v != 0))


def nodata_counts(patches: DataFrame, by: list[str], data: str = "data") -> DataFrame:
    some = F.exists(data, lambda v: v != 0)
    return patches.groupBy(*by).agg(F.count_if(some).alias("processed"), F.count_if(~some).alias("skipped"))


def crop_plan(crops: DataFrame, rasters: DataFrame) -> DataFrame:
    """Internal tiles that a crop (src, x, y, w, h) meets, with the rectangle they share; bad crops give an error row."""
    j = crops.join(rasters.select("src", "width", "height", "tile_width", "tile_height"), "src", "left")
    reason = F.when(F.col("width").isNull(), "no such raster").when((F.col("w") <= 0) | (F.col("h") <= 0), "empty crop").when((F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") >= F.col("width")) | (F.col("y") >= F.col("height")), "origin outside")
    j = j.withColumns({"error": reason, "w": F.least(F.col("w"), F.col("width") - F.col("x")), "h": F.least(F.col("h"), F.col("height") - F.col("y"))})
    across = F.ceil(F.col("width") / F.col("tile_width"))
    cell = lambda v, n: F.floor(v / n)
    none = F.array(F.lit(None).cast("long"))
    span = lambda p, n, t: F.when(F.col("error").isNull(), F.sequence(cell(F.col(p), F.col(t)), cell(F.col(p) + F.col(n) - 1, F.col(t)))).otherwise(none)
    j = j.withColumn("tx", F.explode(span("x", "w", "tile_width"))).withColumn("ty", F.explode(span("y", "h", "tile_height")))
    left, top = F.greatest(F.col("x"), F.col("tx") * F.col("tile_width")), F.greatest(F.col("y"), F.col("ty") * F.col("tile_height"))
    right, bottom = F.least(F.col("x") + F.col("w"), (F.col("tx") + 1) * F.col("tile_width")), F.least(F.col("y") + F.col("h"), (F.col("ty") + 1) * F.col("tile_height"))
    ok = F.col("error").isNull()
    return j.select(*crops.drop("w", "h").columns, "w", "h", "error", "tx", "ty", F.when(ok, F.col("ty") * across + F.col("tx")).alias("chunk_index"), F.when(ok, left).alias("left"), F.when(ok, top).alias("top"), F.when(ok, right - left).alias("part_width"), F.when(ok, bottom - top).alias("part_height"), "tile_width", "tile_height")


def rows_wanted(plan: DataFrame) -> DataFrame:
    """(src, chunk_index, row) of the chunk rows that the crops of a plan hold, once each: what a reader has to fetch."""
    top = F.col("top") - F.col("ty") * F.col("tile_height")
    spans = plan.where("error is null").select("src", "chunk_index", F.struct(top.alias("a"), (top + F.col("part_height") - 1).alias("b")).alias("s"))
    # a chunk has few different spans, however many crops meet it
    spans = spans.groupBy("src", "chunk_index").agg(F.collect_set("s").alias("s"))
    rows = F.array_distinct(F.flatten(F.transform("s", lambda s: F.sequence(s["a"], s["b"]))))
    return spans.select("src", "chunk_index", F.explode(rows).alias("row"))


def crop_assemble(plan: DataFrame, chunks: DataFrame, samples: int = 1) -> DataFrame:
    """(crop_id, data): bytes of a crop, rows from the top, put together from slices of chunk rows.

    ``plan`` is that of crop_plan with a crop_id; ``chunks`` (src, chunk_index, row, data), of which
    ``rows_wanted`` are enough. Chunk rows stream past the plan without a sort, and only the slices are
    dealt once more, by crop.
    """
    p = plan.where("error is null").select("crop_id", "src", "chunk_index", "tx", "ty", "left", "top", "part_width", "part_height", "tile_width", "tile_height")
    r = p.hint("shuffle_hash").join(chunks, ["src", "chunk_index"]).withColumn("_y", F.col("ty") * F.col("tile_height") + F.col("row")).where((F.col("_y") >= F.col("top")) & (F.col("_y") < F.col("top") + F.col("part_height")))
    piece = F.substring("data", ((F.col("left") - F.col("tx") * F.col("tile_width")) * samples + 1).cast("int"), (F.col("part_width") * samples).cast("int"))
    pieces = r.select("crop_id", F.struct("_y", "tx", piece.alias("b")).alias("s")).repartition("crop_id")
    whole = pieces.groupBy("crop_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    return whole.select("crop_id", F.unhex(F.array_join(F.transform("s", lambda x: F.hex(x["b"])), "")).alias("data"))


def prior_crop(prior: DataFrame, size: int = 256) -> DataFrame:
    """Window about the last known pixel of the same raster, cut at 0."""
    at = lambda c: F.greatest(F.lit(0), F.col(c) - size // 2).cast("long")
    return prior.withColumns({"x": at("pixel_x"), "y": at("pixel_y"), "w": F.lit(size), "h": F.lit(size)})


def gate_matches(matches: DataFrame, least: int = 20) -> DataFrame:
    """(frame_id, tile, matches) of candidates with enough matches."""
    return matches.groupBy("frame_id", "tile").agg(F.count("*").alias("matches")).where(F.col("matches") >= least)


def failed_frames(frames: DataFrame, gated: DataFrame) -> DataFrame:
    return frames.join(gated.select("frame_id").distinct(), "frame_id", "left_anti")


def _draw(span: Column, *key) -> Column:
    return F.pmod(F.xxhash64(*key), F.greatest(span, F.lit(1)))


def sample_anchors(rasters: DataFrame, n: int, size: int, scale: float = 1.0, seed: int = 0) -> DataFrame:
    """n crop centres a raster, inside a margin; the same for the same seed. Small rasters give none."""
    side = -(-int(size * 18 * scale) // 10)
    margin = (side + side % 2) // 2
    wide = rasters.where((F.col("width") > 2 * margin) & (F.col("height") > 2 * margin)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    at = lambda d, k: (margin + _draw(F.col(d) - 2 * margin, F.lit(seed), F.lit(k), "src", "i")).cast("long")
    return wide.withColumns({"cx": at("width", 0), "cy": at("height", 1), "margin": F.lit(margin)})


def sample_positives(anchors: DataFrame, n: int, size: int, seed: int = 0) -> DataFrame:
    """n shifted copies of an anchor, at most a quarter of the size away, kept inside the margin."""
    shift = size // 4
    p = anchors.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def moved(c: str, dim: str, k: int) -> Column:
        v = F.col(c) - shift + _draw(F.lit(2 * shift + 1), F.lit(seed), F.lit(k), "src", "i", "j")
        return F.least(F.greatest(v, F.col("margin")), F.col(dim) - F.col("margin")).cast("long")

    return p.withColumns({"px": moved("cx", "width", 2), "py": moved("cy", "height", 3)})


def choose_positives(pairs: DataFrame, n: int, train: bool, seed: int = 0) -> DataFrame:
    """n images of the array ``images``: drawn with replacement, or the first ones padded with the first."""
    size = F.size("images")
    if train:
        chosen = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get("images", F.pmod(F.xxhash64(F.lit(seed), "key", i), size).cast("int")))
    else:
        chosen = F.concat(F.slice("images", 1, n), F.array_repeat(F.get("images", F.lit(0)), F.greatest(F.lit(n) - size, F.lit(0))))
    return pairs.withColumn("chosen", chosen)


def label_samples(samples: DataFrame, iter_times: int) -> DataFrame:
    return samples.withColumn("label", F.col("raster_idx") * iter_times + F.col("i"))


def epoch_length(rasters: DataFrame, iter_times: int) -> DataFrame:
    return rasters.agg((F.count("*") * iter_times).alias("length"))
