"""Picture operators: sizes, tiles, signatures and pixel statistics of decoded pictures.

Pictures are decoded in batches (sources/pictures.py) and reduced to small grids, on which signatures and statistics are
computed for many pictures at once. What can't be decoded counts as broken, and the broken count is always reported.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.operators.selection import exact_quantiles
from curatrix.session import settled
from curatrix.sources.pictures import BrokenPicture, grey, pixels_of, resampled

# Width and height of the reduced pictures for hash, colour and statistics, the colour step, the quantiles, the shortest side of a picture that isn't small.
HASH_GRID, COLOUR_GRID, STATISTICS_GRID = (9, 8), (8, 8), (16, 16)
COLOUR_STEP, QUANTILES, SMALL_SIDE = 16, (0.1, 0.5, 0.9), 224
# Means and deviations of the three channels by which tiles are normalised.
CHANNEL_MEANS, CHANNEL_DEVIATIONS = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)

FIELDS = "width int, height int, dhash string, signature string, features array<double>, broken boolean"


def capped_size(width: Column, height: Column, most_pixels: int, step: int = 28) -> Column:
    """struct(width, height): at most most_pixels, both multiples of step and at least one step; smaller pictures keep their size."""
    scale = F.sqrt(F.lit(float(most_pixels)) / (width * height))
    fit = lambda x: F.greatest(F.lit(step), F.floor(F.floor(x * scale) / step) * step).cast("int")
    small = width * height <= most_pixels
    return F.struct(F.when(small, width).otherwise(fit(width)).alias("width"), F.when(small, height).otherwise(fit(height)).alias("height"))


def tiling(width: Column, height: Column, most: int = 6) -> Column:
    """struct(columns, rows, tiles): the grid of at most `most` tiles nearest in aspect ratio, with a thumbnail if it has several."""
    grids = sorted({(c, r) for c in range(1, most + 1) for r in range(1, most + 1) if c * r <= most}, key=lambda g: (g[0] * g[1], g))
    ratio = width / height
    each = F.array(*[F.struct(F.round(F.abs(ratio - c / r), 9).alias("d"), F.lit(c * r).alias("n"), F.lit(c).alias("columns"), F.lit(r).alias("rows")) for c, r in grids])
    best = F.array_min(each)
    return F.struct(best["columns"].alias("columns"), best["rows"].alias("rows"), (best["n"] + F.when(best["n"] > 1, 1).otherwise(0)).alias("tiles"))


def capped(pixels: np.ndarray, most_pixels: int, step: int = 28) -> np.ndarray:
    """The picture at capped_size."""
    height, width = pixels.shape[:2]
    if width * height <= most_pixels:
        return pixels
    scale = math.sqrt(most_pixels / (width * height))
    return resampled(pixels, *(max(step, math.floor(x * scale) // step * step) for x in (width, height)))


def tiles(pixels: np.ndarray, side: int, most: int = 6) -> np.ndarray:
    """What a tiled encoder reads, (tiles, side, side, 3): the picture on the nearest grid of squares, row by row, and a thumbnail where there are several.

    Values are shares of 255, centred and scaled by the channels' usual means and deviations.
    """
    height, width = pixels.shape[:2]
    grids = sorted({(c, r) for c in range(1, most + 1) for r in range(1, most + 1) if c * r <= most}, key=lambda g: (g[0] * g[1], g))
    columns, rows = min(grids, key=lambda g: round(abs(width / height - g[0] / g[1]), 9))
    whole = resampled(pixels, columns * side, rows * side)
    made = [whole[r * side : (r + 1) * side, c * side : (c + 1) * side] for r in range(rows) for c in range(columns)]
    if len(made) > 1:
        made.append(resampled(pixels, side, side))
    return (np.stack(made) / 255.0 - CHANNEL_MEANS) / CHANNEL_DEVIATIONS


def brighter_to_the_right(grey_grids: np.ndarray) -> np.ndarray:
    """(pictures, bits): 1 where a place of the grid is darker than the one to its right, of reduced pictures (pictures, height, width)."""
    return (np.diff(grey_grids.astype(np.int16), axis=2) > 0).reshape(len(grey_grids), -1)


def pixel_statistics(shares: np.ndarray) -> np.ndarray:
    """(pictures, 9) of pictures (pictures, height, width, 3) with values from 0 to 1: mean and deviation of each channel, then quantiles of all values."""
    n = len(shares)
    by_channel = shares.reshape(n, -1, 3)
    return np.concatenate([by_channel.mean(axis=1), by_channel.std(axis=1), np.quantile(shares.reshape(n, -1), QUANTILES, axis=1).T], axis=1)


def picture_facts(pictures: list[np.ndarray]) -> dict[str, list]:
    """What FIELDS names, a list of each, of upright pictures (height, width, 3)."""
    if not pictures:
        return {name: [] for name in ("width", "height", "dhash", "signature", "features")}
    on = lambda grid: np.stack([resampled(p, *grid) for p in pictures])
    bits = brighter_to_the_right(np.stack([resampled(grey(p)[:, :, None], *HASH_GRID)[:, :, 0] for p in pictures]))
    tints = np.rint(on(COLOUR_GRID).mean(axis=(1, 2)) / COLOUR_STEP).astype(np.uint8)
    return {
        "width": [p.shape[1] for p in pictures], "height": [p.shape[0] for p in pictures],
        "dhash": [hashlib.sha256(b.tobytes()).hexdigest() for b in bits], "signature": [hashlib.sha256(b.tobytes() + t.tobytes()).hexdigest() for b, t in zip(bits, tints, strict=True)],
        "features": pixel_statistics(on(STATISTICS_GRID) / 255.0).tolist(),
    }


def decode(files: DataFrame, content: str = "content", most_pixels: int | None = None) -> DataFrame:
    """files with picture, a struct of FIELDS; what can't be decoded, null content included, has broken = true and nulls. most_pixels reduces larger pictures first, and
    is the size that counts then."""
    kinds = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("dhash", pa.string()), ("signature", pa.string()), ("features", pa.list_(pa.float64())), ("broken", pa.bool_())])

    def run(values: pa.Array) -> pa.Array:
        rows: list[dict] = []
        for at in range(0, len(values), 16):  # some pictures at a time are held as pixels
            some, good = [{"broken": True} for _ in range(min(16, len(values) - at))], []
            for row, value in zip(some, values.slice(at, 16), strict=True):
                try:
                    pixels = pixels_of(value.as_py() or b"")
                except BrokenPicture:
                    continue
                good.append(pixels if most_pixels is None else capped(pixels, most_pixels))
                row["broken"] = False
            facts = picture_facts(good)
            for k, row in enumerate(r for r in some if not r["broken"]):
                row.update({name: own[k] for name, own in facts.items()})
            rows += some
        return pa.array(rows, kinds)

    run.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return files.withColumn("picture", F.arrow_udf(run, FIELDS)(content))


def tiled(files: DataFrame, side: int = 448, most: int = 6, content: str = "content") -> DataFrame:
    """(path, tile, pixels): a row for each tile of each picture that decodes, its normalised values as 32-bit floats in a binary column."""

    def run(batches):
        for batch in batches:
            for path, value in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    made = tiles(pixels_of(value.as_py() or b""), side, most).astype("<f4")
                except BrokenPicture:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * len(made), pa.string()), pa.array(range(len(made)), pa.int32()), pa.array([t.tobytes() for t in made], pa.binary())], ["path", "tile", "pixels"])

    return files.select("path", content).mapInArrow(run, "path string, tile int, pixels binary")


def picture_audit(decoded: DataFrame) -> DataFrame:
    """One row: pictures, broken, low_resolution (a side under SMALL_SIDE), duplicate hashes, median width and height."""
    p = F.col("picture")
    sizes = settled(decoded.select(p["width"].alias("w"), p["height"].alias("h")))
    medians = exact_quantiles(sizes, F.col("w"), {"median_width": 0.5}).crossJoin(exact_quantiles(sizes, F.col("h"), {"median_height": 0.5}))
    counted = decoded.agg(
        F.count("*").alias("sampled"), F.count_if(p["broken"]).alias("broken"), F.count_if(F.least(p["width"], p["height"]) < SMALL_SIDE).alias("low_resolution"),
        (F.count(p["dhash"]) - F.count_distinct(p["dhash"])).alias("duplicate_hashes"),
    )
    return counted.crossJoin(F.broadcast(medians))


def size_facts(width: Column, height: Column) -> dict[str, Column]:
    """Four numbers of a picture's size: logarithms of both sides, their ratio, whether it is small."""
    return {
        "log_width": F.log1p(width), "log_height": F.log1p(height), "aspect": width / F.greatest(height, F.lit(1)),
        "small": F.when(F.least(width, height) < SMALL_SIDE, 1.0).otherwise(0.0),
    }


def card_pictures(cards: DataFrame, decoded: DataFrame, first: int = 5, unit: bool = False) -> DataFrame:
    """(id, features, stats, present, broken): means over each card's first pictures that decode; zeros where none does. unit scales features to length 1."""
    from curatrix.functions.arrays import l2_normalise

    wanted = cards.select("id", F.explode_outer(F.slice("images", 1, first)).alias("path"))
    seen = wanted.join(decoded.select("path", "picture"), "path", "left").withColumn("ok", F.coalesce(~F.col("picture.broken"), F.lit(False)))
    good = lambda c: F.coalesce(F.avg(F.when(F.col("ok"), c)), F.lit(0.0))
    facts = size_facts(F.col("picture.width"), F.col("picture.height"))
    features = F.array(*[good(F.col("picture.features")[k]) for k in range(6 + len(QUANTILES))])
    made = seen.groupBy("id").agg(features.alias("features"), F.array(*[good(c) for c in facts.values()]).alias("stats"), F.coalesce(F.bool_or("ok"), F.lit(False)).alias("present"), F.count_if(F.col("path").isNotNull() & ~F.col("ok")).alias("broken"))
    return made.withColumn("features", l2_normalise(F.col("features"))) if unit else made
