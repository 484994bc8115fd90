"""Statistics over pixel tables (image_id, x, y, r, g, b, a)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds on luma and on the summed channel difference of neighbours, the length of a flat run in
# pairs, histogram layout, guard and preview size.
DARK_LUMA, BRIGHT_LUMA = 30.0, 225.0
FLAT_DIFFERENCE, EDGE_DIFFERENCE = 24, 120
FLAT_RUN_PAIRS = 4
LUMA_BINS, LUMA_BIN_WIDTH = 32, 8
MAX_PIXELS = 50_000_000
PREVIEW_SIDE = 256

# The planner does not see how many pixels an array of them makes, and takes a pixel table for a small one. Joins of pixels and of what
# is counted in them name this method, so that no driver ever holds them.
PIXEL_JOIN = "merge"

# A row of pixels is cut into tiles of this many columns; the window over a tile never grows with the image.
TILE = 1024


def luma(r: Column | None = None, g: Column | None = None, b: Column | None = None) -> Column:
    r, g, b = (F.col(n) if c is None else c for n, c in (("r", r), ("g", g), ("b", b)))
    return F.lit(0.299) * r + F.lit(0.587) * g + F.lit(0.114) * b


def saturation() -> Column:
    top, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    return F.when(top > 0, (top - low) / top).otherwise(F.lit(0.0))


def pixel_stats(pixels: DataFrame) -> DataFrame:
    """Luma, contrast, saturation, dark and bright shares, alpha and grey flags: one aggregate per image."""
    y = F.col("_luma")
    return (
        pixels.withColumn("_luma", luma())
        .groupBy("image_id")
        .agg(
            F.count(F.lit(1)).alias("n_pixels"),
            F.avg(y).alias("mean_luma"),
            F.least(F.stddev_pop(y), F.lit(255.0)).alias("contrast"),
            F.avg(saturation()).alias("mean_saturation"),
            F.avg((y < DARK_LUMA).cast("int")).alias("dark_region_ratio"),
            F.avg((y > BRIGHT_LUMA).cast("int")).alias("bright_region_ratio"),
            F.bool_or(F.col("a") < 255).alias("has_alpha"),
            F.bool_or(F.col("a").between(1, 254)).alias("soft_alpha"),
            F.bool_and((F.col("r") == F.col("g")) & (F.col("g") == F.col("b"))).alias("is_gray"),
        )
    )


def luma_histogram(pixels: DataFrame) -> DataFrame:
    """Pixels per image and luma bin, in long form."""
    bin_no = F.least(F.floor(luma() / LUMA_BIN_WIDTH), F.lit(LUMA_BINS - 1)).cast("int")
    return pixels.groupBy("image_id", bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_arrays(histogram: DataFrame) -> DataFrame:
    """The histogram as one array of 32 counts per image; at most 32 values meet in a group."""
    filled = F.transform(
        F.sequence(F.lit(0), F.lit(LUMA_BINS - 1)), lambda i: F.coalesce(F.try_element_at(F.col("_m"), i), F.lit(0))
    )
    return (
        histogram.groupBy("image_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_m"))
        .select("image_id", filled.alias("luma_bins"))
    )


def _tiled_pairs(pixels: DataFrame) -> DataFrame:
    """Difference of each pixel and its right neighbour, by (image, row, tile).

    The first pixel of a tile is also given to the tile before it, as the neighbour of that tile's last pixel.
    """
    tile = F.floor(F.col("x") / TILE).cast("int")
    tiles = F.when((F.col("x") % TILE == 0) & (F.col("x") > 0), F.array(tile, tile - 1)).otherwise(F.array(tile))
    rows = pixels.select("image_id", "y", "x", "r", "g", "b", "a", F.explode(tiles).alias("tile"))
    right = Window.partitionBy("image_id", "y", "tile").orderBy("x")
    difference = sum(F.abs(F.lead(c).over(right) - F.col(c)) for c in ("r", "g", "b", "a"))
    inside = F.floor(F.col("x") / TILE) == F.col("tile")
    return rows.withColumn("d", difference).where(F.col("d").isNotNull() & inside)


def neighbour_stats(pixels: DataFrame) -> DataFrame:
    """Complexity, edge density and the number of flat runs per image, from one shuffle of the pixels.

    A flat run is a stretch of at least four neighbour pairs that hardly differ. Runs continue from the end of a
    row into the next row. Each tile is first reduced to its inner runs and its flat ends; runs that cross tiles
    are put together from the ends.
    """
    pairs = _tiled_pairs(pixels)
    tile_key = ["image_id", "y", "tile"]
    flat = F.col("d") < FLAT_DIFFERENCE
    order = Window.partitionBy(*tile_key).orderBy("x")
    breaks = F.sum((~flat).cast("int")).over(order)  # number of breaks up to here: the id of the current run
    runs = pairs.withColumn("_run", breaks).groupBy(*tile_key, "_run").agg(
        F.sum("d").alias("_d"),
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("d") > EDGE_DIFFERENCE).alias("_edges"),
        F.count_if(flat).alias("_flat"),
    )
    # Run 0 precedes the first break of the tile and the last run follows its last break.
    last = F.max("_run").over(Window.partitionBy(*tile_key))
    inner = (F.col("_run") > 0) & (F.col("_run") < F.col("_last")) & (F.col("_flat") >= FLAT_RUN_PAIRS)
    tiles = runs.withColumn("_last", last).groupBy(*tile_key).agg(
        F.sum("_d").alias("_d"),
        F.sum("_n").alias("_n"),
        F.sum("_edges").alias("_edges"),
        F.count_if(inner).alias("_inner"),
        F.max("_last").alias("_breaks"),
        F.sum(F.when(F.col("_run") == 0, F.col("_flat")).otherwise(0)).alias("_head"),
        F.sum(F.when((F.col("_run") == F.col("_last")) & (F.col("_run") > 0), F.col("_flat")).otherwise(0)).alias(
            "_tail"
        ),
    )
    broken = F.col("_breaks") > 0
    sequence = Window.partitionBy("image_id").orderBy("y", "tile")
    before = F.sum(broken.cast("int")).over(sequence.rowsBetween(Window.unboundedPreceding, -1))
    numbered = tiles.withColumn("_group", F.coalesce(before, F.lit(0)))
    # The head of a tile belongs to the run open before it, its tail opens the next one.
    ends = F.when(
        broken,
        F.array(
            F.struct(F.col("_group").alias("g"), F.col("_head").alias("n")),
            F.struct((F.col("_group") + 1).alias("g"), F.col("_tail").alias("n")),
        ),
    ).otherwise(F.array(F.struct(F.col("_group").alias("g"), F.col("_head").alias("n"))))
    crossing = (
        numbered.select("image_id", F.explode(ends).alias("_e"))
        .groupBy("image_id", F.col("_e.g").alias("_g"))
        .agg(F.sum("_e.n").alias("_len"))
        .groupBy("image_id")
        .agg(F.count_if(F.col("_len") >= FLAT_RUN_PAIRS).alias("_crossing"))
    )
    totals = tiles.groupBy("image_id").agg(
        F.sum("_d").alias("_d"), F.sum("_n").alias("_n"), F.sum("_edges").alias("_edges"), F.sum("_inner").alias("_inner")
    )
    complexity = F.least(F.col("_d") / F.col("_n") / 1020.0, F.lit(1.0))
    return totals.join(crossing, "image_id").select(
        "image_id",
        F.col("_n").alias("n_pairs"),
        complexity.alias("complexity"),
        (1.0 - complexity).alias("compressibility"),
        (F.col("_edges") / F.col("_n")).alias("edge_density"),
        (F.col("_inner") + F.col("_crossing")).alias("flat_run_count"),
    )


def preview(pixels: DataFrame, sizes: DataFrame, side: int = PREVIEW_SIDE) -> DataFrame:
    """Nearest-neighbour reduction so that neither side exceeds ``side``; smaller images stay as they are.

    Target column i shows source column floor((i + 0.5) * width / target_width). A source pixel is kept when it is
    the centre of a target pixel, so this is a filter and a renumbering, without generating coordinates.
    ``sizes`` has one row per image (image_id, width, height).
    """
    scale = F.least(F.lit(1.0), side / F.greatest("width", "height"))
    targets = sizes.select(
        "image_id",
        F.col("width").alias("_w"),
        F.col("height").alias("_h"),
        F.greatest(F.round(F.col("width") * scale), F.lit(1.0)).alias("_tw"),
        F.greatest(F.round(F.col("height") * scale), F.lit(1.0)).alias("_th"),
    )

    def target(position: str, full: str, small: str) -> Column:
        guess = F.ceil(F.col(position) * F.col(small) / F.col(full) - 0.5)
        shown = F.floor((guess + 0.5) * F.col(full) / F.col(small)) == F.col(position)
        return F.when(shown, guess.cast("int"))

    return (
        pixels.join(targets.hint(PIXEL_JOIN), "image_id")
        .withColumn("_x", target("x", "_w", "_tw"))
        .withColumn("_y", target("y", "_h", "_th"))
        .where("_x IS NOT NULL AND _y IS NOT NULL")
        .select("image_id", F.col("_x").alias("x"), F.col("_y").alias("y"), "r", "g", "b", "a")
    )


def premultiplied(c: str) -> Column:
    """Channel weighted by its alpha, rounded to whole values."""
    return F.round(F.col(c) * F.col("a") / 255.0).cast("int")


def over_white(c: str) -> Column:
    """Channel as seen on a white page, rounded to whole values."""
    return F.round((F.col(c) * F.col("a") + 255 * (255 - F.col("a"))) / 255.0).cast("int")


def groups_of(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Rows that follow one another and agree in ``names``, nulls included, whole."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = [batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for c in names]
        cuts = [0, *(np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in codes])) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            key = tuple(batch.column(c)[lo].as_py() for c in names)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)
