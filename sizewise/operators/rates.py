"""Sizes of encoded images from their pixels: block transforms for lossy formats, scanline filters for lossless ones.

No encoder runs. A lossy size is the cost of the quantized coefficients of 8 x 8 blocks under the symbol model of the format, a lossless
one that of residuals of the best line filter. All values that are counted are whole numbers, so that sizes do not depend on the order of sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sizewise.operators.pixels import PIXEL_JOIN, TILE, groups_of
from sizewise.session import spread

BLOCK = 8
#: Bits of the whole-number cosines; coefficients carry them twice.
BASIS_BITS = 10
#: Zigzag positions from 1 on that share statistics: where each band ends.
BANDS = (2, 5, 9, 20)
#: Formats with a model of lossy symbols.
LOSSY_FORMATS = ("JPEG", "WEBP", "AVIF")
#: Symbol contexts: coefficients of a run-level coder, first coefficient, place of the last one, bands.
RUN_CONTEXT, DC_CONTEXT, LAST_CONTEXT, BAND_CONTEXT = 0, 1, 2, 10
END_OF_BLOCK, RUN_STEP = -1, 100_000
#: Filters of a line: none, left, above, mean of both, nearest of left, above and corner; then the best of each line.
FILTERS = ("none", "left", "above", "mean", "nearest", "adaptive")
ADAPTIVE = len(FILTERS) - 1
#: Bits that name the filter of a line, and the channel under which lines are counted.
FILTER_BITS, NAMING = 3, -1
#: Lines of an image that one task holds together.
BAND_LINES = 64
#: Places that bits are rounded to, so that the order of sums cannot move a size.
PLACES = 9


def basis() -> list[list[int]]:
    """The cosine transform of eight values, row by row, in whole numbers."""
    rows = []
    for u in range(BLOCK):
        scale = math.sqrt((1 if u == 0 else 2) / BLOCK) * (1 << BASIS_BITS)
        rows.append([round(scale * math.cos((2 * x + 1) * u * math.pi / (2 * BLOCK))) for x in range(BLOCK)])
    return rows


def zigzag() -> list[tuple[int, int]]:
    """Places (row, column) of a block along its diagonals, in turning directions."""
    cells = [(v, u) for v in range(BLOCK) for u in range(BLOCK)]
    return sorted(cells, key=lambda c: (sum(c), c[0] if sum(c) % 2 else c[1]))


def block_coefficients(pixels: DataFrame) -> DataFrame:
    """Coefficients of each 8 x 8 block and colour component (0 luma, 1 and 2 chroma): ``z``, 64 whole numbers in zigzag order, and
    ``left``, the first one of the block to the left, 0 at the edge. Places outside the image count as middle grey.

    One shuffle of the pixels by line of blocks; the blocks of a batch are transformed together.
    """
    place = [F.floor(F.col("y") / BLOCK).cast("int").alias("by"), F.floor(F.col("x") / BLOCK).cast("int").alias("bx")]
    at = (F.col("y") % BLOCK * BLOCK + F.col("x") % BLOCK).cast("int").alias("at")
    cells = pixels.select("image_id", *place, at, *[F.col(c).cast("long").alias(c) for c in ("r", "g", "b")]).repartition("image_id", "by")
    blocks = cells.groupBy("image_id", "by", "bx").agg(F.collect_list(F.struct("at", "r", "g", "b")).alias("cells"))  # 64 of a block
    schema = StructType([blocks.schema["image_id"], *StructType.fromDDL("c int, by int, bx int, z array<bigint>")])
    blocks = blocks.mapInArrow(_transformed, schema)
    before = Window.partitionBy("image_id", "c", "by").orderBy("bx")  # the blocks of one line of blocks
    return blocks.withColumn("left", F.coalesce(F.lag(F.col("z")[0]).over(before), F.lit(0)))


def _transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their ``cells`` to coefficients. A colour that is not known counts for nothing; a block without any has none.

    Sums stay below 2 ** 53, so doubles are exact.
    """
    cosines = np.array(basis(), dtype=float)
    order = [BLOCK * v + u for v, u in zigzag()]
    for batch in batches:
        n, cells = batch.num_rows, batch.column("cells")
        block = np.repeat(np.arange(n), cells.value_lengths().to_numpy(zero_copy_only=False))
        parts = [cells.flatten().field(k) for k in range(4)]
        known = np.logical_and.reduce([p.is_valid().to_numpy(zero_copy_only=False) for p in parts])
        at, r, g, b = (p.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[known] for p in parts)
        block = block[known]
        seen = np.repeat(np.bincount(block, minlength=n)[:n] > 0, BLOCK * BLOCK)
        for k, (wr, wg, wb) in enumerate(((77, 150, 29), (-43, -85, 128), (128, -107, -21))):
            value = (wr * r + wg * g + wb * b + 128) // 256 - (128 if k == 0 else 0)
            places = np.bincount(block * BLOCK * BLOCK + at, weights=value, minlength=n * BLOCK * BLOCK).reshape(n, BLOCK, BLOCK)
            z = (cosines @ places @ cosines.T).reshape(n, BLOCK * BLOCK)[:, order].astype(np.int64).reshape(-1)
            lists = pa.ListArray.from_arrays(np.arange(0, n * BLOCK * BLOCK + 1, BLOCK * BLOCK, dtype=np.int32), pa.array(z, mask=~seen))
            columns = [batch.column("image_id"), pa.array(np.full(n, k, dtype=np.int32)), batch.column("by"), batch.column("bx"), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["image_id", "c", "by", "bx", "z"])


def block_symbols(blocks: DataFrame) -> DataFrame:
    """How often quantized blocks (``image_id``, ``c``, ``z``, ``left`` and ``wants``, an array of ``format`` and ``step``) hold each symbol:
    ``image_id``, ``format``, ``step``, ``chroma``, ``context``, ``symbol``, ``n``, with several rows of a symbol where its blocks are in several batches.

    All formats code the first coefficient as a difference to the block on the left. JPEG codes runs of zeros with the level that ends
    them; WEBP the place of the last level, and levels by band; AVIF also by whether the level before is zero.
    """
    want = blocks.schema["wants"].dataType.elementType
    schema = StructType([blocks.schema["image_id"], want["format"], want["step"],
                         *StructType.fromDDL("chroma boolean, context int, symbol bigint, n bigint")])
    return blocks.select("image_id", "c", "z", "left", "wants").mapInArrow(_counted, schema)


#: Symbols take this many places of a key, contexts that many; the last place is for a symbol that is not known.
_SYMBOLS, _CONTEXTS = 1 << 28, 32
_UNKNOWN = _SYMBOLS // 2 - 1


def _keys(groups: np.ndarray, context: np.ndarray | int, symbols: np.ndarray | int) -> np.ndarray:
    return (groups * _CONTEXTS + context) * _SYMBOLS + symbols + _SYMBOLS // 2


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The symbols of a batch of blocks, counted by image and what is wanted of it."""
    for batch in batches:
        if not batch.num_rows:
            continue
        coded = batch.column("image_id").dictionary_encode()
        image = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        z = batch.column("z").flatten()
        known = z.is_valid().to_numpy(zero_copy_only=False).reshape(-1, BLOCK * BLOCK)[:, 0]
        z = z.fill_null(0).to_numpy(zero_copy_only=False).reshape(-1, BLOCK * BLOCK)
        left = batch.column("left").to_numpy(zero_copy_only=False)
        group = image * 2 + (batch.column("c").to_numpy(zero_copy_only=False) > 0)
        # What is wanted is the same for all blocks of an image; rows that come twice count twice.
        times: dict[tuple, np.ndarray] = {}
        for code, row in zip(*np.unique(image, return_index=True), strict=True):
            for want in batch.column("wants")[int(row)].as_py():
                times.setdefault((want["step"], want["format"]), np.zeros(len(coded.dictionary), dtype=np.int64))[code] += 1
        for step in {s for s, _ in times}:
            formats = [f for s, f in times if s == step]
            used = np.logical_or.reduce([times[step, f] > 0 for f in formats])[image]
            found = _symbols_of(z[used], left[used], known[used], group[used], step, formats)
            for fmt, keys in found.items():
                keys, n = np.unique(keys, return_counts=True)
                symbols, rest = keys % _SYMBOLS - _SYMBOLS // 2, keys // _SYMBOLS
                context, of = rest % _CONTEXTS, rest // _CONTEXTS
                n = n * times[step, fmt][of // 2]
                kept = n > 0
                rows = int(kept.sum())
                yield pa.RecordBatch.from_arrays(
                    [coded.dictionary.take(pa.array(of[kept] // 2)), pa.array([fmt] * rows, pa.string()), pa.array([step] * rows, pa.int32()),
                     pa.array(of[kept] % 2 == 1), pa.array(context[kept].astype(np.int32)),
                     pa.array(symbols[kept], mask=symbols[kept] == _UNKNOWN), pa.array(n[kept])],
                    names=["image_id", "format", "step", "chroma", "context", "symbol", "n"])


def _levels(coefficients: np.ndarray, step: int | None) -> np.ndarray:
    """The nearest multiples of the step, halves away from zero; 0 without a step."""
    if step is None:
        return np.zeros_like(coefficients)
    unit = step << (2 * BASIS_BITS)
    return (np.sign(coefficients) * np.floor((np.abs(coefficients) + unit // 2) / unit)).astype(np.int64)


def _symbols_of(z: np.ndarray, left: np.ndarray, known: np.ndarray, group: np.ndarray, step: int | None, formats: list[str]) -> dict[str, np.ndarray]:
    """Keys of the symbols that blocks are coded with, by format."""
    levels = _levels(z, step)
    first = np.where(known & (step is not None), levels[:, 0] - _levels(left, step), _UNKNOWN)
    firsts = _keys(group, DC_CONTEXT, first)
    nonzero = levels[:, 1:] != 0
    found = {}
    if "JPEG" in formats:
        row, place = np.nonzero(nonzero)
        place += 1
        before = np.zeros_like(place)
        before[1:] = np.where(row[1:] == row[:-1], place[:-1], 0)
        runs = (place - before - 1) * RUN_STEP + levels[row, place] + RUN_STEP // 2
        found["JPEG"] = np.concatenate([firsts, _keys(group[row], RUN_CONTEXT, runs), _keys(group, RUN_CONTEXT, END_OF_BLOCK)])
    if set(formats) - {"JPEG"}:
        last = np.where(nonzero.any(axis=1), BLOCK * BLOCK - 1 - np.argmax(nonzero[:, ::-1], axis=1), 0)
        lasts = _keys(group, LAST_CONTEXT, last)
        row, place = np.nonzero(np.arange(1, BLOCK * BLOCK) <= last[:, None])
        place += 1
        context = BAND_CONTEXT + 2 * np.searchsorted(BANDS, place)  # bands that end before the place
        after = (place > 1) & (levels[row, place - 1] != 0)
        for fmt in set(formats) - {"JPEG"}:
            found[fmt] = np.concatenate([firsts, lasts, _keys(group[row], context + (after if fmt == "AVIF" else 0), levels[row, place])])
    return found


def coded_bits(symbols: DataFrame, keys: list[str], contexts: list[str], symbol: str = "symbol") -> DataFrame:
    """Bits that counted symbols (``n``) take by their own frequencies in each context, with half a logarithm per further symbol for telling
    the frequencies: N log N - sum(n log n) + (K - 1) / 2 log N for N symbols of K kinds."""
    counts = symbols.groupBy(*keys, *contexts, symbol).agg(F.sum("n").alias("n"))
    per_context = counts.groupBy(*keys, *contexts).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.log2("n")).alias("w"), F.count(F.lit(1)).alias("k"))
    n = F.col("n").cast("double")
    bits = F.sum(n * F.log2(n) - F.col("w") + (F.col("k") - 1) / 2.0 * F.log2(n))
    return per_context.groupBy(*keys).agg(F.round(F.greatest(bits, F.lit(0.0)), PLACES).alias("bits"))


def lossy_bits(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Bits of images in lossy formats at quantization steps: ``wanted`` has ``image_id``, ``format``, ``step``."""
    wanted = wanted.where(F.col("format").isin(*LOSSY_FORMATS)).select("image_id", "format", F.col("step").cast("int").alias("step"))
    wants = wanted.groupBy("image_id").agg(F.collect_list(F.struct("format", "step")).alias("wants"))
    # Rows of an image follow one another after a merge join, so most of its symbols are counted in one batch.
    symbols = block_symbols(blocks.join(wants.hint(PIXEL_JOIN), "image_id"))
    return coded_bits(symbols, ["image_id", "format", "step"], ["chroma", "context"])


def _neighbours(pixels: DataFrame, channels: tuple[str, ...]) -> DataFrame:
    """Each pixel with those to the left, above and at the corner between as arrays of channels; 0 outside the image."""
    values = F.array(*[F.col(c).cast("int") for c in channels])
    tile = F.floor(F.col("x") / TILE).cast("int")
    tiles = F.when(F.col("x") % TILE == TILE - 1, F.array(tile, tile + 1)).otherwise(F.array(tile))
    rows = pixels.select("image_id", "y", "x", values.alias("v"), F.explode(tiles).alias("tile"))
    line = Window.partitionBy("image_id", "y", "tile").orderBy("x")  # a tile of a line at most
    inside = F.floor(F.col("x") / TILE) == F.col("tile")
    lines = rows.withColumn("left", F.lag("v").over(line)).where(inside).drop("tile")
    above = lines.select("image_id", (F.col("y") + 1).alias("y"), "x", F.col("v").alias("above"), F.col("left").alias("corner"))
    zero = F.array(*[F.lit(0) for _ in channels])
    return lines.join(above.hint(PIXEL_JOIN), ["image_id", "y", "x"], "left").select(
        "image_id", "y", "x", "v", *[F.coalesce(c, zero).alias(c) for c in ("left", "above", "corner")])


def _residuals(v: Column, left: Column, above: Column, corner: Column) -> list[Column]:
    """What each filter leaves of one channel, from 0 to 255."""
    guess = left + above - corner
    off_left, off_above, off_corner = (F.abs(guess - p) for p in (left, above, corner))
    nearest = F.when((off_left <= off_above) & (off_left <= off_corner), left).when(off_above <= off_corner, above).otherwise(corner)
    predicted = (F.lit(0), left, above, F.floor((left + above) / 2.0).cast("int"), nearest)
    return [F.pmod(v - p, F.lit(256)).cast("int") for p in predicted]


def line_residuals(pixels: DataFrame, channels: tuple[str, ...] = ("r", "g", "b", "a")) -> DataFrame:
    """Residuals of every pixel under each filter: ``r<filter>_<channel>`` from 0 to 255.

    Pixels are dealt by bands of lines, so that a line lies in one task and most residuals of an image meet before they are shuffled.
    """
    rows = _neighbours(pixels, channels).withColumn("band", F.floor(F.col("y") / BAND_LINES)).where("image_id IS NOT NULL").repartition("image_id", "band")
    parts = [_residuals(*(F.col(n)[k] for n in ("v", "left", "above", "corner"))) for k in range(len(channels))]
    return rows.select("image_id", "band", "y", "x", *[r.alias(f"r{f}_{k}") for k, of in enumerate(parts) for f, r in enumerate(of)])


def scanline_sweep(pixels: DataFrame, channels: tuple[str, ...] = ("r", "g", "b", "a")) -> DataFrame:
    """Bits of each image under each filter of ``FILTERS``; ``adaptive`` takes in each line the filter with the least sum of absolute
    residuals, the first of several, and pays for naming it.

    A line is a window of its pixels; its filter is chosen there, and every pixel counts once under each filter. Residuals are counted
    inside a task before the only shuffle of counts.
    """
    residuals = line_residuals(pixels, channels)
    line = ["image_id", "band", "y"]
    along = Window.partitionBy(*line)

    def cost(f: int) -> Column:
        sizes = [F.coalesce(F.least(r, 256 - r), F.lit(0)) for r in (F.col(f"r{f}_{k}") for k in range(len(channels)))]
        known = sum(F.col(f"r{f}_{k}").isNotNull().cast("int") for k in range(len(channels)))
        return F.when(known > 0, sum(sizes))

    # The first pixel of a line also counts the line.
    numbered = residuals.withColumn("head", F.row_number().over(along.orderBy("x")) == 1)
    costs = numbered.withColumns({f"cost{f}": cost(f) for f in range(ADAPTIVE)})
    costs = costs.withColumns({f"cost{f}": F.sum(f"cost{f}").over(along) for f in range(ADAPTIVE)})
    first = F.least(*[F.struct(F.col(f"cost{f}").alias("cost"), F.lit(f).alias("filter")) for f in range(ADAPTIVE)])["filter"]
    chosen = costs.withColumn("chosen", first)
    of_chosen = [F.coalesce(*[F.when(F.col("chosen") == f, F.col(f"r{f}_{k}")) for f in range(ADAPTIVE)]) for k in range(len(channels))]

    def entry(f: int, k: int, residual: Column) -> Column:
        return F.struct(F.lit(f).alias("filter"), F.lit(k).alias("channel"), residual.alias("residual"))

    entries = [entry(f, k, F.col(f"r{f}_{k}")) for f in range(ADAPTIVE) for k in range(len(channels))]
    entries += [F.when(F.col("y").isNotNull(), entry(ADAPTIVE, k, r)) for k, r in enumerate(of_chosen)]
    entries += [F.when(F.col("head"), entry(ADAPTIVE, NAMING, F.lit(0)))]
    counts = chosen.select("image_id", F.explode(F.array(*entries)).alias("_r")).where("_r IS NOT NULL").groupBy(
        "image_id", "_r.filter", "_r.channel", "_r.residual").agg(F.count(F.lit(1)).alias("n"))
    return _bits_of_counts(counts, ["image_id"])


def _bits_of_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Bits by filter of counted residuals (``filter``, ``channel``, ``residual``, ``n``)."""
    channel_bits = counts.groupBy(*keys, "filter", "channel").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.log2("n")).alias("w"), F.count(F.lit(1)).alias("k"))
    n = F.col("n").cast("double")
    total = F.sum(F.when(F.col("channel") == NAMING, 0.0).otherwise(n * F.log2(n) - F.col("w") + (F.col("k") - 1) / 2.0 * F.log2(n)))
    naming = F.sum(F.when(F.col("channel") == NAMING, F.col("n") * FILTER_BITS).otherwise(0))
    bits = channel_bits.groupBy(*keys, "filter").agg(total.alias("bits"), naming.alias("naming"))
    paid = F.col("bits") + F.col("naming")
    return bits.select(*keys, "filter", F.round(F.greatest(paid, F.lit(0.0)), PLACES).alias("bits"))


def without_green(pixels: DataFrame) -> DataFrame:
    """Red and blue as differences to green, as one lossless format codes them."""
    return pixels.select("image_id", "x", "y", *[F.pmod(F.col(c) - F.col("g"), F.lit(256)).cast("int").alias(c) for c in ("r", "b")], "g", "a")


#: Lossless formats with the channels that each codes, in order: a pair is the difference of two.
LOSSLESS_CHANNELS = {"PNG": (0, 1, 2, 3), "WEBP": ((0, 1), 1, (2, 1), 3)}


def line_bands(pixels: DataFrame) -> DataFrame:
    """Pixels packed by bands of BAND_LINES lines: ``image_id``, ``band``, ``n`` pixels in the order of lines and columns, ``packed``, and the same of
    the last line alone as ``n_last`` and ``last``. One shuffle of the pixels. Pixels without a column are left out, those without a line have a band of their own."""
    rows = pixels.where("image_id IS NOT NULL AND x IS NOT NULL").select(
        "image_id", F.floor(F.col("y") / BAND_LINES).cast("long").alias("band"), *[F.col(c).cast("int").alias(c) for c in ("y", "x", "r", "g", "b", "a")])
    dealt = rows.repartition("image_id", "band").sortWithinPartitions("image_id", "band", "y", "x")
    schema = StructType([rows.schema["image_id"], *StructType.fromDDL("band long, n long, packed binary, n_last long, last binary")])
    return dealt.mapInArrow(_packed_bands, schema)


def _packed_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in groups_of(batches, ["image_id", "band"]):
        columns = [rows.column(c).combine_chunks() for c in ("y", "x", "r", "g", "b", "a")]
        known = sum(c.is_valid().to_numpy(zero_copy_only=False).astype(np.int32) << k for k, c in enumerate(columns))
        body = np.stack([*[c.fill_null(0).to_numpy(zero_copy_only=False).astype("<i4") for c in columns], known.astype("<i4")])
        first = rows.slice(0, 1)
        band = first.column("band")[0].as_py()
        last = body[:, (body[0] == (band + 1) * BAND_LINES - 1)] if band is not None else body[:, :0]
        yield pa.RecordBatch.from_arrays(
            [*[first.column(c).combine_chunks() for c in ("image_id", "band")], pa.array([len(rows)], pa.int64()),
             pa.array([pa.compress(body.tobytes(), codec="zstd", asbytes=True)], pa.binary()), pa.array([last.shape[1]], pa.int64()),
             pa.array([pa.compress(last.tobytes(), codec="zstd", asbytes=True)], pa.binary())],
            names=["image_id", "band", "n", "packed", "n_last", "last"])


def _pixels_of(packed: pa.Scalar, n: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Lines, columns and four channels of packed pixels, and which of the six are known."""
    if not n:
        return np.zeros((6, 0), np.int64), np.zeros((6, 0), dtype=bool)
    rows = np.frombuffer(pa.decompress(packed.as_buffer(), 28 * n, codec="zstd"), "<i4").reshape(7, n).astype(np.int64)
    return rows[:6], (rows[6] >> np.arange(6)[:, None]) & 1 > 0


def _residual_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each residual is left in a band, by format, filter and channel, as ``scanline_sweep`` counts them."""
    for batch in batches:
        for i in range(batch.num_rows):
            own = _pixels_of(batch.column("packed")[i], batch.column("n")[i].as_py())
            above = _pixels_of(batch.column("above")[i], batch.column("n_above")[i].as_py())
            for fmt, channels in LOSSLESS_CHANNELS.items():
                found = _counts_of_band(_coded(own, channels), _coded(above, channels))
                rows = len(found[0])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("image_id").take(pa.array(np.full(rows, i))), pa.array([fmt] * rows, pa.string()),
                     *[pa.array(f.astype(np.int32)) for f in found[:2]], pa.array(found[2].astype(np.int32), mask=found[2] < 0), pa.array(found[3])],
                    names=["image_id", "format", "filter", "channel", "residual", "n"])


def _coded(pixels: tuple[np.ndarray, np.ndarray], channels: tuple) -> tuple[np.ndarray, ...]:
    """Line and column, whether there is a line, and the channels of a format with which of them are known."""
    (y, x, *values), known = pixels
    pick = [(values[c], known[2 + c]) if isinstance(c, int) else ((values[c[0]] - values[c[1]]) % 256, known[2 + c[0]] & known[2 + c[1]]) for c in channels]
    return y, x, known[0], np.stack([np.where(k, v, 0) for v, k in pick]), np.stack([k for _, k in pick])


def _left_of(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where the pixel to the left of each stands, -1 without one. Pixels are in order; those of other tiles count if they are the next column."""
    out = np.arange(len(y)) - 1
    if len(y):
        near = (y[1:] == y[:-1]) & ((x[1:] // TILE == x[:-1] // TILE) | ((x[:-1] % TILE == TILE - 1) & (x[:-1] // TILE + 1 == x[1:] // TILE)))
        out[1:][~near] = -1
    return out


def _counts_of_band(own: tuple[np.ndarray, ...], above: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    y, x, placed, value, known = own

    def beside(rows: tuple[np.ndarray, ...], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Channels at places; without a place they are 0 and known."""
        none = at < 0
        return np.where(none, 0, rows[3][:, at]), none | rows[4][:, at]

    # Pixels that can stand above one: those of the band itself and of the last line of the band before.
    y0, x0, _, value0, known0 = above
    every = (np.concatenate([y0, y]), np.concatenate([x0, x]), None, np.concatenate([value0, value], axis=1), np.concatenate([known0, known], axis=1))
    own_left = _left_of(y, x)
    own_left = np.where(own_left < 0, -1, own_left + len(y0))
    left_of = np.concatenate([_left_of(y0, x0), own_left])
    low = min(int(every[1].min(initial=0)), 0)
    width = int(every[1].max(initial=0)) - low + 2
    place = every[0] * width + every[1] - low
    place = np.where(np.concatenate([np.ones(len(y0), dtype=bool), placed]), place, np.iinfo(np.int64).max)  # no line is above or below those without one
    begin, end = (np.searchsorted(place, (y - 1) * width + x - low, side=side) for side in ("left", "right"))
    begin, end = np.where(placed, begin, 0), np.where(placed, end, 0)
    times = np.maximum(end - begin, 1)  # a pixel that is given several times counts as often
    row = np.repeat(np.arange(len(y)), times)
    over = np.where(end > begin, begin, -1)[row] + np.arange(len(row)) - np.repeat(times.cumsum() - times, times)
    over = np.where((end > begin)[row], over, -1)
    corner_at = np.where(over >= 0, left_of[over], -1)

    v, v_known = value[:, row], known[:, row]
    left, left_known = beside(every, own_left[row])
    up, up_known = beside(every, over)
    corner, corner_known = beside(every, corner_at)
    guess = left + up - corner
    off_left, off_up, off_corner = (np.abs(guess - p) for p in (left, up, corner))
    nearest = np.where((off_left <= off_up) & (off_left <= off_corner), left, np.where(off_up <= off_corner, up, corner))
    all_known = left_known & up_known & corner_known
    # Unknown neighbours make comparisons of the nearest unknown, which then fall through to the corner.
    nearest = np.where(all_known, nearest, corner)
    predicted = [(np.zeros_like(v), v_known), (left, v_known & left_known), (up, v_known & up_known),
                 ((left + up) // 2, v_known & left_known & up_known), (nearest, v_known & corner_known)]
    residuals = [((v - p) % 256, k) for p, k in predicted]
    # The filter of each line: the least sum, the first of several; without any residual a filter has no sum, which comes first.
    line_key = np.where(placed, y, np.iinfo(np.int64).min)[row]
    new = np.concatenate([[True], line_key[1:] != line_key[:-1]]) if len(row) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    line = new.cumsum() - 1
    costs = np.zeros((ADAPTIVE, len(head)), np.int64)
    for f, (r, k) in enumerate(residuals):
        cost = np.where(k, np.minimum(r, 256 - r), 0).sum(axis=0)
        some = k.any(axis=0)
        if len(head):
            costs[f] = np.add.reduceat(cost, head)
            costs[f] = np.where(np.add.reduceat(some.astype(np.int64), head) > 0, costs[f], -1)
    chosen = np.argmin(costs, axis=0)[line] if len(head) else np.zeros(0, np.int64)

    filters, channels, values, counts = [], [], [], []

    def add(f: int, k: int, r: np.ndarray, there: np.ndarray) -> None:
        """A residual that is not known is a symbol of its own."""
        n = np.bincount(np.where(there, r, 256), minlength=257)
        found = np.flatnonzero(n)
        filters.append(np.full(len(found), f))
        channels.append(np.full(len(found), k))
        values.append(np.where(found == 256, -1, found))
        counts.append(n[found])

    lined = placed[row]
    for k in range(len(value)):
        for f, (r, there) in enumerate(residuals):
            add(f, k, r[k], there[k])
        best = np.choose(chosen, [r[k] for r, _ in residuals])[lined]
        add(ADAPTIVE, k, best, np.choose(chosen, [there[k] for _, there in residuals])[lined])
    add(ADAPTIVE, NAMING, np.zeros(len(head), np.int64), np.ones(len(head), dtype=bool))
    return tuple(np.concatenate(c) for c in (filters, channels, values, counts))


def lossless_bits(pixels: DataFrame) -> DataFrame:
    """Bits of each image as PNG and as lossless WEBP, with the filter that gives them (the first of several).

    As the least of ``scanline_sweep`` over the filters of both formats, but pixels are shuffled once for all of them, and packed bands of lines
    meet the last line of the band above. Only counts of residuals leave a task.
    """
    bands = line_bands(pixels)
    ends = bands.select("image_id", (F.col("band") + 1).alias("band"), F.col("n_last").alias("n_above"), F.col("last").alias("above"))
    rows = bands.drop("n_last", "last").join(ends.hint(PIXEL_JOIN), ["image_id", "band"], "left")
    schema = StructType([rows.schema["image_id"], *StructType.fromDDL("format string, filter int, channel int, residual int, n long")])
    keys = ["image_id", "format"]
    counts = spread(rows, "image_id", "band").mapInArrow(_residual_counts, schema).groupBy(*keys, "filter", "channel", "residual").agg(F.sum("n").alias("n"))
    best = _bits_of_counts(counts, keys).groupBy(*keys).agg(F.min(F.struct("bits", "filter")).alias("m"))
    return best.select("image_id", "format", F.col("m.bits").alias("bits"), F.col("m.filter").alias("filter"))
