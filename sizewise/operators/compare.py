"""Pictures against their quantized copies, tile by tile: error, block similarity and perceptual damage of many steps at once.

The measures are those of ``sweep.mse_of_histogram``, ``quality.ssim_block`` and ``quality.perceptual_damage``. Pixels are dealt and packed
once; each step is then some array work on the tiles, and no row is made per pixel and step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sizewise.operators.pixels import PIXEL_JOIN, TILE, groups_of
from sizewise.operators.quality import BLOCK, C1, C2, DAMAGE_RANGE, SCALES, psnr
from sizewise.session import spread

#: Lines of a tile: blocks of every scale lie inside one.
LINES = BLOCK << (SCALES - 1)
#: Pixels whose steps are worked on together, about.
PIECE = 1 << 17
_CHANNELS = ("r", "g", "b", "a")
_SUMS = ["pixels long", "error double", "similar double", "blocks long", *[f"{n}{s} {t}" for s in range(SCALES) for n, t in (("s", "double"), ("n", "long"))]]


def pixel_tiles(pixels: DataFrame) -> DataFrame:
    """Pixels packed by tiles of LINES lines and TILE columns: ``image_id``, ``ty``, ``tx``, ``n`` pixels, ``packed``. One shuffle of the pixels."""
    cell = [F.floor(F.col("y") / LINES).cast("long").alias("ty"), F.floor(F.col("x") / TILE).cast("long").alias("tx")]
    rows = pixels.where("image_id IS NOT NULL").select(
        "image_id", *cell, *[F.coalesce(F.col(c) - F.floor(F.col(c) / side) * side, F.lit(0)).cast("int").alias(c) for c, side in (("y", LINES), ("x", TILE))],
        *[F.col(c).cast("int").alias(c) for c in _CHANNELS])
    dealt = rows.repartition("image_id", "ty").sortWithinPartitions("image_id", "ty", "tx")
    schema = StructType([rows.schema["image_id"], *StructType.fromDDL("ty long, tx long, n long, packed binary")])
    return dealt.mapInArrow(_packed, schema)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in groups_of(batches, ["image_id", "ty", "tx"]):
        columns = [rows.column(c).combine_chunks() for c in ("y", "x", *_CHANNELS)]
        known = sum(c.is_valid().to_numpy(zero_copy_only=False).astype(np.int32) << k for k, c in enumerate(columns))
        body = np.stack([*[c.fill_null(0).to_numpy(zero_copy_only=False).astype("<i4") for c in columns], known.astype("<i4")]).tobytes()
        first = rows.slice(0, 1)
        yield pa.RecordBatch.from_arrays(
            [*[first.column(c).combine_chunks() for c in ("image_id", "ty", "tx")], pa.array([len(rows)], pa.int64()),
             pa.array([pa.compress(body, codec="zstd", asbytes=True)], pa.binary())], names=["image_id", "ty", "tx", "n", "packed"])


def compare_steps(tiles: DataFrame, wanted: DataFrame) -> DataFrame:
    """``mse``, ``psnr``, ``ssim`` and ``damage`` of each distinct (image_id, step) of ``wanted`` whose image has tiles.

    ``ssim`` is null without a whole block. Colours that are not known count for nothing.
    """
    steps = wanted.where("step IS NOT NULL").groupBy("image_id").agg(F.collect_set(F.col("step").cast("int")).alias("steps"))
    schema = StructType([tiles.schema["image_id"], *StructType.fromDDL(", ".join(["step int", *_SUMS]))])
    sums = spread(tiles.join(steps.hint(PIXEL_JOIN), "image_id"), "image_id", "ty", "tx").mapInArrow(_compared, schema)
    sums = sums.groupBy("image_id", "step").agg(*[F.sum(c.split()[0]).alias(c.split()[0]) for c in _SUMS])
    mse = (F.col("error") / (4 * F.col("pixels"))).alias("mse")
    scales = [F.try_divide(F.col(f"s{s}"), F.col(f"n{s}")) for s in range(SCALES)]
    there = sum(s.isNotNull().cast("int") for s in scales)
    damage = F.round(DAMAGE_RANGE * (1.0 - F.try_divide(sum(F.coalesce(s, F.lit(0.0)) for s in scales), there)), 9)
    rows = sums.select("image_id", "step", mse, F.try_divide(F.col("similar"), F.col("blocks")).alias("ssim"), damage.alias("damage"))
    return rows.select("image_id", "step", "mse", psnr(F.col("mse")).alias("psnr"), "ssim", "damage")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # Tiles with the same steps together, since a piece takes all steps of its tiles.
        steps = [sorted(x) for x in batch.column("steps").to_pylist()]
        batch = batch.take(pa.array(sorted(range(batch.num_rows), key=steps.__getitem__), pa.int64()))
        sizes = batch.column("n").to_numpy().cumsum()
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + PIECE, side="right")))
            yield _piece(batch.slice(lo, hi - lo))
            lo = hi


def _whole(values: np.ndarray) -> np.ndarray:
    """The nearest whole numbers, halves away from zero."""
    return np.sign(values) * np.floor(np.abs(values) + 0.5)


def _sums(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(of, weights=values, minlength=n)


class _Scale:
    """Elements of one scale with the block that each lies in, and what the originals give; blocks are numbered tile by tile.

    ``known`` tells whose original has a luma; a copy may have one without.
    """

    def __init__(self, tile: np.ndarray, y: np.ndarray, x: np.ndarray, luma: np.ndarray, known: np.ndarray, lines: int, columns: int, tiles: int):
        down, across = -(-lines // BLOCK), -(-columns // BLOCK)
        self.block, self.blocks = (tile * down + y // BLOCK) * across + x // BLOCK, tiles * down * across
        self.known = slice(None) if known.all() else known
        self.copies = np.maximum(np.bincount(self.block, minlength=self.blocks), 1)
        self.own = self.block[self.known]
        n = np.bincount(self.own, minlength=self.blocks)
        self.there, self.n = n > 0, np.maximum(n, 1)
        self.mean = _sums(luma[self.known], self.own, self.blocks) / self.n
        self.off = luma[self.known] - self.mean[self.own]
        self.spread = _sums(self.off * self.off, self.own, self.blocks) / self.n

    def similarity(self, luma: np.ndarray) -> np.ndarray:
        """Of each block with the block of the copy."""
        m2 = _sums(luma, self.block, self.blocks) / self.copies
        off = luma - m2[self.block]
        v2 = _sums(off * off, self.block, self.blocks) / self.copies
        if isinstance(self.known, np.ndarray):
            off = luma[self.known] - (_sums(luma[self.known], self.own, self.blocks) / self.n)[self.own]
        cov = _sums(self.off * off, self.own, self.blocks) / self.n
        top = (2.0 * self.mean * m2 + C1) * (2.0 * cov + C2)
        return top / ((self.mean * self.mean + m2 * m2 + C1) * (self.spread + v2 + C2))


def _piece(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Sums of each tile and step it is wanted in."""
    sizes = rows.column("n").to_numpy()
    tiles = len(sizes)
    parts = [np.frombuffer(pa.decompress(p.as_buffer(), 28 * int(n), codec="zstd"), "<i4").reshape(7, int(n))
             for p, n in zip(rows.column("packed"), sizes, strict=True)]
    y, x, *channels, known = np.concatenate(parts, axis=1).astype(np.int64)
    tile = np.repeat(np.arange(tiles), sizes)
    alpha = channels[3]

    def seen(values: np.ndarray) -> np.ndarray:
        return _whole(values * alpha / 255.0)

    has = [(known >> k) & 1 > 0 for k in (2, 3, 4, 5)]
    colours = [h & has[3] for h in has[:3]]
    sides = [seen(c) for c in channels[:3]]
    lit = np.flatnonzero(has[3])  # a copy of a colour that is not known is the largest value

    def luma(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 0.299 * r + 0.587 * g + 0.114 * b

    # Every scale with its elements; the next one has the means of two by two.
    columns = -(-(int(x.max(initial=0)) + 1) // LINES) * LINES
    lines, scales, cells = LINES, [], []
    t, yy, xx, value, own = tile[lit], y[lit], x[lit], luma(*sides)[lit], np.logical_and.reduce(has)[lit]
    across = columns // BLOCK
    for s in range(SCALES):
        if s:
            lines, columns = lines // 2, columns // 2
            cell = (t * lines + yy // 2) * columns + xx // 2
            count = np.bincount(cell, minlength=tiles * lines * columns)
            used = np.flatnonzero(count)
            cells.append((cell, count, used))
            with_own = np.bincount(cell[own], minlength=len(count))[used]
            value = _sums(value[own], cell[own], len(count))[used] / np.maximum(with_own, 1)
            t, yy, xx, own = used // (lines * columns), used // columns % lines, used % columns, with_own > 0
        scales.append(_Scale(t, yy, xx, value, own, lines, columns, tiles))
    # A block is whole if it has so many rows, whether their colours are known or not.
    rows_of = np.bincount((tile * (LINES // BLOCK) + y // BLOCK) * across + x // BLOCK, minlength=scales[0].blocks)
    whole = ((rows_of == BLOCK * BLOCK) & scales[0].there).reshape(tiles, -1)

    lists = rows.column("steps")
    step_of = lists.flatten().to_numpy()
    tile_of = np.repeat(np.arange(tiles), lists.value_lengths().to_numpy())
    out: list[list[np.ndarray]] = [[] for _ in range(len(_SUMS) + 2)]
    for step in np.unique(step_of):
        who = tile_of[step_of == step]
        copies = [seen(np.where(h, np.minimum(_whole(c / step) * step, 255.0), 255.0)) for c, h in zip(channels[:3], has, strict=False)]
        errors = sum(_sums(np.where(k, (a - b) * (a - b), 0.0), tile, tiles) for k, a, b in zip(colours, sides, copies, strict=True))
        any_known = sum(_sums(k.astype(float), tile, tiles) for k in colours) > 0
        value = luma(*copies)[lit]
        found = [np.full(len(who), step, dtype=np.int32), sizes[who], np.where(any_known, errors, np.nan)[who]]
        measured = []
        for s, scale in enumerate(scales):
            if s:
                cell, count, used = cells[s - 1]
                value = _sums(value, cell, len(count))[used] / count[used]
            similar = scale.similarity(value).reshape(tiles, -1)
            if not s:
                measured += [np.where(whole, similar, 0.0).sum(axis=1)[who], whole.sum(axis=1)[who]]
            there = scale.there.reshape(tiles, -1)
            measured += [np.where(there, similar, 0.0).sum(axis=1)[who], there.sum(axis=1)[who]]
        for column, values in zip(out, [who, *found, *measured], strict=True):
            column.append(values)
    kinds = [pa.int32(), *[pa.float64() if c.endswith("double") else pa.int64() for c in _SUMS]]
    who, *values = (np.concatenate(c) if c else np.zeros(0) for c in out)
    arrays = [pa.array(v, kind, mask=np.isnan(v) if kind == pa.float64() else None) for v, kind in zip(values, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([rows.column("image_id").take(pa.array(who.astype(np.int64))), *arrays],
                                      names=["image_id", "step", *[c.split()[0] for c in _SUMS]])
