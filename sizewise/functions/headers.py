"""Dimensions of images of every format from the first bytes, without decoding a pixel.

Fields at fixed places are read directly. Where a format is a chain of parts (segments, boxes, directory entries), a fold of bounded length
walks from part to part; a file that needs more steps, or that is cut off before its dimensions, has none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sizewise.functions.paths import sniff_format

#: Parts that are looked at, at most: JPEG segments, boxes of a container, entries of a TIFF directory.
SEGMENTS, BOXES, ENTRIES = 96, 192, 256
# Markers, signatures, box types and tags in hexadecimal or as numbers.
JPEG_FRAMES = [0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF]
JPEG_BARE = [0x01, *range(0xD0, 0xD9)]
JPEG_ENDS = [0xD9, 0xDA]
VP8_START, VP8L_START = "9D012A", 0x2F
BOX_META, BOX_PROPERTIES, BOX_CONTAINER, BOX_SIZE = "6D657461", "69707270", "6970636F", "69737065"
TIFF_WIDTH, TIFF_HEIGHT, TIFF_SHORT, TIFF_LONG = 256, 257, 3, 4


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


class Bytes:
    """Numbers and signatures at places of a binary column, counted from 0; NULL behind its end."""

    def __init__(self, content: Column):
        self.content = content

    def hex(self, at: Column | int, n: int) -> Column:
        at = F.lit(at) if isinstance(at, int) else at
        there = (at >= 0) & (at <= F.octet_length(self.content) - n)
        return F.when(there, F.hex(F.substring(self.content, at.cast("int") + 1, F.lit(n))))

    def big(self, at: Column | int, n: int) -> Column:
        return F.conv(self.hex(at, n), 16, 10).try_cast("long")

    def little(self, at: Column | int, n: int) -> Column:
        def turned(part: Column) -> Column:
            return F.conv(F.concat(*[F.substring(part, 2 * k + 1, 2) for k in range(n - 1, -1, -1)]), 16, 10).try_cast("long")

        return _let(self.hex(at, n), turned)


def _size(width: Column, height: Column) -> Column:
    return F.struct(width.cast("long").alias("width"), height.cast("long").alias("height"))


def _walk(steps: int, begin: Column, step: Callable[[Column], tuple[Column, Column, Column]]) -> Column:
    """Dimensions that a fold finds. ``step`` takes the place reached and gives the next one (NULL to stop) and dimensions, if any.

    Of several dimensions the largest picture counts.
    """
    no = F.lit(None).cast("long")
    state = F.struct(begin.cast("long").alias("at"), no.alias("width"), no.alias("height"))

    def move(s: Column, _: Column) -> Column:
        after, width, height = step(s["at"])
        new = F.struct(after.cast("long").alias("at"), width.cast("long").alias("width"), height.cast("long").alias("height"))

        def larger(n: Column) -> Column:
            more = n["width"] * n["height"] > F.coalesce(s["width"] * s["height"], F.lit(-1))
            return F.struct(n["at"].alias("at"), F.when(more, n["width"]).otherwise(s["width"]).alias("width"),
                            F.when(more, n["height"]).otherwise(s["height"]).alias("height"))

        return F.when(s["at"].isNull(), s).otherwise(_let(new, larger))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, move)
    return _let(found, lambda f: _size(f["width"], f["height"]))


def _png(b: Bytes) -> Column:
    return F.when(b.hex(12, 4) == "49484452", _size(b.big(16, 4), b.big(20, 4)))


def _gif(b: Bytes) -> Column:
    return _size(b.little(6, 2), b.little(8, 2))


def _bmp(b: Bytes) -> Column:
    def signed(at: int) -> Column:
        value = b.little(at, 4)
        return F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value)

    # The oldest heads have fields of two bytes; a negative height is a picture from the top down.
    return F.when(b.little(14, 4) == 12, _size(b.little(18, 2), b.little(20, 2))).otherwise(_size(signed(18), F.abs(signed(22))))


def _webp(b: Bytes) -> Column:
    kind = b.hex(12, 4)
    packed = b.little(21, 4)
    fourteen = F.lit((1 << 14) - 1)
    lossy = F.when(b.hex(23, 3) == VP8_START, _size(b.little(26, 2).bitwiseAND(fourteen), b.little(28, 2).bitwiseAND(fourteen)))
    lossless = F.when(b.big(20, 1) == VP8L_START, _size(
        packed.bitwiseAND(fourteen) + 1, F.shiftright(packed, 14).bitwiseAND(fourteen) + 1))
    return (
        F.when(kind == "56503820", lossy).when(kind == "5650384C", lossless)
        .when(kind == "56503858", _size(b.little(24, 3) + 1, b.little(27, 3) + 1))
    )


def _jpeg(b: Bytes) -> Column:
    def step(at: Column) -> tuple[Column, Column, Column]:
        lead, marker, length = b.hex(at, 1), b.big(at + 1, 1), b.big(at + 2, 2)
        frame = (lead == "FF") & marker.isin(JPEG_FRAMES)
        after = (
            F.when((lead != "FF") | frame | marker.isin(JPEG_ENDS), None).when(marker == 0xFF, at + 1)  # a fill byte
            .when(marker.isin(JPEG_BARE), at + 2).when(length >= 2, at + 2 + length)
        )
        return after, F.when(frame, b.big(at + 7, 2)), F.when(frame, b.big(at + 5, 2))

    return _walk(SEGMENTS, F.lit(2), step)


def _boxes(b: Bytes) -> Column:
    def step(at: Column) -> tuple[Column, Column, Column]:
        size, kind = b.big(at, 4), b.hex(at + 4, 4)
        # Boxes on the way to the dimensions are entered, which is going on behind their head.
        after = (
            F.when(kind == BOX_META, at + 12).when(kind.isin(BOX_PROPERTIES, BOX_CONTAINER), at + 8)
            .when((size == 1) & (b.big(at + 8, 8) >= 16), at + b.big(at + 8, 8)).when(size >= 8, at + size)
        )
        is_size = kind == BOX_SIZE
        return after, F.when(is_size, b.big(at + 12, 4)), F.when(is_size, b.big(at + 16, 4))

    return _walk(BOXES, F.lit(0), step)


def _tiff(b: Bytes) -> Column:
    little = b.hex(0, 2) == "4949"

    def number(at: Column, n: int) -> Column:
        return _let(at, lambda a: F.when(little, b.little(a, n)).otherwise(b.big(a, n)))

    def fields(directory: Column) -> Column:
        count = F.least(number(directory, 2), F.lit(ENTRIES)).cast("int")
        places = F.when(count >= 1, F.transform(F.sequence(F.lit(0), count - 1), lambda k: directory + 2 + k * 12))

        def field(tag: int) -> Column:
            entry = F.get(F.filter(places, lambda p: number(p, 2) == tag), F.lit(0))
            return _let(entry, lambda e: _let(number(e + 2, 2), lambda kind: F.when(kind == TIFF_SHORT, number(e + 8, 2)).when(
                kind == TIFF_LONG, number(e + 8, 4))))

        return _size(field(TIFF_WIDTH), field(TIFF_HEIGHT))

    return _let(number(F.lit(4), 4), fields)


def image_size(content: Column, fmt: Column | None = None) -> Column:
    """Width and height of an image by its first bytes; NULL if the format is unknown, or a side is missing or not positive."""
    b = Bytes(content)
    fmt = sniff_format(content) if fmt is None else fmt
    found = (
        F.when(fmt == "PNG", _png(b)).when(fmt == "JPEG", _jpeg(b)).when(fmt == "WEBP", _webp(b)).when(fmt == "AVIF", _boxes(b))
        .when(fmt == "GIF", _gif(b)).when(fmt == "BMP", _bmp(b)).when(fmt == "TIFF", _tiff(b))
    )
    return _let(found, lambda f: F.when((f["width"] > 0) & (f["height"] > 0), f))
