"""Image files: discovery, decoding, header reading, content sniffing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sizewise.functions import paths as X
from sizewise.functions.headers import image_size
from sizewise.operators.pixels import MAX_PIXELS

BINARY_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def _with_formats(files: DataFrame) -> DataFrame:
    ext = X.extension(F.col("path"))
    return files.where(X.is_supported(ext)).withColumn("ext_format", X.format_of_extension(ext))


def discover_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Supported image files of a folder, without their bytes: ``content`` is pruned from the scan."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
        .select("path", "length", "modificationTime")
    )
    return _with_formats(files)


def read_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Supported files with bytes, the format of their extension and the format of their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return _with_formats(files).withColumn("real_format", X.sniff_format(F.col("content")))


def stream_files(spark: SparkSession, folder: str) -> DataFrame:
    """New supported files as they arrive, without their bytes."""
    files = (
        spark.readStream.format("binaryFile").schema(BINARY_SCHEMA).option("recursiveFileLookup", "true").load(folder)
        .select("path", "length", "modificationTime")
    )
    return _with_formats(files)


def extension_audit(files: DataFrame) -> DataFrame:
    """Extension against content (path, content), with the repaired path where the two disagree.

    Unknown content is left alone.
    """
    ext = X.extension(F.col("path"))
    rows = files.select(
        "*", X.format_of_extension(ext).alias("ext_format"), X.sniff_format(F.col("content")).alias("real_format")
    ).drop("content")
    matches = (F.col("ext_format") == F.col("real_format")) & (F.col("real_format") != "UNKNOWN")
    known = F.col("real_format") != "UNKNOWN"
    fixed = F.when(known & ~matches, X.with_format_extension(F.col("path"), F.col("real_format")))
    return rows.withColumn("matches", matches).withColumn("renamed_path", fixed)


def image_sizes(files: DataFrame) -> DataFrame:
    """Files (path, content) with ``width`` and ``height`` from their first bytes, whatever the extension says."""
    return files.select("path", image_size(F.col("content")).alias("_s")).select("path", "_s.width", "_s.height")


def read_images(spark: SparkSession, folder: str, max_pixels: int = MAX_PIXELS) -> DataFrame:
    """Decoded images: one row per file with its raster, or with an error.

    The pixel guard looks at the first bytes: files over it are left out of the scan that decodes, by name, as they are of the list of files
    that the driver holds for any scan. Formats without known dimensions are decoded first and guarded then.
    """
    sized = image_sizes(read_files(spark, folder))
    refused = sized.where(F.col("width") * F.col("height") > max_pixels)
    large = refused.collect()  # few: each is a file over the guard
    names = [r["path"] for r in large]
    images = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(folder)
    if names:
        images = images.where(~F.col("_metadata.file_path").isin(names + [_three_slashes(n) for n in names]))
    images = images.select("image.*")
    area = F.col("width").cast("long") * F.col("height")
    error = F.when(F.col("width") < 1, "undecodable").when(area > max_pixels, "too_many_pixels")
    decoded = images.select(
        # The decoder writes local paths with three slashes, the file scan with one; both must join.
        F.regexp_replace("origin", "^([a-zA-Z0-9]+):///", "$1:/").alias("path"),
        "width",
        "height",
        F.col("nChannels").alias("channels"),
        F.when(error.isNull(), F.col("data")).alias("data"),
        error.alias("error"),
    )
    if not names:
        return decoded
    none = [F.lit(None).cast("int").alias("channels"), F.lit(None).cast("binary").alias("data"), F.lit("too_many_pixels").alias("error")]
    # From what is known of them, so that their bytes are not read again.
    rows = spark.createDataFrame([(r["path"], r["width"], r["height"]) for r in large], "path string, width int, height int")
    return decoded.unionByName(rows.select("path", "width", "height", *none))


def _three_slashes(path: str) -> str:
    return re.sub("^([a-zA-Z0-9]+):/(?=[^/])", r"\1:///", path)


def explode_pixels(images: DataFrame, key: str = "path", side: int | None = None) -> DataFrame:
    """Pixel rows of decoded rasters, of a preview of at most ``side`` pixels a side if given.

    Bytes are row-major BGR(A), one channel for grey; alpha defaults to 255. The raster is cut into lines and the
    lines into pixels inside arrays, so neither the raster nor a line is copied into the exploded rows. A preview
    reads only the lines and columns it shows: target i shows source floor((i + 0.5) * length / target_length).
    """
    scale = F.lit(1.0) if side is None else F.least(F.lit(1.0), side / F.greatest("width", "height"))
    usable = images.where("error IS NULL").select(
        F.col(key).alias("image_id"), "width", "height", "channels", "data",
        F.greatest(F.round(F.col("width") * scale), F.lit(1.0)).cast("int").alias("_tw"),
        F.greatest(F.round(F.col("height") * scale), F.lit(1.0)).cast("int").alias("_th"),
    )

    def source(i: Column, full: str, small: str) -> Column:
        return F.floor((i + 0.5) * F.col(full) / F.col(small)).cast("int")

    stride = F.col("width") * F.col("channels")
    lines = F.transform(
        F.sequence(F.lit(0), F.col("_th") - 1),
        lambda i: F.substring(F.col("data"), source(i, "height", "_th") * stride + 1, stride),
    )
    rows = usable.select("image_id", "width", "channels", "_tw", F.posexplode(lines).alias("y", "_line"))
    gray = F.col("channels") == 1

    def byte(at: Column, offset: int) -> Column:
        return F.conv(F.hex(F.substring(F.col("_line"), at + offset, F.lit(1))), 16, 10).cast("int")

    def pixel(j: Column) -> Column:
        at = source(j, "width", "_tw") * F.col("channels") + 1
        return F.struct(
            F.when(gray, byte(at, 0)).otherwise(byte(at, 2)).alias("r"),
            F.when(gray, byte(at, 0)).otherwise(byte(at, 1)).alias("g"),
            byte(at, 0).alias("b"),
            F.when(F.col("channels") == 4, byte(at, 3)).otherwise(255).alias("a"),
        )

    cells = F.transform(F.sequence(F.lit(0), F.col("_tw") - 1), pixel)
    return rows.select("image_id", "y", F.posexplode(cells).alias("x", "_p")).select("image_id", "x", "y", "_p.*")
