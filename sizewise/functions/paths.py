"""Column expressions on paths and file heads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sizewise.dims import extension_to_format, format_to_extension
from sizewise.functions.stages import unfused

# Extensions that count as images.
SUPPORTED_EXTENSIONS = ["png", "jpg", "jpeg", "webp", "avif", "gif", "bmp", "tif", "tiff"]

# Leading bytes in hexadecimal, and container brands at byte 8 after "ftyp" at byte 4.
PNG_MAGIC = "89504E470D0A1A0A"
JPEG_MAGIC = "FFD8FF"
RIFF_MAGIC = "52494646"
WEBP_BRAND = "57454250"
FTYP_MAGIC = "66747970"
HEIF_BRANDS = ["avif", "avis", "mif1", "heic", "heix", "heim", "heis", "hevc", "hevx"]
GIF_MAGICS = ["474946383761", "474946383961"]
BMP_MAGIC = "424D"
TIFF_MAGICS = ["49492A00", "4D4D002A"]

DEFAULT_TEMPLATE = "{name}_optimized{format}"
OUTPUT_SUBFOLDER = "optimized"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    """Folder of a path; NULL for a bare file name."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"^(.*)/[^/]*$", 1))


def extension(path: Column) -> Column:
    """Text after the last dot of the file name; empty for none. A leading dot does not start an extension."""
    return F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)


def stem(path: Column) -> Column:
    name = file_name(path)
    return F.coalesce(F.nullif(F.regexp_extract(name, r"^(.+)\.[^.]*$", 1), F.lit("")), name)


def format_of_extension(ext: Column) -> Column:
    return F.coalesce(F.try_element_at(extension_to_format(), F.lower(ext)), F.lit("UNKNOWN"))


def is_supported(ext: Column) -> Column:
    return F.lower(ext).isin(SUPPORTED_EXTENSIONS)


def sniff_format(content: Column) -> Column:
    """Format by leading bytes; only the first 12 bytes are looked at."""
    head = F.hex(F.substring(content, 1, 12))
    brand_ok = F.substring(head, 17, 8).isin([b.encode().hex().upper() for b in HEIF_BRANDS])
    return (
        F.when(head.startswith(PNG_MAGIC), "PNG")
        .when(head.startswith(JPEG_MAGIC), "JPEG")
        .when(head.startswith(RIFF_MAGIC) & (F.substring(head, 17, 8) == WEBP_BRAND), "WEBP")
        .when((F.substring(head, 9, 8) == FTYP_MAGIC) & brand_ok, "AVIF")
        .when(F.substring(head, 1, 12).isin(GIF_MAGICS), "GIF")
        .when(head.startswith(BMP_MAGIC), "BMP")
        .when(F.substring(head, 1, 8).isin(TIFF_MAGICS), "TIFF")
        .otherwise("UNKNOWN")
    )


def png_header(content: Column) -> Column:
    """Width, height and raw scan-line size read from the header chunk of a PNG; NULL for anything else."""

    def big_endian(start: int, length: int) -> Column:
        return F.conv(F.hex(F.substring(content, start, length)), 16, 10).cast("long")

    width, height, depth, kind = big_endian(17, 4), big_endian(21, 4), big_endian(25, 1), big_endian(26, 1)
    channels = F.when(kind.isin(0, 3), 1).when(kind == 2, 3).when(kind == 4, 2).when(kind == 6, 4)
    is_png = (F.hex(F.substring(content, 1, 8)) == PNG_MAGIC) & (F.substring(content, 13, 4) == F.lit(b"IHDR"))
    usable = is_png & channels.isNotNull() & (width > 0) & (height > 0) & depth.between(1, 16)
    return F.when(
        usable,
        F.struct(
            width.alias("width"),
            height.alias("height"),
            (width * height * channels * F.floor((depth + 7) / 8)).alias("raw_size"),
        ),
    )


def validation_issue(path: Column, length: Column, max_bytes: int = 0) -> Column:
    """First problem of an input path; ``Ok`` for none. A limit of 0 means no limit."""
    ext = extension(path)
    issue = (
        F.when(unfused(path.isNull() | (path == "")), "EmptyPath")
        .when(F.array_contains(F.split(path, "/"), ".."), "PathTraversal")
        .when(~is_supported(ext), "UnsupportedExtension")
    )
    if max_bytes > 0:
        issue = issue.when(length > max_bytes, "TooLarge")
    return issue.otherwise("Ok")


def output_path(
    path: Column,
    mode: Column | str = "same_folder",
    custom_folder: Column | None = None,
    preserve_structure: Column | bool = False,
    template: Column | str = "",
    target_extension: Column | None = None,
) -> Column:
    """Destination of an output file from a name template with ``{name}``, ``{ext}`` and ``{format}``."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    template = F.lit(template) if isinstance(template, str) else template
    keep = F.lit(preserve_structure) if isinstance(preserve_structure, bool) else preserve_structure
    custom = F.lit(None).cast("string") if custom_folder is None else custom_folder
    ext = extension(path)
    new_ext = ext if target_extension is None else F.coalesce(target_extension, ext)
    pattern = F.when(unfused(template == ""), F.lit(DEFAULT_TEMPLATE)).otherwise(template)
    name = F.replace(pattern, F.lit("{name}"), stem(path))
    name = F.replace(name, F.lit("{ext}"), F.concat(F.lit("."), ext))
    name = F.replace(name, F.lit("{format}"), F.concat(F.lit("."), new_ext))
    folder = parent(path)
    target_folder = (
        F.when(mode == "output_subfolder", F.concat_ws("/", folder, F.lit(OUTPUT_SUBFOLDER)))
        .when((mode == "custom_folder") & custom.isNotNull() & keep, F.concat_ws("/", custom, file_name(folder)))
        .when((mode == "custom_folder") & custom.isNotNull(), custom)
        .otherwise(folder)
    )
    return F.concat_ws("/", target_folder, name)


def with_format_extension(path: Column, fmt: Column) -> Column:
    """Give a path the canonical extension of a format unless its extension already means that format."""
    target = F.try_element_at(format_to_extension(), fmt)
    keep = fmt.isNull() | target.isNull() | (format_of_extension(extension(path)) == fmt)
    renamed = F.concat(
        F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), stem(path), F.lit("."), target
    )
    return F.when(keep, path).otherwise(renamed)
