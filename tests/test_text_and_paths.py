"""Published formatter cases and both sides of the path rules."""

import pytest
from pyspark.sql import functions as F

from sizewise.functions import goals, paths, text


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first().v


@pytest.mark.parametrize(
    "value, expected",
    [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KiB"), (1048576, "1.0 MiB"), (1073741824, "1.0 GiB"), (-1024, "-1.0 KiB"),
     (1280, "1.2 KiB"), (1024**5, "1.0 PiB")],
)
def test_bytes(spark, value, expected):
    assert one(spark, text.format_bytes(F.lit(value).cast("long"))) == expected


@pytest.mark.parametrize("ms, expected", [(0, "0 ms"), (500, "500 ms"), (1000, "0:01"), (60000, "1:00"), (3602000, "1:00:02")])
def test_duration(spark, ms, expected):
    assert one(spark, text.format_duration(F.lit(ms).cast("long"))) == expected


@pytest.mark.parametrize("value, expected", [(37.12, "37.1%"), (-12.3, "-12.3%"), (-0.01, "-0.0%"), (0.0, "0.0%")])
def test_percent(spark, value, expected):
    assert one(spark, text.format_percent(F.lit(value))) == expected


@pytest.mark.parametrize("value, expected", [(float("nan"), "—"), (0.985, "099"), (0.0, "000"), (2.0, "100")])
def test_quality(spark, value, expected):
    assert one(spark, text.format_quality(F.lit(value))) == expected


@pytest.mark.parametrize("value, band", [(50, "high"), (40, "high"), (20, "medium"), (5, "low"), (0, "none"), (-5, "none")])
def test_band(spark, value, band):
    assert one(spark, text.reduction_band(F.lit(value))) == band


@pytest.mark.parametrize("path", ["/home/user/pictures/photo.png", "C:\\Users\\user\\photo.png", "photo.png"])
def test_basename(spark, path):
    assert one(spark, text.basename(F.lit(path))) == "photo.png"


@pytest.mark.parametrize(
    "prompt, goal",
    [("", "BALANCED"), ("Lossless", "LOSSLESS"), ("Compress", "MAXIMUM"), ("fotos más ligeras, pero que se vean con la misma calidad", "EXTREME"),
     ("reduce every scan of the archive", "MAXIMUM"), ("un peso mínimo para el correo", "MAXIMUM"), ("a BIT-EXACT copy, please", "LOSSLESS"),
     ("que quede idéntico a la vista", "QUALITY"), ("shown in a browser", "WEB"), ("algo intermedio, equilibrado", "BALANCED"), ("extreme", "BALANCED"),
     ("extreme care for how it looks", "EXTREME"), ("nothing of the kind", "BALANCED")],
)
def test_goal_from_text(spark, prompt, goal):
    df = spark.createDataFrame([(prompt,)], "prompt string")
    assert goals.add_goal(df, "prompt").first().goal == goal


@pytest.mark.parametrize("name, fmt", [("png", "PNG"), (".JPG", "JPEG"), (" WebP ", "WEBP"), ("heic", None), ("", None)])
def test_forced_format(spark, name, fmt):
    assert one(spark, goals.forced_format(F.lit(name))) == fmt


@pytest.mark.parametrize(
    "path, issue",
    [("a/b.png", "Ok"), ("", "EmptyPath"), ("a/../b.png", "PathTraversal"), ("a/b..c.png", "Ok"), ("a/b", "UnsupportedExtension"),
     ("a/.png", "UnsupportedExtension"), ("a/b.TIFF", "Ok"), ("a/b.txt", "UnsupportedExtension")],
)
def test_validation(spark, path, issue):
    assert one(spark, paths.validation_issue(F.lit(path), F.lit(10))) == issue


def test_size_limit(spark):
    assert one(spark, paths.validation_issue(F.lit("a.png"), F.lit(11), 10)) == "TooLarge"
    assert one(spark, paths.validation_issue(F.lit("a.png"), F.lit(10), 10)) == "Ok"


@pytest.mark.parametrize(
    "path, mode, expected",
    [("/p/x.png", "same_folder", "/p/x_optimized.webp"), ("/p/x.png", "output_subfolder", "/p/optimized/x_optimized.webp"),
     ("/p/x.png", "custom_folder", "/out/p/x_optimized.webp"), ("x.png", "same_folder", "x_optimized.webp")],
)
def test_output_path(spark, path, mode, expected):
    out = paths.output_path(F.lit(path), mode, F.lit("/out"), True, "", F.lit("webp"))
    assert one(spark, out) == expected


@pytest.mark.parametrize(
    "path, fmt, expected",
    [("/a.b/x.png", "WEBP", "/a.b/x.webp"), ("x.jpeg", "JPEG", "x.jpeg"), ("/a.b/x", "TIFF", "/a.b/x.tif"), ("x.png", None, "x.png")],
)
def test_extension_follows_format(spark, path, fmt, expected):
    assert one(spark, paths.with_format_extension(F.lit(path), F.lit(fmt))) == expected


@pytest.mark.parametrize(
    "head, fmt",
    [("89504E470D0A1A0A", "PNG"), ("89504E47", "UNKNOWN"), ("FFD8FF", "JPEG"), ("52494646112233445745425000", "WEBP"),
     ("000000206674797061766966", "AVIF"), ("000000206674797068656963", "AVIF"), ("0000002066747970717420", "UNKNOWN"),
     ("474946383961", "GIF"), ("424D", "BMP"), ("49492A00", "TIFF"), ("4D4D002A", "TIFF"), ("", "UNKNOWN")],
)
def test_sniff(spark, head, fmt):
    assert one(spark, paths.sniff_format(F.unhex(F.lit(head)))) == fmt


def test_candidates_are_made_by_several_tasks_however_the_images_are_read(spark, tmp_path):
    from pyspark.sql import functions as F

    from sizewise.queries import QUERIES

    spark.range(300).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    rows = QUERIES["generate_candidates"](spark, str(tmp_path))
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 8
