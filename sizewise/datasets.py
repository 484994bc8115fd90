"""Working tables derived from the provided parquet tables, one function per table of the data model.

Each is a plain projection, explode or equi-join of a whole source table, so its size follows the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sizewise.functions import profile as P
from sizewise.session import deal, spread, tasks_for


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index: Column, values: list) -> Column:
    """values[index] as a literal array lookup; index must be within range."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured candidates: one row per line item, one image per order.

    Both sides are dealt by image to as many tasks as the rows need. Work by image goes on in these tasks, whatever number of partitions
    the session has. Parquet files name their number of rows, so nothing else is read for it.
    """
    items = read(spark, sf_dir, "lineitem")
    tasks = tasks_for(spark, items.count())
    items = deal(items, tasks, "l_orderkey")
    orders = deal(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), tasks, "o_orderkey")
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    fmt = _pick(part % 4, ["PNG", "JPEG", "WEBP", "AVIF"])
    lossless = (F.col("format") == "PNG") | ((F.col("format") == "WEBP") & (F.col("l_returnflag") == "R"))
    iterative = ~F.col("lossless") & (F.col("l_linestatus") == "F")
    measured = supp % 11 != 0
    return (
        items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumn("format", fmt)
        .withColumn("lossless", lossless)
        .select(
            F.col("l_orderkey").alias("image_id"),
            F.concat_ws(
                "-", "l_linenumber", "l_partkey", "l_suppkey",
                F.round(F.col("l_extendedprice") * 100).cast("long"), F.unix_date(F.col("l_shipdate").cast("date")),
            ).alias("candidate_id"),
            _pick(
                F.col("l_orderkey") % 6, ["LOSSLESS", "QUALITY", "BALANCED", "MAXIMUM", "WEB", "EXTREME"]
            ).alias("goal"),
            F.floor(F.col("o_totalprice") * 10).alias("original_size"),
            F.floor(F.col("l_extendedprice") * (part % 40 + 3)).alias("output_size"),
            "format",
            "lossless",
            iterative.alias("iterative"),
            F.when(~F.col("lossless"), 20 + (supp * 7) % 76).cast("int").alias("quality"),
            (part % 29 != 0).alias("success"),
            F.when(measured, 0.999 - 3.7 * F.col("l_discount")).alias("ssim"),
            F.when(measured, 22.0 + 300.0 * F.col("l_tax")).alias("psnr"),
            F.lit(None).cast("double").alias("mse"),
            F.when(F.col("l_quantity").cast("int") % 3 != 0, 0.21 + F.col("l_quantity") / 17.0).alias("perceptual"),
            (50 + (part * 31) % 9000).alias("estimated_cost_ms"),
            (F.col("l_orderkey") % 2 == 0).alias("photo_like"),
            F.when(F.col("l_orderkey") % 5 != 0, 0.90 + (F.col("l_orderkey") % 13) * 0.0077).alias("lossy_probe_ssim"),
        )
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image profiles: one per part, with category and tags from the library's own rules."""
    k = F.col("p_partkey")

    def share(factor: int, scale: float) -> Column:
        return (k * factor % 100) / 100.0 * scale

    base = (
        read(spark, sf_dir, "part")
        .select(
            k.alias("image_id"),
            _pick(k % 7, ["PNG", "JPEG", "WEBP", "AVIF", "GIF", "BMP", "TIFF"]).alias("format"),
            (16 + (k * 97) % 1500).cast("int").alias("width"),
            (16 + (k * 61) % 1200).cast("int").alias("height"),
            (1024 + (k * 7919) % 900000 + F.when(k % 211 == 0, 62914560).otherwise(0)).alias("file_size"),
            share(37, 0.6).alias("complexity"),
            share(53, 0.25).alias("edge_density"),
            ((k * 71) % 150).cast("int").alias("flat_run_count"),
            share(29, 0.8).alias("dark_region_ratio"),
            share(43, 1.0).alias("mean_saturation"),
            share(17, 0.6).alias("noise_estimate"),
            (k % 4 == 1).alias("has_alpha"),
            F.when(k % 9 != 0, 0.90 + (k % 13) * 0.0077).alias("lossy_probe_ssim"),
            F.when(k % 9 != 0, 0.1 + (k % 50) * 0.05).alias("lossy_probe_bpp"),
        )
        .withColumn("flat_region_ratio", F.col("flat_run_count") / (2.0 * F.col("height")))
        .withColumn("is_animated", F.col("format") == "GIF")
        .withColumn("pixel_count", P.pixel_count(F.col("width"), F.col("height")))
    )
    return base.withColumn(
        "category",
        P.category(
            F.col("complexity"), F.col("edge_density"), F.col("flat_run_count"), F.col("dark_region_ratio"),
            F.col("pixel_count"), F.col("format"),
        ),
    ).withColumn(
        "characteristics",
        P.characteristics(
            F.col("flat_run_count"), F.col("complexity"), F.col("has_alpha"), F.lit(False), F.col("mean_saturation"),
            F.col("dark_region_ratio"), F.col("flat_region_ratio"), F.col("noise_estimate"), F.col("edge_density"),
        ),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles with the user's constraints, before a goal is attached."""
    return with_constraints(profiles(spark, sf_dir))


def with_constraints(profiles: DataFrame) -> DataFrame:
    k = F.col("image_id")
    return profiles.select(
        "*",
        F.when(k % 10 == 3, "JPEG").when(k % 10 == 7, "WEBP").when(k % 50 == 9, "AVIF").alias("force_format"),
        (k % 13 == 0).alias("force_lossless"),
        F.when(k % 5 == 0, 800).cast("int").alias("max_width"),
        F.when(k % 7 == 0, 600).cast("int").alias("max_height"),
        (k % 6 == 1).alias("strip_all_metadata"),
        (k % 8 != 0).alias("preserve_color_profile"),
        F.when(k % 12 == 0, 5000).cast("long").alias("time_limit_ms"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RGBA pixels: four embedding vectors make one 16 x 16 image."""
    cells = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    image = F.floor(F.col("vec_id") / 4).cast("long")
    cells = cells.withColumn("image_id", image).withColumn("v", F.col("v").cast("double"))
    i = F.col("image_id")
    gain = F.when(i % 7 == 0, 1200.0).when(i % 5 == 0, 60.0).otherwise(300.0)
    base = F.when(i % 5 == 0, 20.0).otherwise(128.0)

    def channel(k: float) -> Column:
        return F.least(F.greatest(F.round(base + gain * k * F.col("v")), F.lit(0.0)), F.lit(255.0)).cast("int")

    x = ((F.col("vec_id") % 2) * 8 + F.col("pos") % 8).cast("int")
    y = (F.floor((F.col("vec_id") % 4) / 2) * 8 + F.floor(F.col("pos") / 8)).cast("int")
    return cells.select(
        "image_id",
        x.alias("x"),
        y.alias("y"),
        channel(1.0).alias("r"),
        channel(0.5).alias("g"),
        channel(-0.5).alias("b"),
        F.when((i % 3 == 0) & (x < 4), 128).otherwise(255).alias("a"),
    )


def strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pixel per line item, without coordinates: for statistics that need no neighbours."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image_id"),
        F.floor(F.col("l_quantity") * 5).cast("int").alias("r"),
        F.floor(F.col("l_discount") * 2550).cast("int").alias("g"),
        F.floor(F.col("l_tax") * 3187).cast("int").alias("b"),
        F.lit(255).alias("a"),
    )


def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the file scan knows about each image of ``pixels``."""
    i = F.col("image_id")
    ids = read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).cast("long").alias("image_id")).distinct()
    return ids.select(
        i,
        _pick(i % 3, ["PNG", "JPEG", "WEBP"]).alias("format"),
        F.lit(16).alias("width"),
        F.lit(16).alias("height"),
        (1000 + (i * 7919) % 90000).alias("file_size"),
    )


def library_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RGBA pixels of larger images: 64 embedding vectors, a line each, make one of 64 x 64; every eighth vector begins one.

    Some are noisy, some nearly flat, some have a slope across.
    """
    vectors = spread(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")  # one task may read what makes millions of pixels
    last = F.floor(F.col("vec_id") / 8).cast("long")
    first = F.floor(F.greatest(F.col("vec_id") - 56, F.lit(0)) / 8).cast("long")
    lines = vectors.select("vec_id", "embedding", F.explode(F.sequence(first, last)).alias("image_id"))
    whole = vectors.where("vec_id % 8 = 7 AND vec_id >= 63").select(F.floor((F.col("vec_id") - 63) / 8).cast("long").alias("image_id"))
    cells = lines.join(whole, "image_id", "left_semi").select(
        "image_id", (F.col("vec_id") - 8 * F.col("image_id")).cast("int").alias("y"), F.posexplode("embedding").alias("x", "v"))
    i, x = F.col("image_id"), F.col("x")
    gain = F.when(i % 7 == 0, 1200.0).when(i % 5 == 0, 60.0).when(i % 3 == 1, 20.0).otherwise(300.0)
    base = F.when(i % 5 == 0, 20.0).otherwise(128.0)
    slope = F.when(i % 2 == 0, 1.5).otherwise(0.0) * (x - 32)

    def channel(k: float) -> Column:
        value = F.round(base + slope + gain * k * F.col("v").cast("double"))
        return F.least(F.greatest(value, F.lit(0.0)), F.lit(255.0)).cast("int")

    return cells.select("image_id", x.alias("x"), "y", channel(1.0).alias("r"), channel(0.5).alias("g"), channel(-0.5).alias("b"),
                        F.when((i % 4 == 3) & (x < 4), 128).otherwise(255).alias("a"))


def library_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the file scan knows about each image of ``library_pixels``."""
    i = F.col("image_id")
    ids = read(spark, sf_dir, "embeddings").where("vec_id % 8 = 7 AND vec_id >= 63").select(
        F.floor((F.col("vec_id") - 63) / 8).cast("long").alias("image_id"))
    return ids.select(
        i, _pick(i % 5, ["PNG", "JPEG", "WEBP", "BMP", "TIFF"]).alias("format"), F.lit(64).alias("width"), F.lit(64).alias("height"),
        (2000 + (i * 7919) % 30000).alias("file_size"))


def rungs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and damage of every part image at every quality from 20 to 95."""
    images = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"))
    return _at_every_quality(images)


def _at_every_quality(images: DataFrame) -> DataFrame:
    """Rows of images with each quality from 20 to 95, its size and damage."""
    k, q = F.col("image_id"), F.col("q")
    others = [c for c in images.columns if c != "image_id"]
    return images.select("image_id", *others, F.explode(F.sequence(F.lit(20), F.lit(95))).alias("q")).select(
        "image_id",
        *others,
        "q",
        F.floor(20000.0 * F.pow(q / 100.0, F.lit(1.7)) + (k * q) % 700).cast("long").alias("size"),
        (
            F.lit(0.2)
            + (100.0 - q) / (20.0 + k % 37)
            + ((k * 13 + q) % 9) * 0.05
            + F.when(k % 23 == 0, 3.0).otherwise(0.0)
        ).alias("damage"),
    )


def format_rungs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rungs of every image as JPEG and as AVIF, with the target that suits its profile.

    Images are joined before their rungs are listed: the planner does not see how many rows a list makes, and would broadcast them.
    """
    wanted = profiles(spark, sf_dir).select(
        "image_id",
        P.adaptive_target(
            F.lit(1.5), F.col("noise_estimate"), F.col("complexity"), F.col("dark_region_ratio"), F.col("edge_density")
        ).alias("target"),
    )
    images = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"))
    images = images.join(wanted, "image_id").withColumn("format", F.explode(F.array(F.lit("JPEG"), F.lit("AVIF"))))
    avif = F.col("format") == "AVIF"
    return _at_every_quality(images).select(
        "image_id",
        "format",
        "q",
        "target",
        F.when(avif, F.floor(F.col("size") * 0.7)).otherwise(F.col("size")).cast("long").alias("size"),
        F.when(avif, F.col("damage") * 0.9).otherwise(F.col("damage")).alias("damage"),
    )


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_job_events(read(spark, sf_dir, "events"))


def as_job_events(events: DataFrame) -> DataFrame:
    """Job status events out of the raw event log; also used on the streaming read."""
    kinds = {"signup": "Queued", "view": "Processing", "purchase": "Completed", "error": "Failed", "click": "Cancelled"}
    status = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    e = F.col("event_id")
    original = F.floor(F.col("value") * 1000).cast("long")
    return events.select(
        F.col("user_id").alias("job_id"),
        "event_id",
        "ts",
        F.try_element_at(status, F.col("event_type")).alias("status"),
        original.alias("original_size"),
        F.floor(original * ((e * 37) % 120) / 100.0).cast("long").alias("final_size"),
        ((e * 53) % 90000).alias("processing_time_ms"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = F.floor(F.col("o_totalprice") * 100).cast("long")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("timestamp"),
        F.col("o_orderpriority").alias("profile_name"),
        F.lit(1).alias("files_processed"),
        (F.col("o_orderstatus") == "F").cast("int").alias("files_failed"),
        original.alias("original_size"),
        F.floor(original * (30 + F.col("o_custkey") % 90) / 100.0).cast("long").alias("output_size"),
        ((F.col("o_custkey") * 13) % 60000).alias("duration_ms"),
    )


# One prompt per way the goal can be decided.
PROMPTS = [
    "", "Lossless", "que pese menor sin perder nada", "comprimir todo el álbum", "reduce the gallery", "copia sin perdida",
    "buena calidad, por favor", "quick thumbnails", "un resultado equilibrado", "Compress", "extreme but sharp", "for the browser",
    "holiday pictures", "   ", "ExtremeLightweight", "keep the look, save bytes",
]
FORCED = [None, "png", ".JPG", " webp ", "heic", "", "AVIF"]


def goal_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        k.alias("request_id"),
        _pick(k % len(PROMPTS), PROMPTS).alias("prompt"),
        _pick(k % len(FORCED), FORCED).alias("force_format_text"),
    )


# Extensions given to the pages, some unsupported, one empty.
PAGE_EXTENSIONS = [".png", ".JPG", ".jpeg", ".webp", ".avif", ".gif", "", ".txt", ".tif"]


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_paths(read(spark, sf_dir, "pages"))


def as_paths(pages: DataFrame) -> DataFrame:
    """Paths of image files made of the addresses of pages; also used on the streaming read."""
    k = F.col("page_id")
    return pages.select(
        k.alias("file_id"),
        F.concat(
            F.when(k % 17 == 0, "../").otherwise(""),
            F.regexp_extract("url", r"^https?://([^?#]*)", 1),
            F.lit("/"),
            k.cast("string"),
            _pick(k % len(PAGE_EXTENSIONS), PAGE_EXTENSIONS),
        ).alias("path"),
        F.length("html").cast("long").alias("length"),
        _pick(k % 4, ["same_folder", "output_subfolder", "custom_folder", "elsewhere"]).alias("output_mode"),
        F.when(k % 3 != 0, "/exports").alias("custom_folder"),
        (k % 2 == 0).alias("preserve_structure"),
        _pick(k % 3, ["", "{name}-small{format}", "{name}{ext}"]).alias("template"),
        F.when(k % 5 == 1, "webp").alias("target_extension"),
    )


# File heads in hexadecimal: every known format, container brands, truncated and unknown heads.
FILE_HEADS = [
    "89504E470D0A1A0A", "FFD8FFE0", "524946461122334457454250", "000000206674797061766966", "00000020667479706D696631",
    "000000206674797071742020", "474946383761", "474946383961", "424D", "49492A00", "4D4D002A", "00112233", "89504E47",
    "524946461122334441564920",
]
FILE_EXTENSIONS = ["png", "jpg", "WEBP", "avif", "gif", "bmp", "tif", "txt", "jpeg"]


def file_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a path and bytes: each document behind one of the file heads."""
    k = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(
        k.alias("file_id"),
        F.concat(
            F.lit("library/"), F.col("source"), F.lit("/file-"), k.cast("string"), F.lit("."),
            _pick(k % len(FILE_EXTENSIONS), FILE_EXTENSIONS),
        ).alias("path"),
        F.concat(F.unhex(_pick(k % len(FILE_HEADS), FILE_HEADS)), F.col("text").cast("binary")).alias("content"),
    )


TAG_NAMES = [
    "Make", "Model", "Software", "DateTime", "Orientation", "GPS", "DateTimeOriginal", "DateTimeDigitized", "PixelXDimension",
    "PixelYDimension", "ImageWidth", "ImageLength",
]


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata tags in file order: one tag per event, one image per user."""
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("image_id"),
        F.col("event_id").alias("pos"),
        _pick(F.col("event_id") % len(TAG_NAMES), TAG_NAMES).alias("tag"),
        F.when(F.col("event_id") % len(TAG_NAMES) >= 8, (F.col("event_id") % 4000).cast("string")).otherwise(F.col("props")).alias("value"),
    )


def tagged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image files that ``tags`` were read from; many have none."""
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        k.alias("image_id"), _pick(k % 3, ["JPEG", "TIFF", "PNG"]).alias("format")
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows: one per event. Every tenth timestamp is text that is not a time."""
    return as_logs(read(spark, sf_dir, "events"))


def as_logs(events: DataFrame) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "click", "WARN").otherwise("INFO")
    return events.select(
        F.col("event_id").alias("log_id"),
        "ts",
        F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("at "), F.col("event_id").cast("string")))
        .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .alias("timestamp"),
        level.alias("level"),
        F.when(F.col("user_id") % 2 == 0, "engine").otherwise("frontend").alias("source"),
        F.col("props").alias("message"),
    )


def small_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RGBA pixels of images of 8 x 8: one embedding vector each."""
    cells = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))

    def channel(k: float) -> Column:
        value = F.round(128.0 + 300.0 * k * F.col("v").cast("double"))
        return F.least(F.greatest(value, F.lit(0.0)), F.lit(255.0)).cast("int")

    return cells.select(
        F.col("vec_id").alias("image_id"),
        (F.col("pos") % 8).cast("int").alias("x"),
        F.floor(F.col("pos") / 8).cast("int").alias("y"),
        channel(1.0).alias("r"),
        channel(0.5).alias("g"),
        channel(-0.5).alias("b"),
        F.when(F.col("pos") % 5 == 0, 128).otherwise(255).alias("a"),
    )


def header_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first bytes of PNG files, one per document, of all colour types; some are cut off or of another kind."""
    k = F.col("doc_id")

    def big_endian(v: Column, digits: int) -> Column:
        return F.lpad(F.hex(v.cast("long")), digits, "0")

    kind = _pick(k % 6, ["00", "02", "03", "04", "06", "05"])
    head = F.concat(
        F.when(k % 11 == 0, "FFD8FFE000104A46").otherwise("89504E470D0A1A0A"), F.lit("0000000D49484452"),
        big_endian(k % 5000, 8), big_endian(1 + k % 3000, 8), _pick(k % 3, ["08", "10", "01"]), kind, F.lit("000000"),
    )
    content = F.concat(F.unhex(head), F.col("text").cast("binary"))
    return read(spark, sf_dir, "documents").select(
        k.alias("image_id"), F.when(k % 13 == 0, F.substring(content, 1, 20)).otherwise(content).alias("content")
    )


def image_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first bytes of images of all formats, one per document, whose text stands in the parts between; some are cut off.

    Sides are 1 + 37 k % 5000 and 1 + 61 k % 4000 for document k, for the small ones of old formats within their fields.
    """
    k = F.col("doc_id")
    w, h = 1 + k * 37 % 5000, 1 + k * 61 % 4000

    def big(v: Column, n: int) -> Column:
        return F.unhex(F.lpad(F.hex(v.cast("long")), 2 * n, "0"))

    def little(v: Column, n: int) -> Column:
        digits = F.lpad(F.hex(v.cast("long")), 2 * n, "0")
        return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in range(n - 1, -1, -1)]))

    def fixed(digits: str) -> Column:
        return F.unhex(F.lit(digits))

    note = F.substring(F.col("text").cast("binary"), F.lit(1), (k % 700).cast("int"))
    size = F.octet_length(note)
    zero = fixed("00")

    def box(kind: str, *parts: Column) -> Column:
        body = F.concat(*parts)
        return F.concat(big(8 + F.octet_length(body), 4), F.lit(kind).cast("binary"), body)

    def entry(tag: int, kind: int, v: Column) -> Column:
        return F.concat(little(F.lit(tag), 2), little(F.lit(kind), 2), little(F.lit(1), 4), little(v, 4))

    sizes = F.concat(box("ispe", zero, zero, zero, zero, big(F.least(w, F.lit(8)), 4), big(F.least(h, F.lit(8)), 4)),
                     box("ispe", zero, zero, zero, zero, big(w, 4), big(h, 4)))
    heads = [
        F.concat(fixed("89504E470D0A1A0A0000000D49484452"), big(w, 4), big(h, 4), fixed("0806000000")),
        F.concat(fixed("FFD8FFE0"), big(size + 2, 2), note, fixed("FFFFDB0004AAAA"), fixed("FFC2001108"), big(h, 2), big(w, 2)),
        F.concat(fixed("52494646FFFFFFFF5745425056503820FFFFFFFF0000009D012A"), little(w + 16384, 2), little(h, 2)),
        F.concat(fixed("52494646FFFFFFFF574542505650384CFFFFFFFF2F"), little((w - 1) + (h - 1) * 16384, 4)),
        F.concat(fixed("52494646FFFFFFFF5745425056503858FFFFFFFF10000000"), little(w - 1, 3), little(h - 1, 3)),
        F.concat(box("ftyp", fixed("61766966")), box("free", note), box("meta", zero, zero, zero, zero, box("iprp", box("ipco", box("pixi", note), sizes)))),
        F.concat(fixed("474946383961"), little(w, 2), little(h, 2)),
        F.concat(fixed("424D0000000000000000000000002800"), fixed("0000"), little(w, 4), little(F.lit(4294967296) - h, 4)),
        F.concat(fixed("49492A00"), little(8 + size, 4), note, little(F.lit(3), 2), entry(254, 4, F.lit(0)), entry(256, 3, w), entry(257, 4, h)),
    ]
    content = F.element_at(F.array(*heads), (k % len(heads) + 1).cast("int"))
    cut = F.substring(content, F.lit(1), (F.octet_length(content) - 3).cast("int"))
    return read(spark, sf_dir, "documents").select(k.alias("image_id"), F.when(k % 13 == 0, cut).otherwise(content).alias("content"))


def encode_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured candidates with the settings of the encoder that also shape the bytes; some are not set."""
    c = F.col("estimated_cost_ms")
    return measurements(spark, sf_dir).select(
        "*",
        F.when(F.col("format") == "AVIF", 60 + c % 2).cast("int").alias("alpha_quality"),
        F.when(c % 5 == 0, 30000).cast("long").alias("time_budget_ms"),
        _pick(c % 3, ["keep", "strip_private", "strip_all"]).alias("metadata_mode"),
        (c % 4 == 0).alias("preserve_color_profile"),
        F.when(c % 7 == 0, "fit").alias("resize_mode"),
        F.when(c % 7 == 0, 800).cast("int").alias("resize_width"),
        F.lit(None).cast("int").alias("resize_height"),
    )
