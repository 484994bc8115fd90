"""Slots for codec and metric plug-ins, run per Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sizewise.dims import FORMATS
from sizewise.session import inline_table

Codec = Callable[[bytes, int, int, int], bytes]

# Codec plug-ins by name: callable(raster bytes, width, height, setting) -> encoded bytes.
CODECS: dict[str, Codec] = {}


def register_codec(name: str, codec: Codec) -> None:
    CODECS[name] = codec


def encode(images: DataFrame, codec: str, settings: list[int], keep_bytes: bool = False) -> DataFrame:
    """Encode every raster with every setting of a codec: one row per image and setting.

    A raster goes to a Python worker once and is encoded there with all settings; nothing is shuffled. A failing
    encode becomes a row with an error and the others go on.
    """
    run = CODECS[codec]
    columns = ["image_id", "setting", "size", "success", "error"] + (["content"] if keep_bytes else [])
    schema = "image_id long, setting int, size long, success boolean, error string"
    schema += ", content binary" if keep_bytes else ""

    def encode_one(image, setting: int) -> tuple:
        try:
            out = run(image.raster, int(image.width), int(image.height), setting)
        except Exception as e:  # noqa: BLE001 - one failure must not end the batch
            return (image.image_id, setting, None, False, f"{type(e).__name__}: {e}", None)[: len(columns)]
        return (image.image_id, setting, len(out), True, None, out)[: len(columns)]

    def encode_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [encode_one(image, s) for image in batch.itertuples(index=False) for s in settings]
            yield pd.DataFrame(rows, columns=columns)

    return images.select("image_id", "width", "height", "raster").mapInPandas(encode_batches, schema)


def consistent_sizes(results: DataFrame) -> DataFrame:
    """A result whose reported size differs from its bytes is turned into a failure."""
    wrong = F.col("success") & (F.length("content") != F.col("size"))
    return results.withColumn("error", F.when(wrong, "size_mismatch").otherwise(F.col("error"))).withColumn(
        "success", F.col("success") & ~F.coalesce(wrong, F.lit(False))
    )


def measure_subset(rows: DataFrame, needs: str, keys: list[str], metric: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a costly metric on the flagged rows only and join its column ``perceptual`` back.

    A condition around a Python function would not keep Spark from calling it, hence the split.
    """
    measured = metric(rows.where(F.col(needs))).select(*keys, F.col("perceptual").alias("_measured"))
    return (
        rows.join(measured, keys, "left")
        .withColumn("perceptual", F.coalesce("_measured", "perceptual"))
        .drop("_measured")
    )


@dataclass(frozen=True)
class Backend:
    """A plug-in that takes candidates of its choice: ``can_handle`` says of which, ``process`` encodes the bytes of a file for one.

    Both get the candidate as a mapping of its columns. Of several backends that take a candidate the one of least ``priority`` has it,
    then the first by name.
    """

    name: str
    priority: int
    can_handle: Callable[[dict], bool]
    process: Callable[[bytes, dict], bytes]


# Backends by name.
BACKENDS: dict[str, Backend] = {}


def register_backend(backend: Backend) -> None:
    BACKENDS[backend.name] = backend


def dispatch(candidates: DataFrame, files: DataFrame, keep_bytes: bool = False) -> DataFrame:
    """Encode every candidate (``image_id``, ``candidate_id``, ...) by the backend that takes it, from the bytes of its file (``image_id``, ``content``).

    Returns ``image_id``, ``candidate_id``, ``backend``, ``size``, ``success``, ``error`` and, if asked for, ``content``. Every candidate
    has a row: without bytes the error is ``no_file``, without a backend ``no_backend``; an error of a backend is named and ends neither the
    batch nor the image. Files meet their candidates in one join; the bytes go to Python once, and all routing happens there.
    """
    taking = sorted(BACKENDS.values(), key=lambda b: (b.priority, b.name))
    given = candidates.columns
    rows = candidates.join(files.select("image_id", F.col("content").alias("_content")), "image_id", "left").select(*given, "_content")

    def one(candidate: dict, content) -> tuple:
        if content is None:
            return None, None, "no_file"
        chosen = None
        try:
            chosen = next((b for b in taking if b.can_handle(candidate)), None)
            if chosen is None:
                return None, None, "no_backend"
            return chosen.name, chosen.process(content, candidate), None
        except Exception as e:  # noqa: BLE001 - one failure must not end the batch
            return chosen.name if chosen else None, None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = pa.RecordBatch.from_arrays([batch.column(c) for c in given], names=given).to_pylist()
            found = [one(c, b) for c, b in zip(names, batch.column("_content").to_pylist(), strict=True)]
            out = [batch.column("image_id"), batch.column("candidate_id"), pa.array([f[0] for f in found], pa.string()),
                   pa.array([None if f[1] is None else len(f[1]) for f in found], pa.int64()),
                   pa.array([f[2] is None for f in found]), pa.array([f[2] for f in found], pa.string())]
            if keep_bytes:
                out.append(pa.array([f[1] for f in found], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names=["image_id", "candidate_id", "backend", "size", "success", "error"] + ["content"] * keep_bytes)

    ids = {f.name: f.dataType.simpleString() for f in candidates.schema}
    schema = f"image_id {ids['image_id']}, candidate_id {ids['candidate_id']}, backend string, size long, success boolean, error string"
    return rows.mapInArrow(run, schema + (", content binary" if keep_bytes else ""))


def backends(spark) -> DataFrame:
    """The backend registry as a table, in format order."""
    rows = [(name, code, f"{name.lower()}-backend", name.lower() in CODECS) for name, code, *_ in FORMATS]
    return inline_table(spark, ["format", "code", "backend", "plugged_in"], rows).orderBy("code")
