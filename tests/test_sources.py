"""Real files: images, history, catalogues, logs, decisions, codecs."""

import json
import os
import zlib

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sizewise import datasets as D
from sizewise.functions import headers, paths
from sizewise.plans import decide as decisions
from sizewise.plans import profiles, reports
from sizewise.sources import codecs, files, records, results
from tests.png_files import png_bytes


def png(width, height, seed, gray=False):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 256, (height, width, 4)).astype(np.uint8)
    return png_bytes(a.tobytes(), width, height), a


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    images = {}
    for seed, (name, w, h) in enumerate([("a.png", 5, 3), ("sub/B.PNG", 300, 20), ("c.jpg", 4, 4)]):
        data, images[name] = png(w, h, seed)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "broken.png").write_bytes(b"\x89PNG\r\n\x1a\nnothing more")
    (tmp_path / "notes.txt").write_text("not an image")
    return tmp_path, images


def test_discovery(spark, folder):
    root, _ = folder
    found = {r.path.rsplit("/", 1)[1] for r in files.discover_files(spark, str(root)).collect()}
    assert found == {"a.png", "B.PNG", "c.jpg", "broken.png"}
    flat = {r.path.rsplit("/", 1)[1] for r in files.discover_files(spark, str(root), recursive=False).collect()}
    assert flat == {"a.png", "c.jpg", "broken.png"}
    plan = files.discover_files(spark, str(root))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_content_and_header(spark, folder):
    root, images = folder
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.read_files(spark, str(root)).withColumn("h", paths.png_header(F.col("content"))).collect()}
    assert (rows["c.jpg"].ext_format, rows["c.jpg"].real_format) == ("JPEG", "PNG")
    assert rows["a.png"].h.asDict() == {"width": 5, "height": 3, "raw_size": 60}
    assert rows["broken.png"].h is None
    audit = files.extension_audit(files.read_files(spark, str(root)).select("path", "content"))
    fixed = {r.path.rsplit("/", 1)[1]: r.renamed_path for r in audit.collect()}
    assert fixed["c.jpg"].endswith("/c.png") and fixed["a.png"] is None


def test_decoded_pixels(spark, folder):
    root, images = folder
    decoded = files.read_images(spark, str(root)).where("path LIKE '%.png' OR path LIKE '%.PNG' OR path LIKE '%.jpg'")
    assert decoded.where("error = 'undecodable'").count() == 1
    for name in images:
        a = images[name]
        got = np.zeros_like(a)
        one = decoded.where(F.col("path").endswith(name))
        for r in files.explode_pixels(one).collect():
            got[r.y, r.x] = (r.r, r.g, r.b, r.a)
        assert (got == a).all(), name


def test_preview_while_exploding(spark, folder):
    root, images = folder
    one = files.read_images(spark, str(root)).where(F.col("path").endswith("B.PNG"))
    a = images["sub/B.PNG"]
    rows = files.explode_pixels(one, side=256).collect()
    assert len(rows) == 256 * 17
    for r in rows[::97]:
        sx, sy = int((r.x + 0.5) * 300 / 256), int((r.y + 0.5) * 20 / 17)
        assert (r.r, r.g, r.b, r.a) == tuple(a[sy, sx])


def test_profiles_of_real_files(spark, folder):
    root, _ = folder
    images = files.read_images(spark, str(root)).where("error IS NULL")
    listed = files.discover_files(spark, str(root)).withColumnRenamed("path", "image_id")
    sizes = images.select(F.col("path").alias("image_id"), "width", "height")
    table = listed.join(sizes, "image_id").select("image_id", F.col("ext_format").alias("format"), "width", "height", F.col("length").alias("file_size"))
    p = profiles.build_profiles(table, files.explode_pixels(images)).collect()
    assert len(p) == 3 and all(r.color_model == "Rgba" and r.complexity > 0.2 for r in p)


def history(spark, n):
    return spark.range(n).select(
        F.col("id"), F.date_format(F.timestamp_seconds(F.col("id") + 1700000000), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.lit(1).alias("files_processed"), F.lit(0).alias("files_failed"), F.lit("auto:WEB").alias("profile_name"),
        (F.col("id") * 10).alias("original_size"), (F.col("id") * 5).alias("output_size"), F.lit(3).alias("duration_ms"),
    )


def test_history_round_trip(spark, tmp_path):
    log = str(tmp_path / "history")
    records.append_history(history(spark, 30), log)
    records.append_history(history(spark, 1).withColumn("id", F.lit(99)).withColumn("timestamp", F.lit("")), log)
    (tmp_path / "history" / "part-hand.json").write_text('{"id": 7\n\nnot json\n{"id": "x"}\n')
    rows = records.latest_history(spark, log, 5).collect()
    assert [r.id for r in rows] == [99, 29, 28, 27, 26]
    assert records.read_history(spark, log).count() == 31
    records.compact_history(spark, log, str(tmp_path / "compact"), 10)
    assert sorted(r.id for r in records.read_history(spark, str(tmp_path / "compact")).collect()) == [*range(21, 30), 99]
    records.remove_history(spark, log, str(tmp_path / "removed"), spark.createDataFrame([(0,), (1,)], "id long"))
    assert records.read_history(spark, str(tmp_path / "removed")).count() == 29
    records.clear_history(spark, str(tmp_path / "empty"))
    assert records.read_history(spark, str(tmp_path / "empty")).count() == 0
    totals = reports.history_totals(records.read_history(spark, log)).first()
    assert (totals.total_runs, totals.total_files_processed) == (31, 31)


def test_catalogues(spark, tmp_path):
    profile = {"name": "Mine", "kind": "Custom", "jpeg_quality": 80, "webp_quality": 80, "avif_quality": 50, "metadata_mode": "Keep"}
    docs = {
        "a": {"profiles": [profile, {**profile, "name": "Odd", "kind": "Quality"}], "default_name": "Mine"},
        "b": {"profiles": [{**profile, "name": "Web", "kind": "Web"}], "default_name": "Gone"},
        "c": {"profiles": []},
    }
    for name, doc in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "d.json").write_text("{ broken")
    catalogs = records.read_catalogs(spark, str(tmp_path))
    rows = {r.path[-6]: r for r in catalogs.collect()}
    assert [p.name for p in rows["a"].profiles] == ["Mine"] and rows["a"].default_name == "Mine"
    assert rows["b"].default_name == "Web" and rows["c"].profiles == [] and rows["d"].profiles is None
    chosen = {r.path[-6]: r.default_name for r in records.set_default(catalogs, F.lit("MINE")).collect()}
    assert chosen == {"a": "MINE", "b": "Web", "c": "Web", "d": "Web"}
    assert {(r.name, r.is_default) for r in records.catalog_profiles(catalogs).collect()} == {("Mine", True), ("Web", True)}


def test_logs_and_decisions_are_written_once(spark, sf_dir, tmp_path):
    logs = D.logs(spark, sf_dir)
    records.export_logs(logs, str(tmp_path / "logs"))
    lines = spark.read.text(str(tmp_path / "logs"))
    assert lines.count() == logs.count()
    assert lines.where("value RLIKE '^[0-9-]{10} [0-9:]{8} \\\\[(INFO|WARN|ERROR)\\\\]' OR value LIKE 'at %'").count() == logs.count()
    decided = decisions.decide(D.measurements(spark, sf_dir))
    records.write_decisions(decided, str(tmp_path / "decisions"))
    assert spark.read.parquet(str(tmp_path / "decisions")).count() == decided.count()
    with pytest.raises(AnalysisException):
        records.write_decisions(decided, str(tmp_path / "decisions"))


def test_failures_stay_rows(spark, sf_dir):
    def picky(raster, width, height, setting):
        if setting == 2:
            raise ValueError("no")
        return zlib.compress(raster, setting)

    codecs.register_codec("picky", picky)
    images = D.read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("image_id"), F.lit(1).alias("width"), F.lit(1).alias("height"), F.col("text").cast("binary").alias("raster"))
    out = codecs.encode(images, "picky", [1, 2, 9], keep_bytes=True)
    assert out.count() == 3 * images.count()
    assert out.where("NOT success").select("error").distinct().collect()[0].error == "ValueError: no"
    wrong = codecs.consistent_sizes(out.withColumn("size", F.col("size") + 1))
    assert wrong.where("success").count() == 0


def test_metric_runs_on_the_flagged_rows_only(spark):
    rows = spark.createDataFrame([(1, True, None), (2, False, 0.7), (3, False, None)], "image_id long, needs boolean, perceptual double")
    out = codecs.measure_subset(rows, "needs", ["image_id"], lambda d: d.withColumn("perceptual", F.lit(1.25)))
    assert {r.image_id: r.perceptual for r in out.collect()} == {1: 1.25, 2: 0.7, 3: None}


def test_backend_registry(spark):
    codecs.register_codec("png", lambda raster, width, height, setting: raster)
    rows = codecs.backends(spark).collect()
    assert [r.format for r in rows] == ["PNG", "JPEG", "WEBP", "AVIF", "GIF", "BMP", "TIFF"] and rows[0].plugged_in


def test_sizes_of_all_formats_and_odd_bytes(spark):
    box = lambda kind, body: (8 + len(body)).to_bytes(4, "big") + kind + body
    side = lambda w, h: b"\0\0\0\0" + w.to_bytes(4, "big") + h.to_bytes(4, "big")
    frame = b"\xff\xc0\x00\x11\x08\x00\x07\x00\x09"
    heads = {
        "many segments": (b"\xff\xd8" + b"\xff\xe1\x00\x04ab" * 80 + frame, (9, 7)),
        "too many segments": (b"\xff\xd8" + b"\xff\xe1\x00\x04ab" * 200 + frame, None),
        "no length": (b"\xff\xd8\xff\xe1\x00\x00" + frame, None),
        "scan first": (b"\xff\xd8\xff\xda\x00\x04ab" + frame, None),
        "restart marker": (b"\xff\xd8\xff\xd0" + frame, (9, 7)),
        "cut off": (b"\xff\xd8" + frame[:-1], None),
        "big tiff": (b"MM\0\x2a\0\0\0\x08\0\x02\x01\x00\0\x04\0\0\0\x01\0\x01\0\0\x01\x01\0\x03\0\0\0\x01\0\x05\0\0", (65536, 5)),
        "tiff without height": (b"MM\0\x2a\0\0\0\x08\0\x01\x01\x00\0\x04\0\0\0\x01\0\x01\0\0", None),
        "tiff without directory": (b"II\x2a\0\x08\0\0\0\0\0", None),
        "old bmp": (b"BM" + bytes(12) + b"\x0c\0\0\0\x05\0\x06\0", (5, 6)),
        "long box": (box(b"ftyp", b"avif") + b"\0\0\0\x01free" + (20).to_bytes(8, "big") + b"1234"
                     + box(b"meta", b"\0\0\0\0" + box(b"iprp", box(b"ipco", box(b"ispe", side(3, 4)) + box(b"ispe", side(1, 2))))), (3, 4)),
        "box of no size": (box(b"ftyp", b"avif") + b"\0\0\0\0mdat", None),
        "no side": (b"GIF89a\0\0\x05\0", None),
        "empty": (b"", None),
        "text": (b"just text", None),
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, (v, _) in heads.items()] + [("null", None)], "name string, content binary")
    got = {r.name: (r.s.width, r.s.height) if r.s else None for r in df.select("name", headers.image_size(F.col("content")).alias("s")).collect()}
    assert got == {k: v for k, (_, v) in heads.items()} | {"null": None}


def test_files_over_the_guard_are_not_decoded(spark, folder):
    root, _ = folder
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.read_images(spark, str(root), max_pixels=1000).collect()}
    assert (rows["B.PNG"].error, rows["B.PNG"].width, rows["B.PNG"].data) == ("too_many_pixels", 300, None)
    assert rows["a.png"].error is None and rows["a.png"].data and len(rows) == 5 and rows["broken.png"].error == "undecodable"
    (root / "huge.png").write_bytes(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR\0\1\0\0\0\1\0\0\x08\x06\0\0\0")
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.read_images(spark, str(root)).collect()}
    assert (rows["huge.png"].error, rows["huge.png"].width) == ("too_many_pixels", 65536)  # the decoder would have called it undecodable
    assert rows["B.PNG"].error is None and len(rows) == 6


def test_runs_without_an_id_are_kept(spark, tmp_path):
    runs = [(None, "2024-01-01T00:00:00Z", "a"), (None, "2024-01-01T00:00:00Z", "a"), (7, None, "b")]
    rows = spark.createDataFrame(runs, "id long, timestamp string, profile_name string")
    records.append_history(rows, str(tmp_path / "h"))
    records.append_history(rows.drop("id"), str(tmp_path / "h"))
    kept = records.read_history(spark, str(tmp_path / "h")).collect()
    assert len(kept) == 6 and len({r.id for r in kept}) == 6 and sum(r.id == 7 for r in kept) == 1


def test_a_store_of_results_measures_each_key_once_and_goes_on_after_a_failure(spark, tmp_path):
    store, asked = str(tmp_path / "store"), []
    rows = [(i % 40, f"c{i}", f"JPEG|{i % 3}", i) for i in range(300)]
    keyed = spark.createDataFrame(rows, "image_id long, candidate_id string, encode_key string, size long")

    def measure(wanted):
        asked.append([(r.image_id, r.encode_key) for r in wanted.collect()])
        if len(asked) == 2:
            raise RuntimeError("the run is ended")
        return wanted.withColumn("bytes", F.col("size") * 10)

    with pytest.raises(RuntimeError):
        results.measure_once(keyed, store, "bytes long", measure, waves=3)
    done = len(asked[0])
    found, counts = results.measure_once(keyed, store, "bytes long", measure, waves=3)
    assert counts == {"known": done, "measured": 120 - done} and 0 < done < 120
    measured = asked[0] + [k for wave in asked[2:] for k in wave]
    assert len(measured) == len(set(measured)) == 120  # the wave that failed was measured again, the first one was not
    first = {}
    for i, c, k, s in rows:
        first.setdefault((i, k), (c, s)) if (i, k) not in first or first[i, k][0] <= c else first.update({(i, k): (c, s)})
    assert {(r.image_id, r.encode_key, r.candidate_id): r.bytes for r in found.collect()} == {(i, k, c): first[i, k][1] * 10 for i, c, k, _ in rows}
    again, counts = results.measure_once(keyed, store, "bytes long", measure)
    assert counts == {"known": 120, "measured": 0} and again.count() == 300
    assert results.measure_once(keyed.limit(0), str(tmp_path / "none"), "bytes long", measure)[1] == {"known": 0, "measured": 0}


def test_candidates_are_dispatched_to_the_backend_that_takes_them(spark, monkeypatch):
    monkeypatch.setattr(codecs, "BACKENDS", {})

    def half(content, candidate):
        return content[:len(content) // 2]

    def broken(content, candidate):
        raise OSError(f"cannot write {candidate['target']}")

    for backend in (codecs.Backend("z-small", 1, lambda c: c["target"] == "WEBP" and c["quality"] is not None, half),
                    codecs.Backend("any", 5, lambda c: c["target"] in ("WEBP", "PNG"), lambda content, c: content + b"!"),
                    codecs.Backend("a-broken", 5, lambda c: c["target"] == "AVIF" or c["quality"] / 1 > 99, broken)):
        codecs.register_backend(backend)
    candidates = [(1, "a", "WEBP", 80), (1, "b", "WEBP", None), (1, "c", "PNG", 90), (1, "d", "AVIF", 50), (1, "e", "GIF", 10),
                  (2, "f", "PNG", 1), (3, "g", "WEBP", 7), (3, "h", "GIF", None)]
    rows = spark.createDataFrame(candidates, "image_id long, candidate_id string, target string, quality int")
    files_table = spark.createDataFrame([(1, bytearray(b"12345678")), (3, bytearray(b"xy"))], "image_id long, content binary")
    got = {r.candidate_id: (r.backend, r.size, r.success, r.error) for r in codecs.dispatch(rows, files_table).collect()}
    assert got == {
        "a": ("z-small", 4, True, None), "b": (None, None, False, got["b"][3]), "c": ("any", 9, True, None),
        "d": ("a-broken", None, False, "OSError: cannot write AVIF"), "e": (None, None, False, "no_backend"), "f": (None, None, False, "no_file"),
        "g": ("z-small", 1, True, None), "h": (None, None, False, got["h"][3]),
    }
    assert got["b"][3].startswith("TypeError") and got["h"][3].startswith("TypeError")  # a backend that cannot even tell
    kept = codecs.dispatch(rows.where("candidate_id = 'a'"), files_table, keep_bytes=True).first()
    assert bytes(kept.content) == b"1234"
    assert codecs.dispatch(rows.limit(0), files_table).count() == 0


def test_each_document_gets_a_file_of_its_own_from_several_tasks(spark, tmp_path):
    ids = [(i,) for i in range(40)] + [(3,), (None,), (None,)]
    docs = spark.createDataFrame(ids, "k long").coalesce(1).select("k", F.concat(F.lit("text "), F.coalesce("k", F.lit(-1))).alias("doc"))
    records.write_documents(docs, "k", "doc", f"{tmp_path}/docs")
    files = sorted(f for f in os.listdir(f"{tmp_path}/docs") if f.startswith("part-"))
    texts = sorted(open(f"{tmp_path}/docs/{f}").read().strip() for f in files)
    assert texts == sorted(f"text {i}" for i in range(-1, 40))  # what comes twice is written once
    assert len({f.split("-")[1] for f in files}) > 4  # tasks, though one read the rows
