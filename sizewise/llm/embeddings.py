"""Near-duplicate vectors by sorted projection passes, as many as it takes to find planted pairs at the threshold."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sizewise.llm.common import connected_components, staged

COSINE = 0.9
#: Orders tried, how many of them one job sorts, and how many neighbours each vector meets in an order.
PASSES, PASSES_PER_JOB, WINDOW = 24, 3, 24
#: Share of probe pairs, which lie exactly at the threshold, that the orders must bring together; how many probes, and at
#: most one for how many vectors, so that probes take no places from vectors.
RECALL, PROBES, VECTORS_PER_PROBE = 0.99, 1_000, 20
#: Bits of an order: signs of random projections, the first the most significant.
BITS = 63
#: Vectors of a piece when links within a component are counted.
BLOCK = 256


def matrix(column: pa.Array) -> np.ndarray:
    """Unit rows of an Arrow list column whose lists have one length, in double precision."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def _order_keys(unit: np.ndarray, number: int) -> np.ndarray:
    """Each row's place in order ``number``: concatenated sign hashes as one number."""
    planes = np.random.default_rng([number, unit.shape[1]]).standard_normal((unit.shape[1], BITS))
    signs = (unit @ planes) >= 0
    return (signs.astype(np.int64) << np.arange(BITS - 1, -1, -1, dtype=np.int64)).sum(axis=1)


def _orders(passes: range):
    def orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                own = batch.filter(pa.array(dims == dim))
                unit = matrix(own.column("vec"))
                for number in passes:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), number, np.int32)), own.column("dim"),
                         pa.array(_order_keys(unit, number)), own.column("rep"), own.column("vec")],
                        names=["pass", "dim", "key", "rep", "vec"])

    return orders


def _neighbours(window: int, least: float):
    """Links of neighbours in a sorted partition; its first and last rows, with their places in it; and how many rows it has."""
    names = ["a", "b", "part", "at", "pass", "dim", "rep", "vec"]

    def row_of(rows: pa.Table, part: int, first: int) -> pa.RecordBatch:
        n = len(rows)
        none = pa.nulls(n, pa.int64())
        columns = [rows.column(c).combine_chunks() for c in names[4:]]
        places = [pa.array(np.full(n, part, np.int64)), pa.array(np.arange(first, first + n))]
        return pa.RecordBatch.from_arrays([none, none, *places, *columns], names=names)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        tail, n = None, 0
        for batch in batches:
            if not len(batch):
                continue
            new = pa.Table.from_batches([batch])
            if n < window:
                yield row_of(new.slice(0, window - n), here, n)
            rows = new if tail is None else pa.concat_tables([tail, new])
            a, b = pairs_in_order(rows, window, least, 0 if tail is None else len(tail))
            if len(a):
                blank = [pa.nulls(len(a), f.type) for f in row_of(new.slice(0, 0), 0, 0).schema][2:]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *blank], names=names)
            n += len(new)
            tail = rows.slice(max(0, len(rows) - window))
        if tail is not None:
            told = max(0, min(window, n) - (n - len(tail)))  # rows of the end that are rows of the beginning
            yield row_of(tail.slice(told), here, n - len(tail) + told)
            blank = [pa.nulls(1, f.type) for f in row_of(tail.slice(0, 0), 0, 0).schema]
            yield pa.RecordBatch.from_arrays([*blank[:2], pa.array([here], pa.int64()), pa.array([n], pa.int64()), *blank[4:]], names=names)

    return neighbours


def pairs_in_order(rows: pa.Table, window: int, least: float, since: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of rows at most ``window`` apart, of one pass and dimension, the later row not before ``since``."""
    ids, dims = rows.column("rep").to_numpy(), rows.column("dim").to_numpy()
    part = rows.column("pass").to_numpy().astype(np.int64) << 32 | dims
    found = [(ids[:0], ids[:0])]
    for value in np.unique(part):
        at = np.flatnonzero(part == value)
        unit = matrix(rows.column("vec").combine_chunks().take(pa.array(at)))
        for d in range(1, min(window, len(at) - 1) + 1):
            later = np.arange(max(d, int(np.searchsorted(at, since))), len(at))
            near = (unit[later] * unit[later - d]).sum(axis=1) >= least
            found.append((ids[at[later[near] - d]], ids[at[later[near]]]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _at_borders(sizes: dict[int, int], window: int):
    """Rows near the borders between partitions, once for each border at most ``window`` places away, with their place in the whole order.

    Partitions may be smaller than the window, or empty: what counts is the place in the whole order.
    """
    parts = np.array(sorted(sizes), np.int64)
    count = np.array([sizes[p] for p in parts], np.int64)
    begin = count.cumsum() - count
    borders = begin[1:]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = begin[np.searchsorted(parts, batch.column("part").to_numpy())] + batch.column("at").to_numpy()
            lo, hi = np.searchsorted(borders, at - window, side="right"), np.searchsorted(borders, at + window, side="right")
            times = hi - lo
            row = np.repeat(np.arange(len(at)), times)
            border = borders[np.arange(times.sum()) + np.repeat(lo - (times.cumsum() - times), times)]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(border), pa.array(at[row]), *[batch.column(c).take(take) for c in ("pass", "dim", "rep", "vec")]],
                                             names=["edge", "at", "pass", "dim", "rep", "vec"])

    return place


def _across_edges(window: int, least: float):
    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches, ["edge"]):
            split = int((piece.column("at").to_numpy() < piece.column("edge")[0].as_py()).sum())
            a, b = pairs_in_order(piece, window, least, split)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return across


def _pieces(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal keys."""
    piece: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        names = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
        cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1), len(batch)]
        for lo, hi in zip(cuts, cuts[1:]):
            if last is not None and tuple(names[lo]) != last:
                yield pa.Table.from_batches(piece)
                piece = []
            last = tuple(names[lo])
            piece.append(batch.slice(lo, hi - lo))
    if piece:
        yield pa.Table.from_batches(piece)


def _probes(vectors: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """Planted partners of vectors drawn by a hash of the id, as further vectors, and ``probe``, ``base``: their ids.

    A partner lies at ``cosine`` from its vector, in a random direction. Its id is below all ids of ``vectors``.
    """
    n, least = vectors.agg(F.count(F.lit(1)), F.min("rep")).first()
    count = min(PROBES, n // VECTORS_PER_PROBE)
    drawn = vectors.where("dim > 1").select("rep", "dim", "vec").orderBy(F.xxhash64("rep"), "rep").limit(count).collect() if count else []
    rng, rows = np.random.default_rng(17), []
    for k, r in enumerate(drawn):  # at most PROBES
        unit = np.array(r["vec"], np.float64)
        unit /= np.abs(unit).max()
        unit /= np.sqrt(unit @ unit)
        away = rng.standard_normal(len(unit))
        away -= (away @ unit) * unit
        inside = min(1.0, cosine + 1e-6)  # not lost to rounding
        vec = inside * unit + math.sqrt(1 - inside * inside) * away / np.sqrt(away @ away)
        rows.append((min(least, 0) - 1 - k, r["rep"], r["dim"], vec.tolist()))
    spark = vectors.sparkSession
    made = spark.createDataFrame(rows, "probe long, base long, dim int, vec array<double>")
    vec = F.col("vec").cast(vectors.schema["vec"].dataType)
    return made.select(F.col("probe").alias("rep"), "dim", vec.alias("vec")), made.select("probe", "base")


def _recall(links: DataFrame, ids: DataFrame, least: float) -> float:
    """The share of probes that links bring to their vector, or else into its component; 1 without probes."""
    total = ids.count()
    if not total:
        return 1.0
    share = links.join(F.broadcast(ids), [F.col("a") == F.col("probe"), F.col("b") == F.col("base")]).count() / total
    if share >= least:
        return share
    # Among many near copies a vector meets others of its component rather than its own partner.
    parts = connected_components(links)
    of = lambda c: F.broadcast(ids).join(parts, F.col("id") == F.col(c)).select("probe", "component")
    return of("probe").join(of("base"), ["probe", "component"]).count() / total


def window_links(vectors: DataFrame, passes: int = PASSES, window: int = WINDOW, cosine: float = COSINE,
                 recall: float = RECALL) -> DataFrame:
    """Verified links ``a``, ``b`` between neighbours of any order. ``vectors``: ``rep``, ``dim``, ``vec``.

    At least ``passes`` orders are tried. How likely an order brings a pair together falls with the number of vectors and
    with how alike they all are, so planted pairs at ``cosine`` go through the same orders, and further orders are
    tried until ``recall`` of them are found. Links of the planted vectors are left out.
    """
    probes, ids = _probes(vectors, cosine)
    ids = staged(ids)
    rows = staged(vectors.select("rep", "dim", "vec").unionByName(probes))
    links, done, wanted = None, 0, passes
    while done < wanted:
        found = [links] if links is not None else []
        for lo in range(done, wanted, PASSES_PER_JOB):
            found += _links_of(rows, range(lo, min(lo + PASSES_PER_JOB, wanted)), window, cosine)
        both = reduce(DataFrame.unionByName, found).where("a <> b")
        links = staged(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        done, share = wanted, _recall(links, ids, recall)
        if share < recall:  # as many more as the share found so far lets expect, at most as many as there were
            more = done * (math.log(1 - recall) / math.log(1 - share) - 1) if 0 < share else done
            wanted += PASSES_PER_JOB * max(1, math.ceil(min(more, done) / PASSES_PER_JOB))
    if links is None:
        return rows.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    return links.join(F.broadcast(ids), F.col("a") == F.col("probe"), "left_anti").join(
        F.broadcast(ids), F.col("b") == F.col("probe"), "left_anti")


def _links_of(rows: DataFrame, numbers: range, window: int, cosine: float) -> list[DataFrame]:
    """Links that some orders bring, within partitions and across their edges."""
    vec = rows.schema["vec"].dataType.simpleString()
    schema = f"a long, b long, part long, at long, pass int, dim int, rep long, vec {vec}"
    ordered = rows.mapInArrow(_orders(numbers), f"pass int, dim int, key long, rep long, vec {vec}")
    ordered = ordered.repartitionByRange("pass", "dim", "key", "rep").sortWithinPartitions("pass", "dim", "key", "rep")
    met = staged(ordered.mapInArrow(_neighbours(window, cosine), schema))
    sizes = {r["part"]: r["at"] for r in met.where("part IS NOT NULL AND rep IS NULL").select("part", "at").collect()}  # a row per partition
    near = met.where("rep IS NOT NULL").select("part", "at", "pass", "dim", "rep", "vec").mapInArrow(
        _at_borders(sizes, window), f"edge long, at long, pass int, dim int, rep long, vec {vec}")
    edges = near.repartition("edge").sortWithinPartitions("edge", "at")
    return [met.where("a IS NOT NULL").select("a", "b"), edges.mapInArrow(_across_edges(window, cosine), "a long, b long")]


def _with_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = np.asarray(pa.compute.list_value_length(batch.column("vec")))
        for dim in np.unique(dims):
            own = batch.filter(pa.array(dims == dim))
            unit = matrix(own.column("vec"))
            ends = pa.array(np.arange(len(own) + 1, dtype=np.int32) * int(dim))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.ListArray.from_arrays(ends, pa.array(unit.ravel()))],
                                             names=[*own.schema.names, "unit"])


def _count_links(least: float):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches, ["component", "i", "j"]):
            outer = piece.column("outer").to_numpy(zero_copy_only=False)
            unit = matrix(piece.column("vec").combine_chunks())
            ids, copies = piece.column("id").to_numpy(), piece.column("copies").to_numpy()
            core = piece.column("core").to_numpy(zero_copy_only=False)
            linked = unit[outer] @ unit[~outer].T >= least
            to_members = linked @ copies[~outer]
            to_core = copies[outer] @ linked * core[~outer]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([ids[outer], ids[~outer]])),
                 pa.array(np.concatenate([to_members, to_core]).astype(np.int64))], names=["id", "links"])

    return count


def link_counts(vectors: DataFrame, components: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """``id`` and ``links``: how many vectors of its component, itself and all copies included, each class is linked to.

    Two vectors whose angles to the centre of their component add up to no more than the angle of the threshold are
    linked without a look at the pair, so those within half of it, the core, are only counted. The others meet all vectors of their component in blocks.
    """
    half = math.acos(cosine) / 2 - 1e-7
    vec = vectors.schema["vec"].dataType.simpleString()
    members = vectors.join(components.withColumnRenamed("id", "rep"), "rep").select(
        F.col("rep").alias("id"), "component", "copies", "vec")
    members = staged(members.mapInArrow(_with_unit, f"id long, component long, copies long, vec {vec}, unit array<double>"))
    sums = members.select("component", F.posexplode("unit").alias("k", "x")).groupBy("component", "k").agg(F.sum("x").alias("x"))
    centre = sums.groupBy("component").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("centre"))
    centre = staged(centre)
    joined = members.join(centre, "component")
    dot = F.aggregate(F.zip_with("unit", "centre", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate("centre", F.lit(0.0), lambda s, x: s + x * x))
    core = F.coalesce(F.acos(F.least(F.lit(1.0), dot / norm)) <= half, F.lit(False))
    members = staged(joined.select("id", "component", "copies", "vec", core.alias("core")))
    sizes = staged(members.groupBy("component").agg(
        F.sum(F.when(F.col("core"), F.col("copies")).otherwise(0)).alias("core_copies"),
        F.count(F.lit(1)).alias("n"), F.sum((~F.col("core")).cast("long")).alias("n_outer")))
    counted = members.where("core").join(sizes, "component").select("id", F.col("core_copies").alias("links"))

    blocks = sizes.where("n_outer > 0").select(
        "component", F.ceil(F.col("n") / block).cast("long").alias("nj"), F.ceil(F.col("n_outer") / block).cast("long").alias("ni"))
    mixed = members.join(blocks, "component")
    zero = F.lit(0).cast("long")
    outer = mixed.where(~F.col("core")).select(
        "component", F.pmod(F.xxhash64("id", F.lit(1)), F.col("ni")).alias("i"),
        F.explode(F.sequence(zero, F.col("nj") - 1)).alias("j"), "id", "copies", "core", F.lit(True).alias("outer"), "vec")
    inner = mixed.select(
        "component", F.explode(F.sequence(zero, F.col("ni") - 1)).alias("i"), F.pmod(F.xxhash64("id"), F.col("nj")).alias("j"),
        "id", "copies", "core", F.lit(False).alias("outer"), "vec")
    pieces = outer.unionByName(inner).repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "outer", "id")
    further = pieces.mapInArrow(_count_links(cosine), "id long, links long")
    return counted.unionByName(further).groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicate_vectors(images: DataFrame, id_col: str = "image_id", vector_col: str = "embedding", cosine: float = COSINE,
                           passes: int = PASSES, window: int = WINDOW) -> DataFrame:
    """Links images whose vectors have a cosine of ``cosine`` or more, and the components of those links.

    Runs on profiled images (``image_id``) that carry a vector; the id is a long. Returns per row ``id_col``, ``n_links``,
    ``component_id`` (smallest id reachable by links) and ``kept`` (the id is the component's).

    Equal vectors are one class, stood for by its smallest id. In each pass the classes are sorted by concatenated hashes,
    signs of random projections, and each is compared in double precision with its ``window`` neighbours before, over the
    edges of partitions as well; ``passes`` is the least number, and more follow until RECALL of planted pairs at ``cosine``
    are found. Components are those of the links of all passes. Links inside a component are then counted
    exactly, also between vectors that no window brought together; no list of pairs of a component is made.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, nor do vectors of
    different lengths with each other. Of rows that repeat an id one counts, that with the smallest hash; the others link with nothing.
    A row with a null id links with nothing, its component is null and it is kept. Further columns are ignored.
    """
    vec = F.col(vector_col)
    good = vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(
        vec, lambda x: x != 0)
    rows = images.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"), F.coalesce(good, F.lit(False)).alias("good"),
                         F.xxhash64(vec).alias("h1"), F.xxhash64(F.lit("second"), vec).alias("h2"))
    real = rows.where("good AND id IS NOT NULL")
    chosen = real.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("h")).select("id", "h.h1", "h.h2")
    classes = chosen.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = staged(classes)
    vectors = staged(real.join(classes, ["h1", "h2"]).where("id = rep").select(
        "rep", "copies", F.size("vec").alias("dim"), "vec").dropDuplicates(["rep"]))

    components = connected_components(window_links(vectors, passes, window, cosine))
    counts = link_counts(vectors, components, cosine)
    classes = classes.join(components.withColumnRenamed("id", "rep"), "rep", "left").join(
        counts.withColumnRenamed("id", "rep"), "rep", "left").select(
        "h1", "h2", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("links", "copies") - 1).alias("n_links"))
    per_id = chosen.join(staged(classes), ["h1", "h2"])
    # One row of each id and vector carries the links; a repeated row says the same.
    found = rows.select("id", "h1", "h2", "good").join(per_id, ["id", "h1", "h2"], "left")
    component = F.when(F.col("good"), F.coalesce("component_id", "id")).otherwise(F.col("id"))
    return found.select(F.col("id").alias(id_col), F.when(F.col("good"), F.coalesce("n_links", F.lit(0))).otherwise(0)
                        .cast("long").alias("n_links"), component.alias("component_id"),
                        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
