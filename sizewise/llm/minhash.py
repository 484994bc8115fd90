"""Near-duplicate texts by SuperMinHash signatures, banding, exact verification and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sizewise.llm.common import ROW_JOIN, connected_components, staged, utf8

SHINGLE = 5
#: Linked: PERCENT * union <= 100 * intersection.
PERCENT = 75
#: 32 bands of 4 slots: a pair at the threshold shares a band with probability 0.999995.
SLOTS, BANDS = 128, 32
#: Texts that are verified against each other in one piece.
BLOCK = 128
#: Shingles whose signatures are worked on together.
PIECE = 100_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_random = np.random.default_rng(20240501)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _random.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers so that all bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed shingles of texts laid out one after another, and how many each text has."""
    n_texts = len(offsets) - 1
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begins = offsets[:-1][(offsets[:-1] < len(data)) & (np.diff(offsets) > 0)]
    first[begins] = solid[begins]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n_texts, np.int64)
    breaks = np.zeros(len(data) + 1, dtype=bool)
    breaks[:-1] = ~solid | first
    breaks[-1] = True
    ends = np.flatnonzero(breaks)
    ends = ends[np.searchsorted(ends, starts, side="right")]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * _powers(_BASE, len(data)), out=sums[1:])
    word = mixed((sums[ends] - sums[starts]) * _powers(_BACK, len(data))[starts] + (ends - starts).astype(np.uint64))
    at = np.searchsorted(starts, offsets)  # the words of text i are at[i]:at[i + 1]
    counts = np.diff(at)
    full = np.zeros(len(word), dtype=np.uint64)
    for k in range(min(SHINGLE, len(word))):
        full[: len(word) - k] += word[k:] * _PLACE[k]
    full = mixed(full)
    pieces, sizes = [], np.zeros(n_texts, dtype=np.int64)
    for i in range(n_texts):
        if counts[i] >= SHINGLE:
            piece = np.unique(full[at[i]:at[i + 1] - SHINGLE + 1])
        elif counts[i]:
            whole = (word[at[i]:at[i + 1]] * _PLACE[:counts[i]]).sum(dtype=np.uint64) + np.uint64(counts[i])
            piece = mixed(np.array([whole], dtype=np.uint64))
        else:
            continue
        pieces.append(piece)
        sizes[i] = len(piece)
    return (np.concatenate(pieces) if pieces else np.zeros(0, np.uint64)), sizes


def super_minhash(elements: np.ndarray, sizes: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures of sets laid out one after another; a row of ``slots`` numbers for each.

    In step j an element draws the j-th entry of its own random permutation of the slots and a random fraction, and
    offers j plus the fraction to that slot, which keeps the smallest offer. As no later step can offer less than its
    number, a set is done when all its slots are below the next step. Steps are taken for all elements together.
    """
    signature = np.full((len(sizes), slots), np.iinfo(np.uint64).max, dtype=np.uint64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.tile(np.arange(slots, dtype=np.uint16), (len(elements), 1))
    going = np.arange(len(elements))
    for j in range(slots):
        draw = mixed(elements[going] + np.uint64((j + 1) * _BASE % 2**64))
        pick = (j + ((draw >> np.uint64(32)) * np.uint64(slots - j) >> np.uint64(32))).astype(np.int64)
        slot = order[going, pick]
        order[going, pick] = order[going, j]
        offer = (np.uint64(j) << np.uint64(56)) | (mixed(draw) >> np.uint64(8))
        np.minimum.at(signature, (owner[going], slot), offer)
        open_sets = signature.max(axis=1) >= np.uint64(j + 1) << np.uint64(56)
        going = going[open_sets[owner[going]]]
        if not len(going):
            break
    return signature


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = signature.reshape(len(signature), bands, -1)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_BASE), (len(rows), 1))
    for k in range(rows.shape[2]):
        key = mixed(key * np.uint64(3) + rows[:, :, k])
    return key.view(np.int64)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: the size of its set, a 128-bit digest of it, and its band keys."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        sizes, digests, keys = [], [], []
        lo = 0
        while lo < len(batch):  # pieces of whole texts
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + 6 * PIECE, side="right")) - 1)
            elements, size = shingle_sets(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
            ends = np.concatenate([[0], np.cumsum(size)])
            for salt in (1, 2):
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(elements + np.uint64(salt)), dtype=np.uint64)])
                digests.append((sums[ends[1:]] - sums[ends[:-1]]).view(np.int64))
            keys.append(band_keys(super_minhash(elements, size)))
            sizes.append(size)
            lo = hi
        if not sizes:
            continue
        n = np.concatenate(sizes)
        flat = np.concatenate(keys)
        offset = np.arange(len(n) + 1, dtype=np.int32) * BANDS
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(n), pa.array(np.concatenate(digests[::2])), pa.array(np.concatenate(digests[1::2])),
             pa.ListArray.from_arrays(pa.array(offset), pa.array(flat.ravel()))], names=["id", "n", "d1", "d2", "bands"])


def links_within(ids: list, elements: np.ndarray, sizes: np.ndarray) -> list[tuple]:
    """Links that join the sets as far as chains of similar sets do, one fewer than the sets of each chain.

    A text that has been reached is compared with all that have not; so a group of near copies costs few comparisons,
    and none that could join two parts is left out.
    """
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    _, element = np.unique(elements, return_inverse=True)
    marked = np.zeros(len(element) + 1, dtype=np.int64)
    waiting = sizes > 0
    found = []
    some = np.flatnonzero(waiting)
    for root in some:
        if not waiting[root]:
            continue
        waiting[root] = False
        reached = [root]
        while reached:
            x = reached.pop()
            if not waiting.any():
                return found
            marked[element[ends[x]:ends[x + 1]]] = 1
            both = np.add.reduceat(marked[element], ends[some])
            marked[element[ends[x]:ends[x + 1]]] = 0
            union = sizes[x] + sizes[some] - both
            new = some[waiting[some] & (100 * both >= PERCENT * union)]
            waiting[new] = False
            reached += list(new)
            found += [(ids[x], ids[y]) for y in new]
    return found


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each piece; the rows of a piece arrive one after another."""
    def done(piece: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(piece)
        found = links_within(rows.column("id").to_pylist(), *shingle_sets(*utf8(rows.column("text"))))
        return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.int64()),
                                           "b": pa.array([b for _, b in found], pa.int64())})

    piece: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        names = np.stack([batch.column(c).to_numpy() for c in ("group", "i", "j")], axis=1)
        cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1), len(batch)] if len(batch) else []
        for lo, hi in zip(cuts, cuts[1:]):
            if last is not None and tuple(names[lo]) != last:
                yield done(piece)
                piece = []
            last = tuple(names[lo])
            piece.append(batch.slice(lo, hi - lo))
    if piece:
        yield done(piece)


def verified_links(pieces: DataFrame) -> DataFrame:
    """``pieces``: ``group``, ``i``, ``j``, ``id``, ``text``. Links ``a``, ``b`` within each (group, i, j)."""
    dealt = pieces.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "id")
    return dealt.mapInArrow(_verify, "a long, b long")


def near_duplicates(texts: DataFrame, id_col: str = "log_id", text_col: str = "message", block: int = BLOCK) -> DataFrame:
    """The component of near-duplicate texts that each row belongs to.

    Runs on exported log messages (``log_id``, ``message``) as on any table of texts with a long id. Words are what stands
    between ASCII white space, with A-Z lower-cased. Texts are linked whose sets of five-word shingles have a Jaccard
    similarity of 0.75 or more. Returns per row ``id_col``, ``n_shingles``, ``component_id`` (smallest id reachable by links)
    and ``kept`` (the id is the component's).

    1. Equal sets are one class, stood for by its smallest id. 2. SuperMinHash signatures of the classes are cut into
    bands; classes that share a band are candidates, linked to the smallest in the band, not pairwise. 3. The texts of a
    candidate group are dealt to blocks of about ``block`` texts, each with one text that all blocks of the group share.
    Within a block, full sets decide. 4. In groups of several blocks, texts outside the largest part found so far meet all blocks of
    the group. So all pairs of a group are decided unless already connected, and only a forest of links is written.

    A text of fewer words has one shingle, all its words; a null text or one without words has none and links with nothing.
    Repeated rows get equal answers. Rows with one id and different
    texts follow their own texts, but texts whose classes that id stands for are linked. A row with a null id links with nothing; its
    component is null and it is kept. An empty table gives an empty result; further columns are ignored.
    """
    rows = texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    described = staged(rows.mapInArrow(_describe, "id long, n long, d1 long, d2 long, bands array<long>"))
    real = described.where("n > 0 AND id IS NOT NULL")
    classes = staged(real.groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"), F.min("bands").alias("bands")))

    banded = classes.select("rep", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most")
    shared = staged(shared.select("band", "least"))
    stars = banded.join(shared.hint(ROW_JOIN), "band").select(F.col("least").alias("a"), F.col("rep").alias("b")).where("a < b")
    groups = connected_components(stars.distinct()).select("id", F.col("component").alias("group"))

    sizes = groups.groupBy("group").agg(F.count(F.lit(1)).alias("size"),
                                        F.min(F.struct(F.xxhash64("id"), "id"))["id"].alias("pivot"))
    sizes = staged(sizes.withColumn("blocks", F.ceil(F.col("size") / block).cast("long")))
    members = groups.join(sizes.hint(ROW_JOIN), "group")
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    placed = members.select("id", "group", "blocks", F.when(
        (F.col("id") == F.col("pivot")) & (F.col("blocks") > 1), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    ).otherwise(F.array(own)).alias("at"))
    placed = staged(placed)
    first = placed.select("id", "group", F.explode("at").alias("i"), F.col("i").alias("j"))
    links = staged(verified_links(first.hint(ROW_JOIN).join(rows, "id")))

    large = placed.where("blocks > 1")
    if not large.isEmpty():
        labels = connected_components(links)
        parts = large.join(labels.hint(ROW_JOIN), "id", "left").select(
            "id", "group", "blocks", own.alias("j"), F.coalesce("component", "id").alias("part"))
        per_part = parts.groupBy("group", "part").agg(F.count(F.lit(1)).alias("n"))
        main = per_part.groupBy("group").agg(F.max(F.struct("n", "part"))["part"].alias("main"),
                                             F.sum("n").alias("all"), F.max("n").alias("most"))
        main = staged(main.where("all > most").select(
            "group", "main", F.ceil((F.col("all") - F.col("most")) / block).cast("long").alias("outer_blocks")))
        parts = staged(parts.join(main.hint(ROW_JOIN), "group"))
        row = F.pmod(F.xxhash64("id", F.lit(1)), F.col("outer_blocks"))
        outer = parts.where("part <> main").select("id", "group", row.alias("i"), F.explode(
            F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"))
        inner = parts.select("id", "group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("outer_blocks") - 1)).alias("i"), "j")
        second = outer.unionByName(inner).distinct()
        links = links.unionByName(staged(verified_links(second.hint(ROW_JOIN).join(rows, "id"))))

    labels = connected_components(links).withColumnRenamed("id", "rep")
    classes = staged(classes.select("n", "d1", "d2", "rep").join(labels.hint(ROW_JOIN), "rep", "left").select(
        "n", "d1", "d2", F.coalesce("component", "rep").alias("component_id")))
    found = described.drop("bands").join(classes.hint(ROW_JOIN), ["n", "d1", "d2"], "left")
    component = F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("component_id")).otherwise(F.col("id"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
