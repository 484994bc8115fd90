"""Phrases of log messages, mined with weighted acyclic automata of their n-grams."""

from __future__ import annotations

import re
import struct
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sizewise.llm.common import staged, utf8
from sizewise.llm.minhash import mixed

#: Bytes that part pieces, and blanks that part words.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
MOST_WORDS = 4
MIN_COUNT, TOP = 30, 2_000
#: A shorter phrase goes if this percentage of its occurrences lies in one longer phrase.
WITHIN = 80
UNKNOWN = "und"
#: Bytes of text in one shard, n-grams that a task holds before it sends them on, and bytes of text per range of prefixes.
SHARD_BYTES, HELD, RANGE_BYTES = 4 << 20, 1 << 20, 8 << 20
#: Bits of the filter that tells which n-grams may be frequent.
FILTER_BITS = 1 << 25
#: Texts are looked at in at most so many places, of so many characters, to find bounds between ranges.
PLACES, PLACE_CHARS, BOUND_CHOICE = 64, 200, 64

_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)], _KIND[list(BREAKS)] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
Path = tuple[bytes, ...]


@dataclass
class Level:
    """The arcs of one depth of a trie: the node above, the word (its rank among the words), and how often the n-gram occurs
    that ends here. Arcs are ordered by node and word; the place of an arc is the number of the node it leads to."""

    above: np.ndarray
    word: np.ndarray
    count: np.ndarray


@dataclass
class Trie:
    """n-grams in order. ``words`` are sorted; the first word of each n-gram is its group."""

    words: pa.Array
    levels: list[Level]

    @property
    def size(self) -> int:
        return sum(len(level.word) for level in self.levels)


def grow(word_at: Callable[[int, np.ndarray], np.ndarray], reach: np.ndarray, words: pa.Array, counted: int) -> tuple[Trie, np.ndarray]:
    """The trie of rows of words; ``word_at(depth, rows)`` gives ranks, ``reach`` the length of each row. From depth ``counted`` on,
    each beginning of a row counts. Also returns the node that ends each row."""
    levels, rows, above = [], np.arange(len(reach)), np.zeros(len(reach), np.int64)
    last, width = np.zeros(len(reach), np.int64), max(1, len(words))
    for depth in range(1, int(reach.max(initial=0)) + 1):
        use = reach[rows] >= depth
        rows, above = rows[use], above[use]
        keys, above, n = np.unique(above * width + word_at(depth, rows), return_inverse=True, return_counts=True)
        levels.append(Level(keys // width, keys % width, n if depth >= counted else np.zeros(len(keys), np.int64)))
        last[rows] = above
    return Trie(words, levels), last


def union(tries: list[Trie]) -> Trie:
    """All n-grams of several tries, with the sums of their counts."""
    if len(tries) == 1:
        return tries[0]
    every = pa.concat_arrays([t.words for t in tries]).dictionary_encode()
    order = pc.sort_indices(every.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    ranks = rank[every.indices.to_numpy()]
    ends = np.cumsum([0, *[len(t.words) for t in tries]])
    words, width = every.dictionary.take(order), max(1, len(order))
    levels, nodes = [], [np.zeros(1, np.int64) for _ in tries]
    for depth in range(max(len(t.levels) for t in tries)):
        there = [i for i, t in enumerate(tries) if depth < len(t.levels)]
        given = [tries[i].levels[depth] for i in there]
        keys = np.concatenate([nodes[i][g.above] * width + ranks[ends[i]:][g.word] for i, g in zip(there, given)])
        keys, inverse = np.unique(keys, return_inverse=True)
        count = np.zeros(len(keys), np.int64)
        np.add.at(count, inverse, np.concatenate([g.count for g in given]))
        cut = np.cumsum([0, *[len(g.word) for g in given]])
        for i, lo, hi in zip(there, cut, cut[1:]):
            nodes[i] = inverse[lo:hi]
        levels.append(Level(keys // width, keys % width, count))
    return Trie(words, levels)


def frequent(trie: Trie, least: int) -> Trie:
    """The n-grams that occur ``least`` times or more."""
    levels: list[Level] = []
    needed = np.zeros(0, bool)
    for depth in range(len(trie.levels) - 1, -1, -1):
        level = trie.levels[depth]
        keep = level.count >= least
        keep[:len(needed)] |= needed
        below = levels[0] if levels else None
        if below is not None:
            below.above = (np.cumsum(keep) - 1)[below.above]
        levels.insert(0, Level(level.above[keep], level.word[keep], np.where(level.count >= least, level.count, 0)[keep]))
        needed = np.zeros(len(trie.levels[depth - 1].word) if depth else 0, bool)
        if depth:
            needed[level.above[keep]] = True
    return Trie(trie.words, [level for level in levels if len(level.word)])


def parted(trie: Trie, bounds: list[Path]) -> Iterator[tuple[int, Trie]]:
    """The n-grams of each range of their order, by its number. Beginnings that lie in a range before are there without counts."""
    width, depths = max(1, len(trie.words)), len(trie.levels)
    keys = [level.above * width + level.word for level in trie.levels]
    child = [np.searchsorted(level.above, np.arange(len(keys[d]) + 1)) for d, level in enumerate(trie.levels[1:])]
    asked = sorted({w for b in bounds for w in b})
    words = trie.words.to_pylist() if bounds else []
    at = {w: bisect_right(words, w) for w in asked}
    cut = np.zeros((len(bounds) + 2, depths), np.int64)
    cut[-1] = [len(k) for k in keys]
    for number, bound in enumerate(bounds):
        node, same = 0, True
        for d in range(depths):
            if same and d < len(bound):
                above = at[bound[d]]
                known = above > 0 and words[above - 1] == bound[d]
                key = node * width + above - known
                node = int(np.searchsorted(keys[d], key))
                same = known and node < len(keys[d]) and keys[d][node] == key
                cut[number + 1, d] = node + (same and d + 1 < len(bound))  # a beginning of the bound lies before it
            else:
                node, same = int(child[d - 1][node]), False
                cut[number + 1, d] = node
    for number in range(len(bounds) + 1):
        levels: list[Level] = []
        lo = hi = 0
        for d in range(depths - 1, -1, -1):
            own = cut[number, d], cut[number + 1, d]
            if levels and len(levels[0].word):
                above = trie.levels[d + 1].above
                lo, hi = int(above[lo]), int(above[hi - 1]) + 1
                lo, hi = (min(lo, own[0]), max(hi, own[1])) if own[0] < own[1] else (lo, hi)
                levels[0].above = levels[0].above - lo
            else:
                lo, hi = own
                levels = []
            level = trie.levels[d]
            count = level.count[lo:hi].copy()
            count[:max(0, own[0] - lo)] = 0
            count[max(0, own[1] - lo):] = 0
            levels.insert(0, Level(level.above[lo:hi], level.word[lo:hi], count))
        if any(level.count.any() for level in levels):
            yield number, Trie(trie.words, levels)


class CountTransducer:
    """The minimal weighted automaton of a trie: a word leads from a state to a state, and the arc carries the count of the n-gram that it ends.

    States are frozen from the last words upward; those with equal arcs, counts included, are one.
    """

    def __init__(self, words: pa.Array, first: np.ndarray, word: np.ndarray, count: np.ndarray, target: np.ndarray):
        self.words, self.first, self.word, self.count, self.target = words, first, word, count, target

    @staticmethod
    def of(trie: Trie) -> CountTransducer:
        used = np.zeros(len(trie.words), bool)
        for level in trie.levels:
            used[level.word] = True
        rank = np.cumsum(used) - 1
        words = trie.words.filter(pa.array(used))
        first, parts, n_states = [np.zeros(1, np.int64)], [], 1  # state 0 has no arcs
        state = np.zeros(len(trie.levels[-1].word) if trie.levels else 1, np.int64)
        for depth in range(len(trie.levels) - 1, -1, -1):
            level = trie.levels[depth]
            arcs = np.stack([rank[level.word], level.count, state])
            n_above = len(trie.levels[depth - 1].word) if depth else 1
            begin = np.searchsorted(level.above, np.arange(n_above + 1))
            kept, state = _frozen(arcs, begin)
            sizes = (begin[1:] - begin[:-1])[kept]
            parts.append(arcs[:, _spread(begin[kept], sizes)])
            first.append(sizes)
            state = np.where(state >= 0, state + n_states, 0)
            n_states += len(kept)
        ends = np.concatenate([[0], np.cumsum(np.concatenate(first))])
        arcs = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), np.int64)
        return CountTransducer(words, ends, *arcs)  # the last state is where n-grams begin

    def trie(self) -> Trie:
        levels, state = [], np.array([len(self.first) - 2])
        while True:
            sizes = (self.first[1:] - self.first[:-1])[state]
            if not sizes.sum():
                return Trie(self.words, levels)
            arc = _spread(self.first[:-1][state], sizes)
            levels.append(Level(np.repeat(np.arange(len(state)), sizes), self.word[arc], self.count[arc]))
            state = self.target[arc]

    def compose(self, asked: Trie) -> list[np.ndarray]:
        """The counts of all nodes of a trie of n-grams, depth by depth: it is walked along the states at the same time."""
        width = len(self.words) + 1
        known = pc.index_in(asked.words, value_set=self.words).fill_null(len(self.words)).to_numpy()
        of = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        keys = np.append(of * width + self.word, np.iinfo(np.int64).max)
        out, state = [], np.array([len(self.first) - 2])
        for level in asked.levels:
            want = state[level.above] * width + known[level.word]
            arc = np.searchsorted(keys, want)
            found = keys[arc] == want
            arc = np.where(found, arc, 0)
            out.append(np.where(found, self.count[arc], 0) if len(self.count) else np.zeros(len(arc), np.int64))
            state = np.where(found, self.target[arc], 0) if len(self.target) else np.zeros(len(arc), np.int64)
        return out

    def pack(self) -> bytes:
        data, ends = utf8(self.words)
        head = struct.pack("<3q", len(self.words), len(self.first), len(self.word))
        arrays = [np.diff(ends).astype("<i4"), np.diff(self.first, prepend=0).astype("<i4"), self.word.astype("<i4"),
                  self.count.astype("<i8"), self.target.astype("<i4"), data]
        return zstandard.compress(head + b"".join(a.tobytes() for a in arrays), 3)

    @staticmethod
    def unpack(packed: bytes) -> CountTransducer:
        raw = zstandard.decompress(packed)
        n_words, n_states, n_arcs = struct.unpack_from("<3q", raw)
        place, found = 24, []
        for dtype, n in (("<i4", n_words), ("<i4", n_states), ("<i4", n_arcs), ("<i8", n_arcs), ("<i4", n_arcs)):
            found.append(np.frombuffer(raw, dtype, n, place).astype(np.int64))
            place += found[-1].size * np.dtype(dtype).itemsize
        ends = np.concatenate([[0], found[0].cumsum()]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), n_words, [None, pa.py_buffer(ends), pa.py_buffer(raw[place:])])
        return CountTransducer(words, found[1].cumsum(), *found[2:])


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) + np.repeat(starts - (sizes.cumsum() - sizes), sizes)


def _frozen(arcs: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes with distinct arcs, and for each node which of them is its state; -1 without arcs."""
    sizes = np.diff(begin)
    state = np.full(len(sizes), -1, np.int64)
    real = np.flatnonzero(sizes)
    if not len(real):
        return real, state
    h = arcs[0].astype(np.uint64) * _STEP + arcs[1].astype(np.uint64)
    h = mixed(mixed(h) + arcs[2].astype(np.uint64))
    sums = np.add.reduceat(h, begin[:-1][real])
    _, example, kind = np.unique(sums, return_index=True, return_inverse=True)
    # Equal hashes are held against the arcs themselves.
    pattern = real[example[kind]]
    same = sizes[pattern] == sizes[real]
    check = np.flatnonzero(same)
    left, right = (_spread(begin[:-1][n[check]], sizes[real][check]) for n in (real, pattern))
    if len(left):
        equal = (arcs[:, left] == arcs[:, right]).all(axis=0)
        starts = sizes[real][check].cumsum() - sizes[real][check]
        same[check] &= np.logical_and.reduceat(equal, starts)
    odd = np.flatnonzero(~same)
    kept = np.concatenate([real[example], real[odd]])
    state[real] = kind
    state[real[odd]] = len(example) + np.arange(len(odd))
    return kept, state


def _hash_words(words: pa.Array) -> np.ndarray:
    data, ends = utf8(words)
    size = np.diff(ends)
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(1, int(size.max(initial=1))), _STEP)]))
    out = np.zeros(len(size), np.uint64)
    real = size > 0
    if real.any():
        spot = np.arange(len(data)) - np.repeat(ends[:-1], size)
        out[real] = np.add.reduceat(_BYTE[data] * powers[spot], ends[:-1][real])
    return mixed(out + size.astype(np.uint64))


def _longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of an n-gram from that of its beginning and of its last word."""
    return mixed(h * _STEP + word)


class Filter:
    """Bits at the hashes of frequent n-grams. Others may share a bit; they are counted in vain and dropped by their counts."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = h % np.uint64(len(self.bits) * 64)
        return self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) == 1


@dataclass
class Shard:
    """The words of some texts: their ranks, group, and whether a piece begins at each."""

    words: pa.Array
    rank: np.ndarray
    group: np.ndarray
    begins: np.ndarray

    @staticmethod
    def of(data: np.ndarray, offsets: np.ndarray, groups: pa.Array) -> Shard:
        kind = _KIND[data]
        inside = kind == 0
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        heads = offsets[:-1][np.diff(offsets) > 0]
        start[heads] = inside[heads]
        spot = np.flatnonzero(start)
        text = np.searchsorted(offsets, spot, side="right") - 1
        piece = np.cumsum(kind == 2)[spot]
        begins = np.ones(len(spot), bool)
        begins[1:] = (text[1:] != text[:-1]) | (piece[1:] != piece[:-1])
        ends = np.append((np.cumsum(inside) - inside)[spot], inside.sum()).astype(np.int64)
        body = _LOWER[data[inside]]
        found = pa.Array.from_buffers(pa.large_binary(), len(spot), [None, pa.py_buffer(ends), pa.py_buffer(body)])
        every = pa.concat_arrays([found, groups.cast(pa.large_binary())]).dictionary_encode()
        order = pc.sort_indices(every.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        ranks = rank[every.indices.to_numpy()]
        return Shard(every.dictionary.take(order), ranks[:len(spot)], ranks[len(spot):][text], begins)

    def grams(self, fewest: int, most: int, known: Filter | None) -> Trie:
        """The n-grams of ``fewest`` to ``most`` words, counted; ``known`` tells which of one word less may be frequent (with
        ``fewest`` - 1 words)."""
        n = len(self.rank)
        last = np.zeros(n, np.int64)  # how many words follow in the piece, up to most - 1
        follows = np.append(~self.begins[1:], False)[:n]
        run = follows.copy()
        for _ in range(most - 1):
            last += run
            run = follows & np.append(run[1:], False)[:n]
        if known is not None:
            h = _hash_words(self.words)
            sub = fewest - 1
            key = h[self.group]
            for k in range(sub):
                key = _longer(key, h[np.append(self.rank[k:], np.zeros(k, np.int64))])
            may = known(key) & (last >= sub - 1)
            good, reach = may, np.where(may, sub, 0)
            for k in range(1, most - sub + 1):
                good = good & np.append(may[k:], np.zeros(min(k, n), bool))[:n] & (last >= sub + k - 1)
                reach = np.where(good, sub + k, reach)
        else:
            reach = np.minimum(last + 1, most)
        rows = np.flatnonzero(reach >= fewest)
        at = rows

        def word_at(depth: int, use: np.ndarray) -> np.ndarray:
            return self.group[at[use]] if depth == 1 else self.rank[at[use] + depth - 2]

        return grow(word_at, reach[rows] + 1, self.words, fewest + 1)[0]


def _shards(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[Shard]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        lo = 0
        while lo < len(batch):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + shard_bytes, side="right")) - 1)
            yield Shard.of(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], batch.column("grp").slice(lo, hi - lo))
            lo = hi


def _sent(trie: Trie, bounds: list[Path]) -> Iterator[pa.RecordBatch]:
    rows = [(k, CountTransducer.of(part).pack()) for k, part in parted(trie, bounds)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([p for _, p in rows], pa.binary())],
                                         names=["range", "packed"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Trie]]:
    """Sums the transducers of each range; they arrive ordered by it."""
    now, held = None, []
    for batch in batches:
        for k, packed in zip(batch.column("range").to_pylist(), batch.column("packed"), strict=True):
            if held and k != now:
                yield now, union(held)
                held = []
            now = k
            held.append(CountTransducer.unpack(packed.as_buffer()).trie())
            if sum(t.size for t in held[1:]) > max(HELD // 4, held[0].size):
                held = [union(held)]
    if held:
        yield now, union(held)


def _bounds(rows: DataFrame, ranges: int) -> list[Path]:
    """Beginnings of n-grams that part the texts' n-grams into about equal ranges of their order, from places in the texts."""
    if ranges < 2:
        return []
    size = F.length("text")
    k = F.col("k")
    places = rows.where(size > 0).select("grp", "text", F.explode(F.sequence(F.lit(0), F.least(F.lit(PLACES - 1), size / 2000).cast("int"))).alias("k"))
    h = F.xxhash64("grp", F.lit(7), k, size, F.substring("text", 1, PLACE_CHARS))
    begin = F.when(k == 0, 1).otherwise(1 + F.pmod(h, size.cast("long")).cast("int"))
    chosen = places.select("grp", h.alias("h"), begin.alias("at"), F.substring("text", begin, F.lit(PLACE_CHARS)).alias("s")).orderBy(
        "h", "grp", "s").limit(ranges * BOUND_CHOICE)  # bounded by the number of ranges
    found = []
    for r in chosen.collect():
        given = r["s"].encode().lower()
        pieces = re.split(b"[" + re.escape(BREAKS + BLANKS) + b"]", given, maxsplit=1) if r["at"] > 1 else [b"", given]
        words = [w for w in re.split(b"[" + re.escape(BLANKS) + b"]+", re.split(b"[" + re.escape(BREAKS) + b"]", pieces[-1])[0]) if w]
        if words:
            found.append((r["grp"].encode(), *words[:MOST_WORDS]))
    found.sort()
    return sorted({found[k * len(found) // ranges] for k in range(1, ranges)}) if found else []


def count_transducers(rows: DataFrame, fewest: int, most: int, known: Filter | None, bounds: list[Path], least: int) -> DataFrame:
    """Transducers of the n-grams of ``fewest`` to ``most`` words that occur ``least`` times or more in all texts: ``range`` and ``packed``.
    With ``fewest`` 1 also a row for each group: ``grp`` and its number of words ``n``, partly summed."""
    shared = rows.sparkSession.sparkContext.broadcast(known)  # FILTER_BITS at most

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Trie] = []
        for shard in _shards(batches, SHARD_BYTES):
            held.append(shard.grams(fewest, most, shared.value))
            if sum(t.size for t in held) > HELD:
                held = [union(held)]
                if held[0].size > HELD // 2:
                    yield from _sent(held[0], bounds)
                    held = []
        if held:
            yield from _sent(union(held), bounds)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, trie in _merged(batches):
            groups, n = [], []
            if fewest == 1 and len(trie.levels) > 1:
                sums = np.zeros(len(trie.levels[0].word), np.int64)
                np.add.at(sums, trie.levels[1].above, trie.levels[1].count)
                groups, n = trie.words.take(pa.array(trie.levels[0].word)).cast(pa.string()).to_pylist(), sums.tolist()
            packed = CountTransducer.of(frequent(trie, least)).pack()
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * (len(n) + 1), pa.int64()), pa.array([*groups, None], pa.string()), pa.array([*n, None], pa.int64()),
                 pa.array([None] * len(n) + [packed], pa.binary())], names=["range", "grp", "n", "packed"])

    sent = rows.mapInArrow(build, "range long, packed binary")
    dealt = sent.repartition(len(bounds) + 1, "range").sortWithinPartitions("range")
    return staged(dealt.mapInArrow(add, "range long, grp string, n long, packed binary"))


def filter_of(transducers: DataFrame, bits: int = FILTER_BITS) -> Filter:
    """The filter of all n-grams of transducers, set on the executors; its size is fixed."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column("packed"):
                trie = CountTransducer.unpack(packed.as_buffer()).trie()
                h, key, marks = _hash_words(trie.words), None, []
                for level in trie.levels:
                    key = h[level.word] if key is None else _longer(key[level.above], h[level.word])
                    marks.append(key[level.count > 0])
                if not marks:
                    continue
                at = np.concatenate(marks) % np.uint64(bits)
                slot, inverse = np.unique(at >> np.uint64(6), return_inverse=True)
                value = np.zeros(len(slot), np.uint64)
                np.bitwise_or.at(value, inverse, np.uint64(1) << (at & np.uint64(63)))
                yield pa.RecordBatch.from_arrays([pa.array(slot.view(np.int64)), pa.array(value.view(np.int64))], names=["slot", "bits"])

    found = transducers.where("packed IS NOT NULL").select("packed").mapInArrow(mark, "slot long, bits long")
    rows = found.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toPandas()  # bits / 64 rows at most
    out = np.zeros(bits // 64, np.uint64)
    out[rows["slot"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return Filter(out)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of transducers as rows."""
    for batch in batches:
        for packed in batch.column("packed"):
            trie = CountTransducer.unpack(packed.as_buffer()).trie()
            names = trie.words.cast(pa.large_string())
            group = text = None
            for depth, level in enumerate(trie.levels):
                word = names.take(pa.array(level.word))
                if not depth:
                    group = word
                    continue
                above = pa.array(level.above)
                group = group.take(above)
                text = pc.binary_join_element_wise(text.take(above), word, pa.scalar(" ", pa.large_string())) if depth > 1 else word
                use = pa.array(level.count > 0)
                a = pa.array(level.count).filter(use)
                if len(a):
                    yield pa.RecordBatch.from_arrays([group.filter(use).cast(pa.string()), text.filter(use).cast(pa.string()),
                                                      pa.array(np.full(len(a), depth, np.int32)), a], names=["grp", "phrase", "words", "a"])


def _answers(asked: pa.Table, transducers: pa.Table) -> pa.Table:
    """The counts of the asked parts of one range."""
    groups, parts = asked.column("grp").to_pylist(), asked.column("part").to_pylist()
    paths = [[g.encode(), *p.encode().split(b" ")] for g, p in zip(groups, parts)]
    reach = np.array([len(p) for p in paths], np.int64)
    every = pa.array([w for p in paths for w in p], pa.large_binary()).dictionary_encode()
    order = pc.sort_indices(every.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    ranks, begin = rank[every.indices.to_numpy()], reach.cumsum() - reach
    trie, last = grow(lambda depth, rows: ranks[begin[rows] + depth - 1], reach, every.dictionary.take(order), MOST_WORDS + 2)
    f = np.zeros(len(paths), np.int64)
    for packed in transducers.column("packed").drop_null() if len(paths) else []:
        found = CountTransducer.unpack(packed.as_buffer()).compose(trie)
        for depth in range(1, len(found) + 1):
            here = reach == depth
            f[here] += found[depth - 1][last[here]]
    return pa.table({"grp": asked.column("grp"), "part": asked.column("part"), "f": f})


def part_counts(parts: DataFrame, transducers: DataFrame, bounds: list[Path]) -> DataFrame:
    """``f``, the count of each distinct ``grp`` and ``part``: parts go to their range and are composed with its transducers."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [(g.encode(), *p.encode().split(b" ")) for g, p in zip(batch.column("grp").to_pylist(), batch.column("part").to_pylist())]
            ranges = pa.array([bisect_right(bounds, k) for k in keys], pa.int64())
            yield pa.RecordBatch.from_arrays([ranges, batch.column("grp"), batch.column("part")], names=["range", "grp", "part"])

    asked = parts.select("grp", "part").distinct().mapInArrow(place, "range long, grp string, part string")
    there = transducers.where("packed IS NOT NULL").select("range", "packed")
    return asked.groupBy("range").cogroup(there.groupBy("range")).applyInArrow(_answers, "grp string, part string, f long")


def mine_phrases(logs: DataFrame, level: str = "level", message: str = "message", min_count: int = MIN_COUNT, top: int = TOP,
                 range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The phrases of log messages whose words keep together, ranked for each level of the log.

    Runs on log rows (``level``, ``message``) as on any table of texts with a group. A-Z are lower-cased; ``.,;:!?`` and line
    ends part a message into pieces, blanks and tabs part these into words. Within a level, phrases of two to four words that occur
    ``min_count`` times or more are candidates (``a`` occurrences). A cut after k words gives l and r, the occurrences of its two parts, and the score
    floor(2000000 * a / (l + r)); the cut of lowest score counts, the first of several. A candidate goes if a longer one that contains it has
    ``WITHIN`` per cent of its occurrences. Returns the ``top`` phrases of each level by score, a and phrase: ``level``, ``rank``,
    ``phrase``, ``a``, ``l``, ``r``, ``n`` (all words of the level), ``score``.

    1. Each shard of texts sorts its n-grams and builds a count transducer of them, in three passes: words, pairs, longer ones. A pass looks
    only at n-grams whose parts may be frequent by a filter of fixed size; since whatever is frequent has frequent parts, nothing is lost.
    2. Transducers are cut at common bounds into ranges of prefixes, and each range unites them and adds up their counts. 3. Parts of
    candidates are sent to their ranges as a trie, which is composed with the transducers.

    A null message is empty, a null level is ``und``. Messages and words are whole, however long; repeated rows count again. An empty table gives
    an empty result; further columns are ignored.
    """
    text = F.coalesce(F.col(message), F.lit(""))
    rows = logs.select(F.coalesce(F.col(level).cast("string"), F.lit(UNKNOWN)).alias("grp"), text.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bounds = _bounds(rows, -(-size // range_bytes))
    ones = count_transducers(rows, 1, 1, None, bounds, min_count)
    twos = count_transducers(rows, 2, 2, filter_of(ones), bounds, min_count)
    more = count_transducers(rows, 3, MOST_WORDS, filter_of(twos), bounds, min_count)
    every = ones.unionByName(twos).unionByName(more)
    longer = twos.unionByName(more).where("packed IS NOT NULL").select("packed")
    candidates = staged(longer.mapInArrow(_listed, "grp string, phrase string, words int, a long"))

    split = F.split("phrase", " ")
    k = F.explode(F.sequence(F.lit(1), F.col("words") - 1))
    cuts = candidates.select("grp", "phrase", "a", split.alias("w"), "words", k.alias("k")).select(
        "grp", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("words")), " ").alias("right"))
    parts = cuts.select("grp", F.col("left").alias("part")).unionByName(cuts.select("grp", F.col("right").alias("part")))
    counts = staged(part_counts(parts, every, bounds))
    known = cuts.join(counts.select("grp", F.col("part").alias("left"), F.col("f").alias("l")), ["grp", "left"]).join(
        counts.select("grp", F.col("part").alias("right"), F.col("f").alias("r")), ["grp", "right"])
    wide = "CAST({} AS DECIMAL(38, 0))"
    score = F.expr(f"{wide.format(2000000)} * a div ({wide.format('l')} + r)")
    scored = known.select("grp", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("grp", "phrase").agg(
        F.first("a").alias("a"), F.min("cut").alias("cut"))

    inner = candidates.where("words > 2").select("grp", "a", split.alias("w"), "words").select(
        "grp", "a", "w", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m")).select(
        "grp", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)).alias("i"))
    within = inner.select("grp", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase"), "a").groupBy("grp", "phrase").agg(
        F.max("a").alias("a_longer"))
    covered = F.expr(f"coalesce({wide.format(100)} * a_longer >= {wide.format(WITHIN)} * a, false)")
    left = scored.join(within, ["grp", "phrase"], "left").where(~covered)
    order = Window.partitionBy("grp").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")  # cut to the top before the shuffle
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = ones.where("grp IS NOT NULL").groupBy("grp").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "grp").select(F.col("grp").alias(level), F.col("rank").cast("long").alias("rank"), "phrase", "a",
                                             F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
