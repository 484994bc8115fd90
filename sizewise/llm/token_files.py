"""Token ids of texts in files of entropy-coded frames: static range asymmetric numeral systems, interleaved."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sizewise.llm.common import staged, utf8
from sizewise.session import checkpoint_dir

MAGIC = b"STK1"
#: Frequencies of a table sum to 2 ** BITS; states lie between 2 ** 31 and 2 ** 63.
BITS = 20
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
#: States that take turns in a block, tokens of a block, and steps of a block between checkpoints.
LANES, BLOCK_TOKENS, CHECK_STEPS = 32, 1 << 15, 512
#: A frame is closed at so many tokens; a text is never cut. Tokens of a partition of files, about.
FRAME_TOKENS, PART_TOKENS = 1 << 20, 1 << 22
#: Bytes of text encoded together, about, pieces of text whose ids a worker remembers, and new ones put together in a call.
CALL_BYTES, REMEMBERED, TOGETHER = 12 << 20, 600_000, 64
_HEADER = struct.Struct("<4sIIIIIQII")


class FrequencyTable:
    """Frequencies of token ids that sum to 2 ** BITS; ids that never occur have 0 and cannot be written."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.low = self.freq.cumsum() - self.freq
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())

    @staticmethod
    def of_counts(counts: np.ndarray) -> FrequencyTable:
        """Counts in proportion, at least 1 for what occurs. What rounding leaves over or short goes to the largest."""
        total, size = int(counts.sum()), 1 << BITS
        if np.count_nonzero(counts) > size:
            raise ValueError(f"more than {size} different token ids")
        if not total:
            return FrequencyTable(np.zeros(len(counts), np.int64))
        freq = np.where(counts > 0, np.maximum(1, (counts.astype(np.float64) * (size / total)).astype(np.int64)), 0)
        while (short := size - int(freq.sum())) != 0:
            top = int(freq.argmax())
            freq[top] += max(short, -(int(freq[top]) // 2))
        return FrequencyTable(freq)

    def encode(self, ids: np.ndarray, block_tokens: int, check_steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of all blocks one after another, states at the checkpoints (block, checkpoint, lane), and how many words of its block
        come before each checkpoint, with the number of words of the block at the end.

        All blocks and lanes go backward through their tokens at the same time.
        """
        n_blocks, steps = -(-len(ids) // block_tokens), block_tokens // LANES
        if n_blocks == 1:
            steps = -(-len(ids) // LANES)
        checks = -(-steps // check_steps)
        grid = np.zeros(n_blocks * steps * LANES, np.int64)
        grid[:len(ids)] = ids
        grid = grid.reshape(n_blocks, steps, LANES)
        x = np.full((n_blocks, LANES), LOW)
        states = np.empty((n_blocks, checks, LANES), np.uint64)
        words = np.empty((steps, n_blocks, LANES), np.uint32)
        told = np.zeros((steps, n_blocks, LANES), bool)
        bits, up = np.uint64(BITS), np.uint64(63 - BITS)
        in_last = len(ids) - (n_blocks - 1) * steps * LANES
        lane = np.arange(LANES)
        for t in range(steps - 1, -1, -1):
            token = grid[:, t]
            f, c = self.freq[token], self.low[token]
            live = None
            if (t + 1) * LANES > in_last:  # places behind the end of the last block
                live = np.ones(x.shape, bool)
                live[-1] = t * LANES + lane < in_last
                f, c = np.where(live, f, np.uint64(1)), np.where(live, c, np.uint64(0))
            out = x >= (f << up)
            if live is not None:
                out &= live
            words[t], told[t] = x, out  # the lower half of the state
            y = np.where(out, x >> WORD, x)
            q = y // f
            y = (q << bits) + (y - q * f) + c
            x = y if live is None else np.where(live, y, x)
            if t % check_steps == 0:
                states[:, t // check_steps] = x
        told = told.transpose(1, 0, 2)
        before = np.concatenate([np.zeros((n_blocks, 1), np.int64), told.sum(axis=2).cumsum(axis=1)], axis=1)
        at = np.concatenate([before[:, :-1:check_steps][:, :checks], before[:, -1:]], axis=1)
        return words.transpose(1, 0, 2)[told], states, at

    def decode(self, words: np.ndarray, states: np.ndarray, at: np.ndarray, sizes: np.ndarray, steps: int) -> np.ndarray:
        """Tokens of segments, ``sizes`` of them in each; ``at``: where the words of each begin. All go forward at the same time."""
        x, at = states.copy(), at.copy()
        out = np.zeros((len(sizes), steps, LANES), np.uint32)
        mask, bits, lane = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.arange(LANES)
        words = np.append(words, np.uint32(0)).astype(np.uint64)
        least = int(sizes.min())
        for t in range(steps):
            slot = x & mask
            token = self.slots[slot.astype(np.int64)]
            y = self.freq[token] * (x >> bits) + slot - self.low[token]
            need = y < LOW
            if (t + 1) * LANES > least:
                live = sizes[:, None] > t * LANES + lane
                need &= live
                y = np.where(live, y, x)
            rank = need.cumsum(axis=1)
            spot = np.where(need, at[:, None] + rank - 1, len(words) - 1)
            x = np.where(need, y << WORD | words[spot], y)
            at += rank[:, -1]
            out[:, t] = token
        return out[np.arange(steps * LANES).reshape(steps, LANES)[None] < sizes[:, None, None]]


def pack_frame(table: FrequencyTable, texts: list[tuple[int | None, np.ndarray]], block_tokens: int = BLOCK_TOKENS,
               check_steps: int = CHECK_STEPS) -> bytes:
    """One frame: header, ids and token counts of its texts, blocks with checksums, checkpoints and words, and a checksum of all."""
    tokens = np.concatenate([t for _, t in texts]).astype(np.uint32)
    words, states, at = table.encode(tokens, block_tokens, check_steps)
    known = np.array([i is not None for i, _ in texts], np.uint8)
    names = np.array([0 if i is None else i for i, _ in texts], "<i8")
    lengths = np.array([len(t) for _, t in texts], "<u4")
    data = tokens.astype("<u4")
    sums = np.array([zlib.crc32(data[k:k + block_tokens]) for k in range(0, len(data), block_tokens)], "<u4")
    header = _HEADER.pack(MAGIC, table.crc, LANES, block_tokens, check_steps, len(sums), len(tokens), len(texts), states.shape[1])
    body = b"".join([header, names.tobytes(), known.tobytes(), lengths.tobytes(), sums.tobytes(), at.astype("<u4").tobytes(),
                     states.astype("<u8").tobytes(), words.astype("<u4").tobytes()])
    return body + struct.pack("<I", zlib.crc32(body))


class Frame:
    """A packed frame, checked; its tokens can be decoded from any checkpoint on."""

    def __init__(self, table: FrequencyTable, packed: bytes):
        self.table = table
        if zlib.crc32(memoryview(packed)[:-4]) != struct.unpack("<I", packed[-4:])[0]:
            raise ValueError("a token frame is damaged")
        magic, crc, lanes, self.block_tokens, self.check_steps, blocks, self.n_tokens, n_texts, checks = _HEADER.unpack_from(packed)
        if magic != MAGIC or lanes != LANES or crc != table.crc:
            raise ValueError("a token frame of another format or table")
        place = _HEADER.size

        def take(dtype: str, n: int) -> np.ndarray:
            nonlocal place
            found = np.frombuffer(packed, dtype, n, place)
            place += found.nbytes
            return found

        self.names, self.known, self.lengths = take("<i8", n_texts), take("u1", n_texts), take("<u4", n_texts)
        self.sums, self.at = take("<u4", blocks), take("<u4", blocks * (checks + 1)).reshape(blocks, checks + 1).astype(np.int64)
        self.states = take("<u8", blocks * checks * LANES).reshape(blocks, checks, LANES)
        self.words = np.frombuffer(packed, "<u4", (len(packed) - 4 - place) // 4, place)

    def tokens(self, first: int = 0, after: int | None = None) -> np.ndarray:
        """Tokens from ``first`` to before ``after``, from the checkpoints that cover them. Whole blocks are held against their checksums."""
        after = self.n_tokens if after is None else min(after, self.n_tokens)
        if first >= after:
            return np.zeros(0, np.uint32)
        blocks, checks = self.states.shape[:2]
        span = self.check_steps * LANES  # tokens of a segment
        block, check = np.divmod(np.arange(blocks * checks), checks)
        begin = block * self.block_tokens + check * span
        end = np.minimum(np.minimum(begin + span, (block + 1) * self.block_tokens), self.n_tokens)
        use = np.flatnonzero((begin < after) & (end > first))
        base = self.at[:, -1].cumsum() - self.at[:, -1]
        sizes = end[use] - begin[use]
        found = self.table.decode(self.words, self.states[block[use], check[use]], base[block[use]] + self.at[block[use], check[use]],
                                  sizes, -(-int(sizes.max()) // LANES))
        shift = int(begin[use[0]])
        for b in np.unique(block[use]):
            lo, hi = b * self.block_tokens, min((b + 1) * self.block_tokens, self.n_tokens)
            if shift <= lo and hi <= shift + len(found) and zlib.crc32(found[lo - shift:hi - shift].astype("<u4")) != self.sums[b]:
                raise ValueError("tokens of a block do not have its checksum")
        return found[first - shift:after - shift]


#: What may stand on both sides of a blank where a text is cut: visible ASCII and the first bytes of letters up to U+07FF.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = _VISIBLE[0xC3:0xE0] = True


def pieces_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces of texts begin: at each text, and at single blanks between visible characters, which always begin a token of a
    byte-level vocabulary. Texts are cut nowhere else."""
    blank = np.flatnonzero(data[1:-1] == 32) + 1 if len(data) > 2 else np.zeros(0, np.int64)
    before = data[blank - 1]
    ends = (before >= 0x21) & (before < 0x7F) | (before >= 0x80) & _VISIBLE[data[blank - 2]] & (data[blank - 2] >= 0xC3) & (blank > 1)
    inner = blank[ends & _VISIBLE[data[blank + 1]]]
    head = np.zeros(len(data), bool)
    head[inner] = True
    head[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(head)


class PieceTokenizer:
    """Encodes texts piece by piece, each distinct piece once as long as it is remembered; other vocabularies text by text."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        pre = self.tokenizer.pre_tokenizer
        self.cuts = (type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and pre.use_regex and self.tokenizer.normalizer is None
                     and not any(t.lstrip or t.rstrip or " " in t.content for t in self.tokenizer.get_added_tokens_decoder().values()))
        vocabulary_ids = self.tokenizer.get_vocab(with_added_tokens=True)
        self.widths = np.zeros(max(vocabulary_ids.values(), default=0) + 1, np.int64)  # a character of a byte-level token is a byte
        self.widths[list(vocabulary_ids.values())] = [len(t) for t in vocabulary_ids]
        for number, token in self.tokenizer.get_added_tokens_decoder().items():
            self.widths[number] = len(token.content.encode())
        self.known: dict[bytes, int] = {}
        self.ids, self.ends = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in found]

    def _encoded(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces and how many each has. Pieces that begin with a blank and end with a visible character are put together for
        a call, and told apart by the bytes that ids stand for."""
        inner = [p[0] == 32 and (0x21 <= p[-1] < 0x7F or p[-1] >= 0x80 and 0xC3 <= p[-2] < 0xE0) for p in pieces] if self.cuts else []
        together = [p for p, i in zip(pieces, inner) if i]
        alone = [p for p, i in zip(pieces, inner) if not i] if self.cuts else pieces
        found = self._encode([b"".join(together[k:k + TOGETHER]) for k in range(0, len(together), TOGETHER)] + alone)
        n_calls = len(found) - len(alone)
        sizes = np.zeros(len(pieces), np.int64)
        mask = np.array(inner, bool) if self.cuts else np.zeros(len(pieces), bool)
        sizes[~mask] = [len(f) for f in found[n_calls:]]
        ids = np.concatenate(found)
        if n_calls:
            ends = np.cumsum(self.widths[np.concatenate(found[:n_calls])])
            want = np.cumsum(np.fromiter(map(len, together), np.int64, len(together)))
            after = np.minimum(np.searchsorted(ends, want), len(ends) - 1) + 1
            if ends[-1] != want[-1] or (ends[after - 1] != want).any():
                raise ValueError("the ids of pieces do not add up to their bytes")
            sizes[mask] = np.diff(after, prepend=0)
        # From the order of calls to that of pieces.
        order = np.concatenate([np.flatnonzero(mask), np.flatnonzero(~mask)])
        begin = np.empty(len(pieces), np.int64)
        begin[order] = sizes[order].cumsum() - sizes[order]
        return ids[np.arange(len(ids)) + np.repeat(begin - (sizes.cumsum() - sizes), sizes)], sizes

    def _found(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces: all ids one after another, and where those of each piece begin and end. New pieces are remembered while there is room."""
        known = self.known
        number = np.fromiter((known.get(p, -1) for p in pieces), np.int64, len(pieces))
        missing = np.flatnonzero(number < 0)
        ids, ends = self.ids, self.ends
        if len(missing):
            new = [pieces[k] for k in missing]
            more, sizes = self._encoded(new)
            ids = np.concatenate([ids, more])
            ends = np.concatenate([ends, ends[-1] + sizes.cumsum()])
            number[missing] = len(known) + np.arange(len(new))
            if room := max(0, min(len(new), REMEMBERED - len(known))):
                known.update(zip(new[:room], range(len(known), len(known) + room)))
                self.ids, self.ends = ids[:ends[len(known)]], ends[:len(known) + 1]
        return ids, ends[number], ends[number + 1]

    def __call__(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with ``end_id``, and where those of each text begin."""
        begin = pieces_of(data, offsets) if self.cuts else offsets[:-1][np.diff(offsets) > 0]
        ends = pa.py_buffer(np.append(begin, len(data)).astype(np.int64))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, ends, pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        ids, first, after = self._found(pieces.dictionary.to_pylist())
        of = pieces.indices.to_numpy()
        start, size = first[of], (after - first)[of]
        total = np.concatenate([[0], size.cumsum()])
        cut = total[np.searchsorted(begin, offsets)] + np.arange(len(offsets))
        out = np.full(cut[-1], end_id, "<u4")
        inside = np.ones(len(out), bool)
        inside[cut[1:] - 1] = False
        # Numbers of 32 bits, since a call has far fewer tokens.
        shift = (start - (size.cumsum() - size)).astype(np.int32)
        out[inside] = ids[np.arange(size.sum(), dtype=np.int32) + np.repeat(shift, size)]
        return out, cut


@lru_cache(maxsize=1)
def _remembering(vocabulary: str) -> PieceTokenizer:
    """One tokenizer per Python worker, for all its tasks."""
    return PieceTokenizer(vocabulary)


def _tokenized(texts: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """``id``, ``h``, ``n`` and the compressed ids of each text, the end id included; and a row per task with ``counts`` alone, the
    compressed numbers of its ids."""
    with open(vocabulary, encoding="utf-8") as f:
        shared = texts.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task per core
        tokenizer, pack = _remembering(shared.value), zstandard.ZstdCompressor(level=1).compress
        counts = np.zeros(0, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            lo = 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CALL_BYTES, side="right")) - 1)
                ids, cut = tokenizer(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], end_id)
                found = np.bincount(ids, minlength=len(counts))
                found[:len(counts)] += counts
                counts = found
                narrow = ids.astype("<u2") if ids.max() < 1 << 16 else ids
                packed = [pack(narrow[a:b].tobytes()) for a, b in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo), batch.column("h").slice(lo, hi - lo), pa.array(np.diff(cut)), pa.array(packed, pa.binary()),
                     pa.nulls(hi - lo, pa.binary())], names=["id", "h", "n", "packed", "counts"])
                lo = hi
        if len(counts):
            none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array([pack(counts.astype("<i8").tobytes())], pa.binary())],
                                             names=["id", "h", "n", "packed", "counts"])

    return texts.mapInArrow(tokenize, "id long, h long, n long, packed binary, counts binary")


def _unpacked(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    unpack = zstandard.ZstdDecompressor().decompress
    for n, packed in zip(batch.column("n").to_pylist(), batch.column("packed"), strict=True):
        raw = unpack(packed.as_buffer())
        yield np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the counts of tasks, one row per id."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        for packed in batch.column("counts"):
            found = np.frombuffer(zstandard.decompress(packed.as_buffer()), "<i8").copy()
            if len(found) < len(total):
                found, total = total, found
            found[:len(total)] += total
            total = found
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["token", "n"])


def write_tokens(requests: DataFrame, path: str, vocabulary: str, end_id: int, request_id: str = "request_id", prompt: str = "prompt",
                 frame_tokens: int = FRAME_TOKENS, part_tokens: int = PART_TOKENS) -> None:
    """Writes the token ids of goal prompts, in ascending order of their ids, to a new folder ``path``.

    Runs on goal requests (``request_id``, ``prompt``) as on any table of texts with a long id. ``vocabulary`` is a local file of
    the tokenizers library; ``end_id`` ends each text. The folder holds three Parquet tables: ``frames`` (``part``, tokens of it ``before``,
    ``n_tokens`` and the ``packed`` frame), ``table`` (``token``, ``freq``) and ``parts`` (``part``, ``start``).

    1. Texts are tokenized once and staged. 2. Ids are counted, combined per task, and give one frequency table for all.
    3. Texts are dealt by ranges of (id, hash of text) and sorted; each part is packed into frames of whole texts, cut into
    independent blocks that are encoded side by side, with states as checkpoints on the way.

    A null text is an empty one. Null ids come first; rows of one id are ordered by a hash of the text. An empty table gives an
    empty folder of tables. A text is whole, however long. Further columns are ignored.
    """
    spark = requests.sparkSession
    text = F.coalesce(F.col(prompt), F.lit(""))
    given = requests.select(F.col(request_id).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    tokens = staged(_tokenized(given, vocabulary, end_id))
    counts = tokens.where("counts IS NOT NULL").select("counts").mapInArrow(_count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    dense = np.zeros(int(counts["token"].max()) + 1 if len(counts) else 1, np.int64)  # one entry per id of the vocabulary
    dense[counts["token"].to_numpy(np.int64)] = counts["n"]
    table = FrequencyTable.of_counts(dense)
    shared = spark.sparkContext.broadcast(table)
    parts = max(1, -(-int(dense.sum()) // part_tokens))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, held, n_held = TaskContext.get().partitionId(), 0, [], 0

        def frame() -> pa.RecordBatch:
            numbers = [pa.array([v], pa.int64()) for v in (part, before, n_held)]
            packed = pa.array([pack_frame(shared.value, held)], pa.binary())
            return pa.RecordBatch.from_arrays([*numbers, packed], names=["part", "before", "n_tokens", "packed"])

        for batch in batches:
            for name, ids in zip(batch.column("id").to_pylist(), _unpacked(batch), strict=True):
                held.append((name, ids))
                n_held += len(ids)
                if n_held >= frame_tokens:
                    yield frame()
                    before, held, n_held = before + n_held, [], 0
        if held:
            yield frame()

    ordered = tokens.where("packed IS NOT NULL").repartitionByRange(parts, "id", "h").sortWithinPartitions("id", "h").select("id", "n", "packed")
    frames = ordered.mapInArrow(encode, "part long, before long, n_tokens long, packed binary")
    frames.write.option("compression", "none").parquet(f"{path}/frames")  # packed already
    spark.createDataFrame([(k, int(f)) for k, f in enumerate(table.freq) if f], "token long, freq long").coalesce(1).write.parquet(f"{path}/table")
    sizes = spark.read.parquet(f"{path}/frames").groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row per part
    starts = np.cumsum([0, *[r["n"] for r in sizes]])
    spark.createDataFrame([(r["part"], int(s)) for r, s in zip(sizes, starts)], "part long, start long").coalesce(1).write.parquet(f"{path}/parts")


def read_table(spark: SparkSession, path: str) -> FrequencyTable:
    rows = spark.read.parquet(f"{path}/table").toPandas()  # one row per id of the vocabulary
    freq = np.zeros(int(rows["token"].max()) + 1 if len(rows) else 1, np.int64)
    freq[rows["token"].to_numpy(np.int64)] = rows["freq"]
    return FrequencyTable(freq)


def read_tokens(spark: SparkSession, path: str, request_id: str = "request_id") -> DataFrame:
    """The texts of a folder that ``write_tokens`` wrote: the id, ``start`` (tokens of all texts before it), ``n_tokens`` and
    ``token_ids`` (little-endian unsigned integers of 32 bits, binary). Frames are decoded in parallel and held against their
    checksums; a damaged one raises an error."""
    shared = spark.sparkContext.broadcast(read_table(spark, path))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, packed in zip(batch.column("start").to_pylist(), batch.column("packed"), strict=True):
                frame = Frame(shared.value, packed.as_buffer().to_pybytes())
                data = frame.tokens().astype("<u4")
                size = frame.lengths.astype(np.int64)
                ends = np.concatenate([[0], size.cumsum()])
                ids = pa.array(frame.names, mask=frame.known == 0)
                body = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer((ends * 4).astype(np.int64)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([ids, pa.array(start + ends[:-1]), pa.array(size), body.cast(pa.binary())],
                                                 names=["id", "start", "n_tokens", "token_ids"])

    frames = spark.read.schema("part long, before long, n_tokens long, packed binary").parquet(f"{path}/frames")
    parts = spark.read.schema("part long, start long").parquet(f"{path}/parts")
    placed = frames.join(parts, "part").select((F.col("start") + F.col("before")).alias("start"), "packed")
    found = placed.mapInArrow(decode, "id long, start long, n_tokens long, token_ids binary")
    return found.withColumnRenamed("id", request_id)


def new_folder(spark: SparkSession) -> str:
    """A folder for token files in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
