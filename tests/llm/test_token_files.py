import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sizewise import datasets
from sizewise.llm import token_files as T
from sizewise.llm.token_files import Frame, FrequencyTable, PieceTokenizer, new_folder, pack_frame, read_tokens, write_tokens

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(VOCABULARY)
PIECES = PieceTokenizer(open(VOCABULARY, encoding="utf-8").read())
ODD = [*"ab Z9'.,\t\n 　 éÿ日<|> ", "<|endoftext|>", "'s", " 'll", "́", "߿", "\x7f", "\x00", "  "]


def expected(rows):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*PLAIN.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def given_back(spark, path):
    return [(r.request_id, r.start, r.n_tokens, zlib.crc32(r.token_ids)) for r in read_tokens(spark, path).orderBy("start").collect()]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ODD), max_size=30).map("".join), max_size=4))
def test_pieces_give_the_ids_of_the_whole_text(texts):
    encoded = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, encoded)])
    ids, cut = PIECES(np.frombuffer(b"".join(encoded), np.uint8), offsets, 2)
    for k, t in enumerate(texts):
        assert list(ids[cut[k]:cut[k + 1]]) == [*PLAIN.encode(t, add_special_tokens=False).ids, 2]


def test_pieces_when_few_are_remembered(monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 3)
    pieces = PieceTokenizer(open(VOCABULARY, encoding="utf-8").read())
    for text in ("one two three four five two", "six one seven two", ""):
        ids, cut = pieces(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), 2)
        assert list(ids) == [*PLAIN.encode(text).ids, 2] and list(cut) == [0, len(ids)]
    assert len(pieces.known) == 3


def test_other_vocabularies_are_encoded_text_by_text():
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces, plain = PieceTokenizer(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    assert not pieces.cuts
    data = "Compress THIS image, please".encode()
    ids, _ = pieces(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 5)
    assert list(ids) == [*plain.encode(data.decode(), add_special_tokens=False).ids, 5]


@pytest.mark.parametrize("n", [1, 31, 32, 33, 1000, 32_767, 32_768, 32_769, 100_000])
def test_frames_round_trip_from_any_checkpoint(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 60_000).astype(np.uint32)
    table = FrequencyTable.of_counts(np.bincount(ids))
    packed = pack_frame(table, [(5, ids[:n // 2]), (None, ids[n // 2:])])
    frame = Frame(table, packed)
    assert (frame.tokens() == ids).all() and list(frame.lengths) == [n // 2, n - n // 2] and list(frame.known) == [1, 0]
    for first in rng.integers(0, n, 5):
        assert (frame.tokens(int(first), int(first) + 40) == ids[first:first + 40]).all()
    p = np.bincount(ids)[np.bincount(ids) > 0] / n
    assert len(packed) < -(p * np.log2(p)).sum() * n / 8 * 1.06 + 1300  # near the entropy


def test_one_kind_of_token_and_many():
    only = np.zeros(5_000, np.uint32)
    table = FrequencyTable.of_counts(np.bincount(only))
    assert (Frame(table, pack_frame(table, [(1, only)])).tokens() == only).all()
    counts = np.ones(300_000, np.int64)
    counts[7] = 10**12
    table = FrequencyTable.of_counts(counts)
    assert table.freq.sum() == 1 << T.BITS and table.freq.min() == 1
    with pytest.raises(ValueError):
        FrequencyTable.of_counts(np.ones((1 << T.BITS) + 1, np.int64))


def test_damage_is_seen():
    ids = np.arange(3000, dtype=np.uint32) % 17
    table = FrequencyTable.of_counts(np.bincount(ids))
    packed = bytearray(pack_frame(table, [(1, ids)]))
    packed[len(packed) // 2] ^= 1
    with pytest.raises(ValueError):
        Frame(table, bytes(packed))
    with pytest.raises(ValueError):
        Frame(FrequencyTable.of_counts(np.bincount(ids + 1)), pack_frame(table, [(1, ids)]))


@pytest.mark.parametrize("sizes", [(T.FRAME_TOKENS, T.PART_TOKENS), (100, 1_000)])
def test_files_against_the_library(spark, sizes):
    rows = [(i * 7 % 101, f"Text {i} of  a prompt<|endoftext|>\né {'word ' * (i % 13)}") for i in range(101)]
    rows += [(-3, None), (200, ""), (201, "x" * 50_000), (202, "ab cd " * 40_000), (None, "no id")]
    requests = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "request_id long, prompt string, start int, packed string").repartition(4)
    path = new_folder(spark)
    write_tokens(requests, path, VOCABULARY, 2, frame_tokens=sizes[0], part_tokens=sizes[1])
    assert given_back(spark, path) == expected(rows)
    assert spark.read.parquet(f"{path}/frames").count() > (1 if sizes[0] == 100 else 0)


def test_repeated_ids_and_empty_table(spark):
    rows = [(1, "same"), (1, "same"), (1, "other text"), (0, "first")]
    requests = spark.createDataFrame(rows, "request_id long, prompt string")
    path = new_folder(spark)
    write_tokens(requests, path, VOCABULARY, 2)
    got = given_back(spark, path)
    assert [g[0] for g in got] == [0, 1, 1, 1] and sorted(g[2:] for g in got) == sorted(e[2:] for e in expected(rows))
    assert [g[1] for g in got] == list(np.cumsum([0, *[g[2] for g in got]])[:-1])
    path = new_folder(spark)
    write_tokens(requests.limit(0), path, VOCABULARY, 2)
    assert given_back(spark, path) == []


def test_prompts_of_the_project(spark, sf_dir):
    requests = datasets.goal_requests(spark, sf_dir)
    path = new_folder(spark)
    write_tokens(requests, path, VOCABULARY, 2)
    assert given_back(spark, path) == expected([(r.request_id, r.prompt) for r in requests.collect()])
