import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from strandloom.llm import packing, token_files, tokens
from strandloom.llm.tokens import Encoder

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ROWS = [(3, "Hello, the world!\n\nIt's  fine.", "x"), (1, None, "y"), (2, "", "y"), (7, "naïve café " * 3000, "z"), (7, "again", "z"), (None, "no id", "z"), (9, "a" * 9000, "w")]
SCHEMA = "doc_id long, text string, piece string"


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_encoder_is_the_tokenizer(path, monkeypatch):
    whole, encoder, r = Tokenizer.from_file(path), Encoder(path), random.Random(1)
    whole.encode_special_tokens = True
    parts = [" ", "  ", "\n", " \n", "\n\n", "\t", "a", "it's", "É", "1", "23", "!", "\xa0", "\x1c", "é", "́", "<|endoftext|>", "word", "Word,", "İ", "ß", "中", "\r", "'ll", "\x85", "😀", "&&&", "\0"]
    texts = ["".join(r.choices(parts, k=r.randrange(14))) for _ in range(500)] + ["x" * 5000]
    want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    for at_once in (1_000_000, 40):
        monkeypatch.setattr(tokens, "AT_ONCE", at_once)
        monkeypatch.setattr(tokens, "MEMO_CHUNKS", at_once)
        ids, counts = encoder.encode(texts)
        assert [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])] == want
    assert [len(x) for x in encoder.encode([])] == [0, 0]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_a_word_is_learned_once_whatever_marks_follow(path):
    encoder = Encoder(path)
    encoder.encode(["the word, a word.\nno café; the word", "a word... the café!)"])
    assert {*encoder.memo} == {"the", " word", ",", " a", ".", "\n", "no", " café", ";", " the", "a", "...", "!)"}


def test_chunks_are_cut_at_white_space_and_before_marks():
    r = random.Random(6)
    texts = ["".join(r.choices([" ", "\n", "\t", "a", "Zé", "×", "É", "中", "1", ",", "'", "'s", "!?"], k=r.randrange(9))) for _ in range(3000)]
    want = [re.findall(r" ?[^ \t\n]+|[ \t\n]+(?![^ \t\n])|[ \t\n]+", text) for text in texts]
    want = [[part for chunk in chunks for part in re.split(r"(?<=[A-Za-zÉé])(?=[,!?])", chunk)] for chunks in want]
    bounds = np.cumsum([0, *(len(text.encode()) for text in texts)])
    raw = "".join(texts).encode()
    begins = [*tokens.chunk_begins(raw, bounds).tolist(), len(raw)]
    assert [raw[a:b].decode() for a, b in zip(begins[:-1], begins[1:])] == [chunk for chunks in want for chunk in chunks]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_slices_of_arrow_columns_are_encoded_as_lists_are(path):
    texts = ["naïve café", "", "\0", "a, b", "", "x\xa0y", "end"]
    for kind in (pa.string(), pa.large_string()):
        for a, b in ((0, 7), (2, 6), (1, 2), (4, 4), (6, 7)):
            got, want = Encoder(path).encode(pa.array(texts, kind)[a:b]), Encoder(path).encode(texts[a:b])
            assert [x.tolist() for x in got] == [x.tolist() for x in want]


def test_best_fit_fills_the_fullest_bin_and_closes_it_first():
    bins = packing.BestFit(10, 2)
    assert [bins.place(n) for n in (6, 5, 4, 8, 5)] == [(0, 0), (1, 0), (0, 6), (2, 0), (1, 5)]
    assert bins.open == 1
    bins = packing.BestFit(10, 1)
    assert [bins.place(n)[0] for n in (6, 7, 3, 4)] == [0, 1, 1, 2]


def test_pack_documents(spark):
    whole = Tokenizer.from_file(WORDS)
    got = packing.pack_documents(spark.createDataFrame(ROWS, SCHEMA), WORDS).collect()
    want = []
    for doc_id, text, _ in ROWS:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [0]
        want += [(doc_id, k, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    key = lambda r: tuple(-1 if v is None else v for v in r[:5])
    assert sorted(map(key, got)) == sorted(map(key, want))
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), WORDS).count() == 0


def test_packing_is_close_to_full(spark):
    r = random.Random(2)
    items = spark.createDataFrame([(r.randrange(1, 2049),) for _ in range(3000)], "length long")
    got = packing.pack(items).collect()
    assert len({g.sequence_id for g in got}) <= 1.03 * sum(g.length for g in got) / 2048


@pytest.mark.parametrize("ids", [[], [0], [5] * 256, [2**32 - 1, 0, 7], list(range(1000)), [1] * 300 + [2**31] + [3] * 300])
def test_blocks_round_trip(ids):
    payload, starts = token_files.encode_blocks(np.array(ids, np.uint32))
    assert token_files.decode_blocks(payload, starts, len(ids)).tolist() == ids


@pytest.mark.parametrize("n", [1, 7, 8, 255, 256])
def test_packed_bits_are_those_of_plain_numbers(n):
    r = random.Random(n)
    for width in range(33):
        rows = [[r.getrandbits(32) for _ in range(n)] for _ in range(3)]
        low = [[x & ((1 << width) - 1) for x in row] for row in rows]
        packed = token_files._pack(np.array(rows, np.uint32), width)
        assert packed == [sum(x << (width * i) for i, x in enumerate(row)).to_bytes(-(-n * width // 8), "little") for row in low]
        assert token_files._unpack(np.frombuffer(b"".join(packed), np.uint8).reshape(3, -1), n, width).tolist() == low


def test_blocks_of_several_widths_with_exceptions():
    r = np.random.default_rng(5)
    ids = np.concatenate([np.where(r.random(256) < share, r.integers(0, 2**32, 256), r.integers(0, 2**bits, 256)) for bits in (0, 3, 8, 17, 32) for share in (0, 0.05, 0.5)] + [r.integers(0, 9, 100)]).astype(np.uint32)
    payload, starts = token_files.encode_blocks(ids)
    assert len({payload[at + 4] for at in starts}) > 4
    for k in range(len(starts)):
        assert token_files.decode_blocks(payload, starts[k:], len(ids) - 256 * k).tolist() == ids[256 * k :].tolist()


def test_blocks_round_trip_random_and_pack():
    r = np.random.default_rng(3)
    ids = np.where(r.random(10_000) < 0.05, r.integers(0, 2**32, 10_000), r.integers(100, 400, 10_000)).astype(np.uint32)
    payload, starts = token_files.encode_blocks(ids)
    assert (token_files.decode_blocks(payload, starts, len(ids)) == ids).all() and len(payload) < 2 * len(ids)


def test_token_files(spark, tmp_path):
    whole = Tokenizer.from_file(BYTES)
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for size in (10, 500_000):
        got = token_files.token_files(docs, BYTES, path=str(tmp_path / str(size)), segment_ids=size).collect()
        want, start = [], 0
        for doc_id, text, _ in sorted(ROWS, key=lambda r: (r[0] or -1, r[1] or "")):
            ids = whole.encode(text or "", add_special_tokens=False).ids + [0]
            want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    wanted = spark.createDataFrame([(7,), (2,), (8,), (7,)], "doc_id long")
    some = token_files.read_documents(spark, str(tmp_path / "500000"), wanted).collect()
    assert sorted((r.doc_id, r.ids) for r in some) == sorted((i, whole.encode(t or "", add_special_tokens=False).ids + [0]) for i, t, _ in ROWS if i in (2, 7))
    assert token_files.token_files(docs.limit(0), BYTES, path=str(tmp_path / "none")).count() == 0


def test_a_range_needs_its_own_blocks_alone():
    ids = np.random.default_rng(4).integers(0, 50_000, 2000).astype(np.uint32)
    payload, starts = token_files.encode_blocks(ids)
    for begin, end in ((0, 2000), (0, 1), (255, 257), (1999, 2000), (300, 300), (512, 768)):
        blank = bytes(starts[begin // 256]) + payload[starts[begin // 256] :] if begin < end else payload
        assert (token_files.decode_range(blank, starts, len(ids), begin, end) == ids[begin:end]).all()
