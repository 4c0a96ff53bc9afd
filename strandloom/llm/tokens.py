"""Token ids of whole texts by a public tokenizer file, with a memo of the ids of chunks of text."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space that str.split, re and the tokenizers' \s may see differently: texts with such chunks are encoded uncut.
ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0  -     　]")
#: A word of letters whose class and case all sides agree on, perhaps after a space: a part that needs no splitting.
PLAIN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]{1,40}")
#: Kinds of bytes: ASCII white space, ASCII letters, and marks that end a word of letters. An apostrophe may belong to the letters after it, and is none.
WHITE, LETTER, MARK = 1, 2, 4
KINDS = bytes(WHITE if c in " \t\n\v\f\r" else LETTER if c.isascii() and c.isalpha() else MARK if "!" <= c <= "~" and not c.isdigit() and c != "'" else 0 for c in map(chr, range(256)))
#: The bound of each of the memo's two generations, and the bytes of text that are cut into chunks at a time.
MEMO_CHUNKS, AT_ONCE = 300_000, 4_000_000


class Encoder:
    """Ids of texts as unsigned 32-bit numbers, equal to what the tokenizer gives for the whole text.

    Ids of a text are those of its chunks one after the other if the tokenizer never joins across the cut. Two kinds of
    tokenizer are known to keep that: those that drop white space, and byte-level ones with their own pattern. Both are
    cut where that pattern cuts at ASCII white space, and between a letter and a mark. Any other tokenizer gets whole texts.
    A special token's string in a text is ordinary text. Each different chunk of a batch is looked up once in a memo of bounded size.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            head = json.load(file)
        before, normal = head.get("pre_tokenizer") or {}, head.get("normalizer")
        first = (before.get("pretokenizers") or [{}])[0]
        self.cut = self.lower = False
        if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and normal is None:
            self.cut = True
        elif first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and r"[^\s\p{L}\p{N}]+" in (first.get("pattern") or {}).get("Regex", ""):
            self.cut = self.lower = True
        self.shown = _shown_bytes()
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string())
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        parts, at, done = [], 0, 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(ends, done + AT_ONCE, "right")))
            parts.append(self._encode_some(texts[at:end]))
            at, done = end, ends[end - 1]
        ids = [np.zeros(0, np.uint32), *[p[0] for p in parts]]
        return np.concatenate(ids), np.concatenate([np.zeros(0, np.int64), *[p[1] for p in parts]])

    def encode_ended(self, texts: list[str] | pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As encode(), with end_id after each text, which counts."""
        ids, counts = self.encode(texts)
        return np.insert(ids, np.cumsum(counts), np.uint32(end_id)), counts + 1

    def _encode_some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        _, bounds, data = texts.buffers()
        bounds = np.frombuffer(bounds, np.int32)[texts.offset : texts.offset + len(texts) + 1]
        raw, bounds = data[bounds[0] : bounds[-1]].to_pybytes() if data else b"", bounds - bounds[0]
        uncut = np.full(len(texts), not self.cut)
        begins = chunk_begins(raw, bounds) if self.cut else np.zeros(0, np.int64)
        chunks = pa.StringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, len(raw)).astype(np.int32)), pa.py_buffer(raw)).dictionary_encode()
        starts = np.searchsorted(begins, bounds)
        known, place = self._known(chunks.dictionary.to_numpy(zero_copy_only=False).tolist()), chunks.indices.to_numpy()
        odd = np.array([ids is None for ids in known], bool)
        if odd.any():
            uncut |= np.diff(np.concatenate([[0], np.cumsum(odd[place])])[starts]) > 0
            known = [b"" if ids is None else ids for ids in known]
        sizes = np.fromiter(map(len, known), np.int32, len(known)) >> 2
        pool, begins = np.frombuffer(b"".join(known), "<u4"), np.cumsum(sizes, dtype=np.int32) - sizes
        each = sizes[place]
        ends = np.zeros(len(place) + 1, np.int32)
        np.cumsum(each, out=ends[1:])
        ids = pool[np.repeat(begins[place] - ends[:-1], each) + np.arange(ends[-1], dtype=np.int32)]
        counts = np.diff(ends[starts]).astype(np.int64)
        if not uncut.any():
            return ids, counts
        rows = np.split(ids, np.cumsum(counts)[:-1])
        for i in np.flatnonzero(uncut):
            rows[i] = np.array(self._whole([texts[i].as_py()])[0], np.uint32)
        return np.concatenate(rows), np.array([len(row) for row in rows], np.int64)

    def _known(self, chunks: list[str]) -> list[bytes | None]:
        """The packed ids of each chunk; None for one that may hang together with its neighbours, so that its text must stay uncut."""
        if len(self.memo) > MEMO_CHUNKS:
            self.memo, self.older = {}, self.memo
        known = [*map(self.memo.get, chunks)]
        if new := [i for i, ids in enumerate(known) if ids is None]:
            again = {c: self.older[c] for i in new if (c := chunks[i]) in self.older}
            self.memo |= again
            self._learn([c for i in new if (c := chunks[i]) not in again])
            for i in new:
                known[i] = self.memo.get(chunks[i])
        return known

    def _learn(self, chunks: list[str]) -> None:
        words, hard = [], []
        for chunk in chunks:
            if PLAIN.fullmatch(chunk):
                words.append(chunk)
            elif not ODD_SPACE.search(chunk):
                hard.append(chunk)
        text, tokenize = "\0".join(words), self.tokenizer.model.tokenize
        if self.lower:
            text = text.replace(" ", "").lower()
        shown = self.shown[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-32-le").split("\0")
        self.memo.update(zip(words, _packed([t.id for t in tokenize(word)] for word in shown)))
        self.memo.update(zip(hard, _packed(self._whole(hard))))

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for at in range(0, len(texts), 4096) for e in self.tokenizer.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)]


def _packed(lists: Iterable[list[int]]) -> list[bytes]:
    """Each list as little-endian unsigned 32-bit bytes. Lists that are made one by one don't live long enough for garbage collection to look at."""
    ids, ends = [], [0]
    for each in lists:
        ids += each
        ends.append(4 * len(ids))
    flat = np.array(ids, "<u4").tobytes()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def chunk_begins(raw: bytes, bounds: np.ndarray) -> np.ndarray:
    """Where chunks begin in the bytes of texts, each of which begins at one of bounds and ends at the next.

    A chunk is a run of what is not white, with the one space before it, or the white space before that. A mark after a letter begins a chunk, too.
    """
    if not raw:
        return np.zeros(0, np.int64)
    data, kinds = np.frombuffer(raw, np.uint8), np.frombuffer(raw.translate(KINDS), np.uint8)
    white, letter = kinds == WHITE, kinds == LETTER
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # from À to ÿ, without × and ÷
    inner, begins = bounds[(bounds > 0) & (bounds < len(raw))], np.zeros(len(raw), bool)
    begins[1:] = white[1:] & ~white[:-1] | letter[:-1] & (kinds[1:] == MARK)
    last = white[:-1] & ~white[1:]
    begins[1:] |= last & (data[:-1] != 0x20)
    last[inner - 1] = False
    begins[:-1] |= last
    begins[inner] = begins[0] = True
    return np.flatnonzero(begins)


def _shown_bytes() -> np.ndarray:
    """The printable stand-ins of byte-level tokenizers: printable Latin-1 stands for itself, other bytes follow from 256 on. Zero, which parts words here, stays."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return np.array([b if b in plain else next(rest) for b in range(256)], "<u4") * (np.arange(256) > 0).astype("<u4")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
