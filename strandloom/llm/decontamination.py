"""Benchmark decontamination by a prefix-filtered join of word shingles, with exact verification.

Windows of an item are its runs of `window` consecutive words (a shorter item is one window). A window's shingles are ordered
by how rare they are over all documents. Since a window counts only if all of it occurs, its prefix, the shingles of which a match
must hold at least one, is the rarest alone. Documents are probed by these prefix shingles only; the shingle's place in the window gives
the one start that can match, which must lie in the document with the whole length, and the words of that stretch are then compared exactly.

The items are a query set: they go to all tasks in blocks of at most BLOCK_BYTES of text and one piece more, one pass over the documents for each block.
Null or empty texts have no words and no hits; items with a null id or no words are not looked for. Items that share an id are one.
Rows that repeat come out as often as they go in. Empty tables give no rows, or documents without hits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import ids_and_texts, materialized, slices, small_batches, unused
from strandloom.operators.analytics import running_sums

#: A-Z to lower case; digits, letters and all bytes from 0x80 on stay; anything else parts words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BLOCK_BYTES = 4_000_000
#: Words of an item that stay together; a longer one goes in pieces that overlap, so that each window is in one.
PIECE_WORDS = 100_000
SHINGLE = 3


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class Shingles:
    """Numbers for the shingles of a block's items: only words of its vocabulary have one."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.windows: dict[bytes, set[int]] = defaultdict(set)
        for item_id, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                self.windows[np.array(words[i : i + window], np.int32).tobytes()].add(item_id)
        base = len(self.vocabulary) + 1
        if base ** SHINGLE >= 2**63:
            raise ValueError("the block has too many different words")
        self.base = base
        sizes = {min(SHINGLE, len(w) // 4) for w in self.windows}
        self.sizes = sorted(sizes)
        self.known = np.unique(np.concatenate([np.zeros(0, np.int64), *[k for w in self.windows for k in self.keys(np.frombuffer(w, np.int32), [min(SHINGLE, len(w) // 4)])]]))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, -1) for w in words), np.int32, len(words))

    def keys(self, numbers: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
        """For each size, the shingle keys at each place; -1 where a word is unknown. Keys of different sizes differ."""
        out, n = [], numbers.astype(np.int64) + 1
        for size in sizes:
            places = max(0, len(n) - size + 1)
            key, there = np.zeros(places, np.int64), np.ones(places, bool)
            for k in range(size):
                key = key * self.base + n[k : k + places]
                there &= n[k : k + places] > 0
            out.append(np.where(there, key, -1))
        return out


class Probe:
    """Finds windows in documents from their prefix shingles."""

    def __init__(self, shingles: Shingles, counts: dict[int, int]):
        self.shingles = shingles
        self.starts: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for window in shingles.windows:
            numbers = np.frombuffer(window, np.int32)
            keys = shingles.keys(numbers, [min(SHINGLE, len(numbers))])[0].tolist()
            rarest = min(range(len(keys)), key=lambda i: (counts.get(keys[i], 0), keys[i], i))
            self.starts[keys[rarest]].add((rarest, len(numbers)))
        self.prefixes = np.array(sorted(self.starts), np.int64)

    def find(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """The hit places, and the items with a window."""
        numbers = self.shingles.numbers(words)
        hit, items = np.zeros(len(words) + 1, np.int32), set()
        for keys in self.shingles.keys(numbers, self.shingles.sizes):
            for at in np.flatnonzero(_within(keys, self.prefixes)):
                for offset, length in self.starts[int(keys[at])]:
                    start = int(at) - offset
                    if start < 0 or start + length > len(words):
                        continue
                    found = self.shingles.windows.get(numbers[start : start + length].tobytes())
                    if found:
                        hit[start] += 1
                        hit[start + length] -= 1
                        items |= found
        return np.flatnonzero(np.cumsum(hit[:-1]) > 0), items


def _within(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _counts(texts: DataFrame, shingles: Shingles) -> dict[int, int]:
    """How often each shingle of the block's items occurs in all documents; no more rows come back than the block has shingles."""
    shared = texts.sparkSession.sparkContext.broadcast(shingles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value
        total = np.zeros(len(mine.known), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for keys in mine.keys(mine.numbers(words_of(text)), mine.sizes):
                    total += np.bincount(np.searchsorted(mine.known, keys[_within(keys, mine.known)]), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(mine.known[some]), pa.array(total[some])], ["key", "n"])

    rows = texts.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(rows["key"].to_pylist(), rows["n"].to_pylist()))


def _probes(texts: DataFrame, items: DataFrame, window: int, item_col: str, item_text_col: str) -> list:
    """A broadcast probe for each block of items."""
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("item_id is not null and text is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, parts = [], []
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                for at in range(0, max(1, len(words) - window + 1), PIECE_WORDS):
                    ids.append(item_id)
                    parts.append(b" ".join(words[at : at + PIECE_WORDS + window - 1]).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.string())], ["item_id", "text"])

    items = materialized(items.mapInArrow(cut, "item_id long, text string").distinct())
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > BLOCK_BYTES:  # blocks by the bytes before a piece; texts of one item that share a hash would only share their place
        order = items.withColumn("hash", F.xxhash64("text")).withColumn("all", F.lit(0))
        items = materialized(running_sums(order, ["all"], ["item_id", "hash"], {"before": F.octet_length("text")}).select("item_id", "text", F.floor(F.col("before") / BLOCK_BYTES).alias("block")))
    else:
        items = items.withColumn("block", F.lit(0).cast("long"))
    out = []
    for block in range(max(1, -(-size // BLOCK_BYTES))):
        rows = items.where(F.col("block") == block).collect()
        if not rows and block:
            continue  # a piece of several blocks' bytes lies in the first of them
        shingles = Shingles([(r.item_id, r.text) for r in rows], window)
        out.append(texts.sparkSession.sparkContext.broadcast(Probe(shingles, _counts(texts, shingles))))
    return out


def _found(source: DataFrame, probe, text_col: str, added: Sequence[str] = ("__words", "__hits", "__items")) -> DataFrame:
    """source and what is added: the number of words, the places that are hit, and the items."""
    small_batches(source.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = probe.value.find
        for batch in slices(batches):
            counts, hits, items = [], [], []
            for text in batch.column(batch.schema.names.index(text_col)).to_pylist():
                words = words_of(text)
                places, own = find(words)
                counts.append(len(words))
                hits.append(places.tolist())
                items.append(sorted(own))
            for name, values, kind in zip(added, (counts, hits, items), (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))):
                batch = batch.append_column(name, pa.array(values, kind))
            yield batch

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return source.mapInArrow(run, f"{fields}, `{added[0]}` long, `{added[1]}` array<int>, `{added[2]}` array<long>")


def _contaminated(n_words: Column, n_hit: Column, share: int) -> Column:
    return (n_hit > 0) & (n_hit * share >= n_words)


def scan(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurrence of a window), items (ids with occurring windows), contaminated.

    A document is contaminated if at least one in share of its words is hit.
    """
    texts = ids_and_texts(docs, id_col, text_col)
    probes = _probes(texts, items, window, item_col, item_text_col)
    return _judged(texts, probes, share).drop("__text")


def _judged(texts: DataFrame, probes: list, share: int) -> DataFrame:
    """The columns of scan() and, where there are several blocks, __text: the hash of the row's text."""
    if len(probes) == 1:
        rows = _found(texts, probes[0], "text").select("doc_id", F.lit(None).cast("string").alias("__text"), "__words", "__hits", "__items")
    else:  # one pass for each block; equal rows have equal hits, so they are joined by id and text
        keyed = texts.withColumn("__text", F.sha2("text", 256))
        passes = [_found(keyed, p, "text").select("doc_id", "__text", "__words", "__hits", "__items") for p in probes]
        some = reduce(DataFrame.unionByName, [p.where("size(__items) > 0") for p in passes])
        merged = some.groupBy(F.col("doc_id").alias("__doc"), F.col("__text").alias("__key")).agg(F.array_distinct(F.flatten(F.collect_set("__hits"))).alias("__h"), F.array_distinct(F.flatten(F.collect_set("__items"))).alias("__i"))
        first = passes[0].select("doc_id", "__text", "__words")
        rows = first.join(merged, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__text") == F.col("__key")), "left")
        rows = rows.select("doc_id", "__text", "__words", F.coalesce("__h", F.array().cast("array<int>")).alias("__hits"), F.coalesce("__i", F.array().cast("array<long>")).alias("__items"))
    n_hit = F.size("__hits").cast("long")
    return rows.select("doc_id", "__text", F.col("__words").alias("n_words"), n_hit.alias("n_hit"), F.col("__items").alias("items"), _contaminated(F.col("__words"), n_hit, share).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""
    texts = ids_and_texts(docs, id_col, text_col)
    probes = _probes(texts, items, window, item_col, item_text_col)
    if len(probes) > 1:  # a row is judged by its own text, whatever other rows share its id
        key = unused(docs, "__bad")
        bad = _judged(texts, probes, share).where("contaminated").select(F.col("__text").alias(key)).distinct()
        return docs.join(bad, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256) == F.col(key), "left_anti")
    added = [unused(docs, name) for name in ("__words", "__hits", "__items")]
    kept = _found(docs, probes[0], text_col, added)
    return kept.where(~_contaminated(F.col(added[0]), F.size(added[1]), share)).drop(*added)
