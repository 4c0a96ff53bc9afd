"""Best-fit packing of tokenized documents into sequences of a fixed length.

Rows with a null text are empty documents; an empty document is its end id alone. Repeated rows are packed each for itself.
Rows with a null id keep it. An empty table gives no rows. Further columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import ids_and_texts, materialized, slices
from strandloom.llm.tokens import encoder

#: Pieces that one task packs; its open bins are what a larger number would save.
PIECES_A_TASK = 40_000
OPEN_BINS = 8_192


class BestFit:
    """Online best-fit with a bounded number of open bins, in a bitset keyed by free space.

    A bit is set for each amount of free space that some open bin has, so the lowest bit from an item's length on is the
    best fit. An item that fits nowhere opens a bin; if too many are open, the fullest closes first.
    """

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.free, self.bins, self.open, self.opened = 0, [[] for _ in range(capacity + 1)], 0, 0

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it."""
        fits = self.free >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            chosen = self._take(free)
        else:
            if self.open >= self.open_bins:
                self._take((self.free & -self.free).bit_length() - 1)
            free, chosen = self.capacity, self.opened
            self.opened += 1
        left = free - length
        if left:
            self.bins[left].append(chosen)
            self.free |= 1 << left
            self.open += 1
        return chosen, self.capacity - free

    def _take(self, free: int) -> int:
        chosen = self.bins[free].pop()
        if not self.bins[free]:
            self.free &= ~(1 << free)
        self.open -= 1
        return chosen


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and its end id, cut into pieces of at most capacity; one row for a piece, without its ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_ended
        for batch in slices(batches, 1_000):
            ids, counts = encode(batch.column(1), end_id)
            several = -(-counts // capacity)
            row = np.repeat(np.arange(len(counts)), several)
            piece = np.arange(len(row)) - (np.cumsum(several) - several)[row]
            start, length = piece * capacity, np.minimum(capacity, counts[row] - piece * capacity)
            at = (np.cumsum(counts) - counts)[row] + start
            crcs = [zlib.crc32(ids[a : a + n]) for a, n in zip(at.tolist(), length.tolist())]
            columns = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return ids_and_texts(docs, id_col, text_col).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(items: DataFrame, capacity: int = 2048, open_bins: int = OPEN_BINS, pieces_a_task: int = PIECES_A_TASK) -> DataFrame:
    """items with a sequence_id and an offset, packed in tasks of about pieces_a_task items by their column length (1 to capacity).

    Items are dealt out evenly, so no key decides how many a task gets, and come to the bins by falling length. Other
    columns stay. A sequence_id is the task's number and the bin's.
    """
    kept = materialized(items)
    tasks = max(1, -(-kept.count() // pieces_a_task))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 32
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            for name, values in (("sequence_id", [base + b for b, _ in placed]), ("offset", [o for _, o in placed])):
                batch = batch.append_column(name, pa.array(values, pa.int64()))
            yield batch

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", sequence_id long, offset long"
    return kept.repartition(tasks).sortWithinPartitions(F.desc("length"), *[c for c in ("doc_id", "piece") if c in kept.columns]).mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, **kwargs) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, tokenizer, end_id, capacity, **kwargs), capacity)
