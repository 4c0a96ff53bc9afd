"""Token ids in binary segments of patched frame-of-reference blocks, written and read through Spark.

A set of token files is one folder of Parquet files with a row for each segment: a run of whole documents in ascending
doc_id order. Its column payload holds the blocks one after the other, block_starts where each begins, doc_ids and
doc_lengths the documents. A block of up to 256 ids is
    minimum u32, width u8, exceptions u16, the packed low bits of (id - minimum), positions u8, high parts u32
where width is the least number of bits that holds a set share of the block's differences; what exceeds it goes to the exceptions.
Spark writes the files, so they reach any store, and a lost executor's part is written anew.

Null texts are empty; rows with a null id come first. Rows that share an id follow in order of their text. An empty table gives no segments.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm.common import ids_and_texts, shuffle_partitions, slices, use_checkpoints
from strandloom.llm.tokens import encoder

BLOCK, PERCENTILE, SEGMENT_IDS = 256, 0.9, 500_000
SCHEMA = "part int, segment int, first long, n_ids long, doc_ids array<long>, doc_lengths array<long>, block_starts array<int>, payload binary"
_HEAD = np.dtype([("minimum", "<u4"), ("width", "u1"), ("exceptions", "<u2")])


def encode_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[bytes, list[int]]:
    """The blocks of unsigned 32-bit ids and the place where each begins."""
    ids = ids.astype(np.uint32, copy=False)
    full = len(ids) // BLOCK * BLOCK
    out, starts, at = [], [], 0
    for group in (ids[:full].reshape(-1, BLOCK), ids[full:].reshape(1, -1)):
        if not group.size:
            continue
        low = group.min(axis=1)
        rest = group - low[:, None]
        need = np.frexp(rest.astype(np.float64))[1].astype(np.uint8)  # bits of each difference
        rank = min(group.shape[1] - 1, int(np.ceil(percentile * group.shape[1])) - 1)
        width = np.partition(need, rank, axis=1)[:, rank]
        over = need > width[:, None]
        packed: dict[int, bytes] = {}
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            for i, bits in zip(rows, _pack(rest[rows], int(w))):
                packed[i] = bits
        row, where = np.nonzero(over)
        heads = np.zeros(len(group), _HEAD)
        heads["minimum"], heads["width"], heads["exceptions"] = low, width, over.sum(axis=1)
        head, places = heads.tobytes(), where.astype(np.uint8).tobytes()
        high = (rest[row, where].astype(np.uint64) >> width[row].astype(np.uint64)).astype("<u4").tobytes()
        bounds, size = np.concatenate([[0], np.cumsum(heads["exceptions"], dtype=np.int64)]).tolist(), _HEAD.itemsize
        for i in range(len(group)):
            block = b"".join([head[i * size : i * size + size], packed[i], places[bounds[i] : bounds[i + 1]], high[4 * bounds[i] : 4 * bounds[i + 1]]])
            out.append(block)
            starts.append(at)
            at += len(block)
    return b"".join(out), starts


def _pack(rows: np.ndarray, width: int) -> list[bytes]:
    if not width:
        return [b""] * len(rows)
    n, whole = rows.shape[1], np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8)))
    low = np.ascontiguousarray((whole & np.uint32((1 << width) - 1)).reshape(-1, 8).T)
    out = np.zeros((width, low.shape[1]), np.uint8)  # eight numbers take width bytes
    for j, v in enumerate(low):
        at, shift = divmod(j * width, 8)
        v = v.astype(np.uint32 if width + shift <= 32 else np.uint64)
        v <<= v.dtype.type(shift)
        for k in range(-(-(width + shift) // 8)):
            out[at + k] |= (v >> v.dtype.type(8 * k)).astype(np.uint8)
    packed = np.ascontiguousarray(out.T).reshape(len(rows), -1)[:, : -(-n * width // 8)]
    return [b.tobytes() for b in packed]


def _unpack(packed: np.ndarray, n: int, width: int) -> np.ndarray:
    """n numbers of each row of _pack()."""
    if not width:
        return np.zeros((len(packed), n), np.uint32)
    columns = np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -(-n // 8) * width - packed.shape[1]))).reshape(-1, width).T)
    out = np.empty((8, columns.shape[1]), np.uint32)
    for j in range(8):
        at, shift = divmod(j * width, 8)
        wide = np.uint32 if width + shift <= 32 else np.uint64
        v = columns[at].astype(wide)
        for k in range(1, -(-(width + shift) // 8)):
            v |= columns[at + k].astype(wide) << wide(8 * k)
        v >>= wide(shift)
        out[j] = v & wide((1 << width) - 1)
    return np.ascontiguousarray(out.T).reshape(len(packed), -1)[:, :n]


def decode_range(payload: bytes, starts: list[int], n_ids: int, begin: int, end: int) -> np.ndarray:
    """The ids from begin up to end of a segment, from the blocks that hold them alone."""
    first, last = begin // BLOCK, -(-end // BLOCK)
    ids = decode_blocks(payload, starts[first:last], min(n_ids, last * BLOCK) - first * BLOCK)
    return ids[begin - first * BLOCK : end - first * BLOCK]


def decode_blocks(payload: bytes, starts: list[int], n_ids: int) -> np.ndarray:
    """The n_ids ids of the blocks that begin at starts again. Blocks of one width are unpacked together."""
    ids = np.zeros(n_ids, dtype="<u4")
    if not starts:
        return ids
    raw, starts = np.frombuffer(payload, np.uint8), np.array(starts)
    heads = raw[starts[:, None] + np.arange(_HEAD.itemsize)].view(_HEAD)[:, 0]
    sizes = np.full(len(starts), BLOCK)
    sizes[-1] = n_ids - BLOCK * (len(starts) - 1)
    for width, n in {*zip(heads["width"].tolist(), sizes.tolist())}:
        some = np.flatnonzero((heads["width"] == width) & (sizes == n))
        at, size, counts = starts[some] + _HEAD.itemsize, -(-n * width // 8), heads["exceptions"][some].astype(np.int64)
        values = _unpack(np.lib.stride_tricks.sliding_window_view(raw, size)[at], n, width) if size else np.zeros((len(some), n), np.uint32)
        row = np.repeat(np.arange(len(some)), counts)
        nth, first = np.arange(len(row)) - (np.cumsum(counts) - counts)[row], (at + size)[row]
        high = raw[(first + counts[row] + 4 * nth)[:, None] + np.arange(4)].view("<u4")[:, 0]
        values[row, raw[first + nth]] += (high.astype(np.uint64) << np.uint64(width)).astype(np.uint32)
        values += heads["minimum"][some, None]
        if n == BLOCK:
            ids[: len(ids) // BLOCK * BLOCK].reshape(-1, BLOCK)[some] = values
        else:
            ids[-n:] = values[0]
    return ids


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = SEGMENT_IDS) -> None:
    """Encode whole texts, append end_id to each, and write the segments in ascending doc_id order to path."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer).encode_ended, TaskContext.get().partitionId()
        doc_ids, parts, held, first, segment = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            payload, starts = encode_blocks(np.concatenate(parts))
            row = [part, segment, first, held, doc_ids, [len(p) for p in parts], starts, payload]
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], [c.split()[0] for c in SCHEMA.split(", ")])

        for batch in slices(batches, 1_000):
            ids, counts = encode(batch.column(1), end_id)
            at = 0
            for doc_id, n in zip(batch.column(0).to_pylist(), counts.tolist()):
                doc_ids.append(doc_id)
                parts.append(ids[at : at + n])
                held, at = held + n, at + n
                if held >= segment_ids:
                    yield flush()
                    doc_ids, parts, held, first, segment = [], [], 0, first + held, segment + 1
        if parts:
            yield flush()

    texts = ids_and_texts(docs, id_col, text_col)
    ordered = texts.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(write, SCHEMA).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document of the files, in what is read back from them: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it: each part's first id comes from a running sum over the parts, one row for each file.
    """
    segments = spark.read.parquet(path)
    sums = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_blocks(row["payload"], row["block_starts"], row["n_ids"])
                ends = np.cumsum(row["doc_lengths"])
                starts = ends - row["doc_lengths"]
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
                at = starts + row["first"] + row["base"]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(at, pa.int64()), pa.array(row["doc_lengths"], pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    joined = segments.join(F.broadcast(before), "part")
    return joined.select("first", "base", "n_ids", "doc_ids", "doc_lengths", "block_starts", "payload").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """doc_id, ids (array<long>) of the documents of the files whose doc_id is in wanted's column doc_id; only their blocks are decoded.

    Documents that share an id each have a row; an id that no document has gives none.
    """
    segments = spark.read.parquet(path)
    ends = F.expr("aggregate(doc_lengths, array(0L), (s, n) -> concat(s, array(element_at(s, -1) + n)))")
    places = segments.select("part", "segment", ends.alias("ends"), F.posexplode("doc_ids").alias("k", "doc_id"))
    places = places.select("part", "segment", "doc_id", F.get("ends", "k").alias("begin"), F.get("ends", F.col("k") + 1).alias("end"))
    places = places.join(wanted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    held = places.groupBy("part", "segment").agg(F.collect_list(F.struct("doc_id", "begin", "end")).alias("docs"))  # as many as a segment has at most
    held = segments.select("part", "segment", "payload", "block_starts", "n_ids").join(held, ["part", "segment"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for row in batch.to_pylist():
                ids = [decode_range(row["payload"], row["block_starts"], row["n_ids"], d["begin"], d["end"]).astype(np.int64) for d in row["docs"]]
                yield pa.RecordBatch.from_arrays([pa.array([d["doc_id"] for d in row["docs"]], pa.int64()), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return held.mapInArrow(read, "doc_id long, ids array<long>")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None, **kwargs) -> DataFrame:
    """Write token files (by default to a fresh folder below the checkpoint folder) and read them back."""
    spark = docs.sparkSession
    if path is None:
        use_checkpoints(spark)
        path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/token-files-{uuid.uuid4()}"
    write_token_files(docs, path, tokenizer, end_id, **kwargs)
    return read_token_files(spark, path)
