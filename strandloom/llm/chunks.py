"""Texts as chunks of word numbers: a chunk is a row with the numbers of some documents' words and the words that they stand for.

Texts are read and cut once; what follows works on numbers, with one small dictionary for each chunk instead of one of all words.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import small_batches, use_checkpoints

UPPER = bytes(range(65, 91))
#: Stands for the end of a piece or a document: no text holds it once A to Z are lower case.
BREAK = b"A"
CHUNK_CHARS = 8_000_000
SCHEMA = "chunk long, part string, doc_ids array<long>, ids binary, words string"


def lowering(breaks: bytes = b"") -> bytes:
    """A table for bytes.translate: A to Z become lower case, each of breaks becomes a break."""
    return bytes.maketrans(UPPER + breaks, UPPER.lower() + BREAK * len(breaks))


def encode(texts: list[bytes], table: bytes) -> tuple[np.ndarray, pa.Array]:
    """The numbers of the texts' words, 0 for each break and each text's end, and the words; word w has the number of its place in them and one."""
    joined = b" A ".join(t.translate(table).replace(BREAK, b" A ") if BREAK in table else t.translate(table) for t in texts) + b" A"
    one = pa.array([joined.lstrip()], pa.large_binary()).cast(options=pc.CastOptions(pa.large_string(), allow_invalid_utf8=True))
    coded = pc.ascii_split_whitespace(one).flatten().dictionary_encode()
    words, old = coded.dictionary, coded.indices.to_numpy()
    at = pc.index(words, pa.scalar(BREAK.decode(), words.type)).as_py()
    ids = np.where(old == at, 0, old + (old < at)).astype(np.int32)
    return ids, pa.concat_arrays([words.slice(0, at), words.slice(at + 1)])


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to a fresh folder of Parquet below the checkpoint folder, which all executors share, and read from there."""
    spark = df.sparkSession
    use_checkpoints(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def chunked(docs: DataFrame, breaks: bytes = b"", part_col: str | None = None, id_col: str = "doc_id", text_col: str = "text", chars: int = CHUNK_CHARS) -> DataFrame:
    """The texts of docs in kept chunks of about chars bytes, each of one value of part_col (a string, null where part_col is None).

    A null text is empty; it and a null id keep their row. Words are runs of bytes other than ASCII white space.
    """
    small_batches(docs.sparkSession)
    part = F.lit(None) if part_col is None else F.col(part_col)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), part.cast("string").alias("part"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    table = lowering(breaks)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, held = TaskContext.get().partitionId() << 32, 0, {}

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal number
            for part, (doc_ids, texts) in held.items():
                ids, words = encode(texts, table)
                columns = [pa.array([number], pa.int64()), pa.array([part], pa.string()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([ids.tobytes()], pa.binary()), pa.array([" ".join(words.to_pylist())], pa.string())]
                number += 1
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "part", "doc_ids", "ids", "words"])
            held.clear()

        for batch in batches:
            for doc_id, part, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = held.setdefault(part, ([], []))
                own[0].append(doc_id)
                own[1].append(text)
                size += len(text)
                if size >= chars:
                    yield from flushed()
                    size = 0
        yield from flushed()

    return kept(named.mapInArrow(cut, SCHEMA), "chunks")


def numbers(binary) -> np.ndarray:
    return np.frombuffer(binary, np.int32)


def words_of(joined: str | None) -> pa.Array:
    """The words of a chunk; word w is at its number less one."""
    return pa.array(joined.split(" ") if joined else [], pa.string())
