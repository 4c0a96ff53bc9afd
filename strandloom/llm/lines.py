"""Line dedup by sharded minimal perfect hashes.

A line's key is the line stripped of ASCII white space at both ends and with A-Z in lower case. Keys of at least min_chars code
points that at least two documents hold lose all their lines but those of the smallest doc_id that holds them.

1. Each document's keys are hashed to 128 bits and grouped to a count, the least and the largest doc_id (Spark pre-aggregates).
2. The hashes found in several documents are split into shards. For each shard a minimal perfect hash is built, and arrays
   hold the last 64 bits as fingerprint, the count and the owner at its place. A shard is one row.
3. Documents probe: each line's hash goes to its shard, which looks it up in the arrays; only what must go comes back.
   Lines in HOT_LEAST documents or more and in over 1 / HOT_SHARE of all (line, document) pairs, which are HOT_SHARE at most, form a
   shard of their own that is broadcast. There are MAX_SHARDS shards at most, in as many copies as an even share of the pairs needs; a shard that
   more than twice that probe gets more copies, and the list of these is broadcast (half of MAX_SHARDS at most). Probes are dealt to copies
   by document, so that no common line sends its many probes to one task.
4. Each document drops the lines it was told to.

A text that is null or empty has one empty line. A row with a null id neither counts nor loses lines. Rows that share an id
are one document: they lose the same lines. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import materialized, slices, small_batches, unused

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_CONTINUED = bytes(range(0x80, 0xC0))
#: Lines held by a shard, (line, document) pairs probing one, the share of pairs from which a line is hot, and the documents that it has at least.
SHARD_LINES, SHARD_PROBES, HOT_SHARE, HOT_LEAST = 100_000, 250_000, 20_000, 10_000
#: Shards at most: with more lines or pairs than they hold at the sizes above, shards grow and are copied.
MAX_SHARDS = 50_000


def key_of(line: bytes) -> bytes:
    return line.strip().translate(_LOWER)


def _hashes(lines: list[bytes], min_chars: int) -> list[bytes | None]:
    """A 128-bit hash for each line; None for keys that are too short."""
    from xxhash import xxh3_128_digest

    out = []
    for line in lines:
        key = line.strip()
        short = len(key) < 4 * min_chars and (len(key) < min_chars or len(key.translate(None, _CONTINUED)) < min_chars)
        out.append(None if short else xxh3_128_digest(key.translate(_LOWER)))
    return out


def _mix(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    """Well mixed 64 bits for a level of the minimal perfect hash. Two different hashes get the same at one level in 2**64 at most."""
    with np.errstate(over="ignore"):
        x = h1.view(np.uint64) + h2.view(np.uint64) * np.uint64(2 * level + 1)
        x = (x ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(16)


class PerfectHash:
    """Level after level of bits: a key that is alone at its place takes it, the others go on to the next level. Keys are pairs of 64 bits, each there once."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, below = [], 0
        for bits in levels:
            self.ranks.append(np.cumsum(bits) - bits + below)
            below += int(bits.sum())

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        levels, left = [], np.arange(len(h1))
        while len(left):
            at = (_mix(h1[left], h2[left], len(levels)) % np.uint64(2 * len(left) + 1)).astype(np.int64)
            alone = np.bincount(at, minlength=2 * len(left) + 1) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def places(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """A place below the number of keys for each key it was built over; anything, -1 too, for others."""
        out, open_ = np.full(len(h1), -1, np.int64), np.arange(len(h1))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            at = (_mix(h1[open_], h2[open_], level) % np.uint64(len(bits))).astype(np.int64)
            here = bits[at]
            out[open_[here]] = ranks[at[here]]
            open_ = open_[~here]
        return out

    def to_bytes(self) -> tuple[bytes, list[int]]:
        return b"".join(np.packbits(x).tobytes() for x in self.levels), [len(x) for x in self.levels]

    @classmethod
    def from_bytes(cls, packed: bytes, sizes: list[int]) -> PerfectHash:
        levels, at = [], 0
        for n in sizes:
            levels.append(np.unpackbits(np.frombuffer(packed, np.uint8, -(-n // 8), at), count=n).astype(bool))
            at += -(-n // 8)
        return cls(levels)


SHARD_SCHEMA = "shard int, bits binary, sizes array<int>, prints binary, counts binary, owners binary"


class Shard:
    """The arrays of a shard, and lookups in them."""

    def __init__(self, row: dict):
        self.hash = PerfectHash.from_bytes(row["bits"], row["sizes"])
        self.prints, self.counts, self.owners = np.frombuffer(row["prints"], "<i8"), np.frombuffer(row["counts"], "<i8"), np.frombuffer(row["owners"], "<i8")

    def look_up(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The count of each hash, 0 for one that is not in the shard, and its owner."""
        if not len(self.prints):
            return np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64)
        at = self.hash.places(h1, h2)
        return np.where((at >= 0) & (self.prints[at] == h2), self.counts[at], 0), self.owners[at]


def _build(shard: int, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, owners: np.ndarray) -> dict:
    built = PerfectHash.build(h1, h2)
    at = built.places(h1, h2)
    bits, sizes = built.to_bytes()
    arrays = {}
    for name, values in (("prints", h2), ("counts", counts), ("owners", owners)):
        arrays[name] = np.zeros(len(h1), "<i8")
        arrays[name][at] = values
    return {"shard": shard, "bits": bits, "sizes": sizes} | {k: v.tobytes() for k, v in arrays.items()}


def _as_batch(row: dict) -> pa.Table:
    types = (pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary())
    return pa.table({k: pa.array([v], t) for (k, v), t in zip(row.items(), types)})


def _keys_of(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """doc_id, h1 and h2 of each document's different line keys."""
    for batch in slices(batches):
        ids, found = [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = {*_hashes(text.encode("utf-8", "surrogatepass").split(b"\n"), min_chars)} - {None}
            found += own
            ids += [doc_id] * len(own)
        both = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
        yield np.array(ids, np.int64), both[:, 0].copy(), both[:, 1].copy()


def _shared_lines(texts: DataFrame, min_chars: int) -> DataFrame:
    """h1, h2, n, owner: the keys of several documents, how many rows hold them, and the least doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _keys_of(batches, min_chars):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["doc_id", "h1", "h2"])

    keys = texts.mapInArrow(run, "doc_id long, h1 long, h2 long")
    grouped = keys.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
    return grouped.where("owner < last").select("h1", "h2", "n", "owner")


def _drops(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, gone: the hashes of lines that each document with any must drop."""
    texts = docs.where("doc_id is not null")
    shared = materialized(_shared_lines(texts, min_chars))
    lines, pairs = shared.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = min(MAX_SHARDS, max(1, -(-lines // SHARD_LINES), -(-pairs // SHARD_PROBES)))
    usual = max(1, -(-pairs // (shards * SHARD_PROBES)))  # copies of a shard with an even share
    hot_from = max(HOT_LEAST, pairs // HOT_SHARE + 1)
    hot_rows = shared.where(F.col("n") >= hot_from).toArrow()  # HOT_SHARE rows at most, as their counts sum up to pairs
    sharded = shared.where(F.col("n") < hot_from).withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    busy = sharded.groupBy("shard").agg(F.sum("n").alias("probes")).where(F.col("probes") > 2 * usual * SHARD_PROBES)  # half as many as there are shards at most
    busy = materialized(busy.select("shard", F.ceil(F.col("probes") / SHARD_PROBES).cast("int").alias("copies")))
    copies = busy.orderBy("shard").toArrow()
    sent = docs.sparkSession.sparkContext.broadcast((_build(-1, *(hot_rows[c].to_numpy() for c in ("h1", "h2", "n", "owner"))), copies["shard"].to_numpy(), copies["copies"].to_numpy()))

    def build(key: tuple, group: pa.Table) -> pa.Table:
        return _as_batch(_build(key[0].as_py(), *(group[c].to_numpy() for c in ("h1", "h2", "n", "owner"))))

    index = sharded.groupBy("shard").applyInArrow(build, SHARD_SCHEMA)
    index = index.join(F.broadcast(busy), "shard", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(usual)) - 1))).drop("copies")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's keys: those that the common lines tell to go, and those that shards are asked for."""
        row, busy_shards, copies = sent.value
        common = Shard(row)
        for doc_ids, h1, h2 in _keys_of(batches, min_chars):
            count, owner = common.look_up(h1, h2)
            gone, shard, copy = count > 0, (h1 % shards).astype(np.int32), doc_ids % usual
            if len(busy_shards):
                at = np.minimum(np.searchsorted(busy_shards, shard), len(busy_shards) - 1)
                copy = np.where(busy_shards[at] == shard, doc_ids % copies[at], copy)
            copy = copy.astype(np.int32)
            keep = ~gone | (owner != doc_ids)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (doc_ids, h1, h2, gone, shard, copy)], ["doc_id", "h1", "h2", "gone", "shard", "copy"])

    probes = texts.mapInArrow(ask, "doc_id long, h1 long, h2 long, gone boolean, shard int, copy int")

    def probe(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        doc_ids, h1, h2 = (asked[c].to_numpy() for c in ("doc_id", "h1", "h2"))
        gone = np.zeros(len(h1), bool)
        for row in held.to_pylist() if len(h1) else []:
            count, owner = Shard(row).look_up(h1, h2)
            gone |= (count > 1) & (owner != doc_ids)
        return pa.table({"doc_id": doc_ids[gone], "h1": h1[gone], "h2": h2[gone]})

    asked = probes.where("not gone").select("doc_id", "h1", "h2", "shard", "copy")
    told = asked.groupBy("shard", "copy").cogroup(index.groupBy("shard", "copy")).applyInArrow(probe, "doc_id long, h1 long, h2 long")
    told = told.unionByName(probes.where("gone").select("doc_id", "h1", "h2"))
    return told.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("gone"))


def dedup_lines(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """doc_id, text (the lines that stay), n_lines (before), n_dropped; or with keep_columns docs with its text column replaced.

    With keep_columns, all columns of docs stay under their names, and a text that loses nothing stays as it was, null too.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    gone = _drops(texts, min_chars)

    own_id, body, told = (unused(docs, name) for name in ("__id", "__text", "__told"))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names = batch.schema.names
            texts, n_lines, n_dropped = [], [], []
            for text, out in zip(batch.column(names.index(body)).to_pylist(), batch.column(names.index(told)).to_pylist()):
                lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
                n_lines.append(len(lines))
                if out:
                    bad = {np.array([x["h1"], x["h2"]], "<i8").tobytes() for x in out}
                    lines = [line for line, h in zip(lines, _hashes(lines, min_chars)) if h not in bad]
                    text = b"\n".join(lines).decode("utf-8", "surrogatepass")
                n_dropped.append(n_lines[-1] - len(lines))
                texts.append(text)
            new = [pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            kept = [c for n, c in zip(names, batch.columns) if n not in (body, told)]
            yield pa.RecordBatch.from_arrays(kept + new, [*[n for n in names if n not in (body, told)], *added])

    kept = [c for c in docs.columns if c != text_col] if keep_columns else []
    added = [body, unused(docs, "__lines"), unused(docs, "__dropped")]
    source = docs.select(F.col(id_col).cast("long").alias(own_id), F.col(text_col).alias(body), *[F.col(f"`{c}`") for c in kept])
    asked = gone.select(F.col("doc_id").alias(f"{told}_id"), F.col("gone").alias(told))
    joined = source.join(asked, F.col(own_id) == F.col(f"{told}_id"), "left").select(*[f"`{c}`" for c in source.columns], told)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != body]
    done = joined.mapInArrow(drop, ", ".join([*fields, f"{body} string", f"{added[1]} long", f"{added[2]} long"]))
    if keep_columns:
        return done.select(*[F.col(body).alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
    return done.select(F.col(own_id).alias("doc_id"), F.coalesce(body, F.lit("")).alias("text"), F.col(added[1]).alias("n_lines"), F.col(added[2]).alias("n_dropped"))
