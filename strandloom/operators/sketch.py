"""Fragments and sketches of sequences: one pass of array kernels over whole rows, no shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import kernels
from strandloom.operators.analytics import cut, running_sums, side


def fragments(seqs: DataFrame, length: int) -> DataFrame:
    """genome, contig, frag (from 0 over the genome), global_start, seq: tiles of each contig, tails left out, short contigs counted in global_start."""
    sized = seqs.select("genome", "contig", F.length("seq").cast("long").alias("n"), F.floor(F.length("seq") / length).cast("long").alias("tiles"))
    bases = running_sums(sized, ["genome"], ["contig"], {"base": F.col("n"), "first": F.col("tiles")}).where("tiles > 0").select("genome", "contig", "base", "first")
    cut = seqs.where(F.length("seq") >= length).join(bases, ["genome", "contig"])
    tiles = cut.select("genome", "contig", "base", "first", "seq", F.explode(F.sequence(F.lit(0), F.floor(F.length("seq") / length).cast("int") - 1)).alias("tile"))
    return tiles.select("genome", "contig", (F.col("first") + F.col("tile")).alias("frag"), (F.col("base") + F.col("tile") * length).alias("global_start"), F.substr("seq", F.col("tile") * length + 1, F.lit(length)).alias("seq"))


#: Bases whose k-mers are hashed at a time, and rows that a batch of output has at most; a sequence is never cut.
PIECE_BASES, MINMER_BASES, ROWS = 1 << 17, 1 << 18, 1 << 18


def _pieces(seqs: list[bytes], bases: int = PIECE_BASES) -> Iterator[tuple[int, int]]:
    """Ranges of sequences of about so many bases together."""
    first, size = 0, 0
    for i, seq in enumerate(seqs):
        if size and size + len(seq) > bases:
            yield first, i
            first, size = i, 0
        size += len(seq) + 1
    if first < len(seqs):
        yield first, len(seqs)


def _hashed(seqs: list[bytes], k: int, hash: str, seed: int, only_acgt: bool) -> list[np.ndarray]:
    """The hashes of each sequence's k-mers, worked out at once where letters between the sequences have none."""
    if not only_acgt:
        return [kernels.kmer_hashes(seq, k, hash, seed, False) for seq in seqs]
    hashes = kernels.kmer_hashes(b"N".join(seqs), k, hash, seed)
    starts = np.cumsum([0] + [len(seq) + 1 for seq in seqs]).tolist()
    return [hashes[at : at + max(len(seq) - k + 1, 0)] for at, seq in zip(starts, seqs)]


def kernel_rows(seqs: DataFrame, keys: list[str], kernel, fields: list[tuple[str, str]], hashing: tuple | None = None) -> DataFrame:
    """keys and the arrays that kernel gives for each seq, a row for each element; dtypes are long. hashing: those arguments of
    kmer_hashes() that follow the sequence; the kernel then gets its hashes too."""

    def whole(texts: list[bytes], _: pa.RecordBatch):
        parts = [kernel(*x) for x in (zip(texts, _hashed(texts, *hashing)) if hashing else zip(texts))]
        return np.repeat(np.arange(len(texts)), [len(p[0]) for p in parts]), *(np.concatenate([np.asarray(p[j]).astype(np.int64) for p in parts]) for j in range(len(fields)))

    return piece_rows(seqs, keys, whole, fields)


def piece_rows(seqs: DataFrame, keys: list[str], kernel, fields: list[tuple[str, str]], bases: int = PIECE_BASES) -> DataFrame:
    """As kernel_rows(), for a kernel that is given some sequences with their rows and gives the number among them for each row, then its arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("seq")
            own = [c for n, c in zip(batch.schema.names, batch.columns) if n != "seq"]
            texts = [(seq or "").encode() for seq in batch.column(at).to_pylist()]
            for first, stop in _pieces(texts, bases):
                rows, *made = kernel(texts[first:stop], batch.slice(first, stop - first))
                for low in range(0, len(rows), ROWS):
                    take = pa.array(rows[low : low + ROWS] + first)
                    yield pa.RecordBatch.from_arrays([c.take(take) for c in own] + [pa.array(m[low : low + ROWS].astype(np.int64)) for m in made], keys + [n for n, _ in fields])

    source = seqs.select(*keys, "seq")
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "seq"] + [f"{n} {t}" for n, t in fields]
    return source.mapInArrow(run, ", ".join(schema))


def minimizers(seqs: DataFrame, keys: list[str], k: int, w: int, hash: str = "splitmix", mode: str = "window", seed: int = 42) -> DataFrame:
    """keys, hash, pos: the minimizers of each sequence, pos being the first window that shows one."""

    def kernel(seq: bytes, hashes: np.ndarray):
        return kernels.window_minimizers(hashes, w) if mode == "window" else kernels.exact_minimizers(hashes, w) if len(seq) >= w else ([], [])

    return kernel_rows(seqs, keys, kernel, [("hash", "long"), ("pos", "long")], (k, hash, seed, mode != "exact"))


def density(seqs: DataFrame, key: str, k: int, w: int, hash: str = "splitmix", seed: int = 42) -> DataFrame:
    """key, n, n_different, first, last, checksum: figures of the minimizers of each key, worked out where its sequence lies.

    A key with several sequences is rare; its different hashes are counted over all of them, by a shuffle of their minimizers alone.
    """

    def kernel(seq: bytes, hashes: np.ndarray):
        found, places = kernels.window_minimizers(hashes, w)
        if not len(found):
            return ([],) * 5
        return [len(found)], [len(np.unique(found))], places[:1], places[-1:], [int((found % np.uint64(1000003)).sum())]

    fields = ["n", "n_different", "first", "last", "checksum"]
    each = kernel_rows(seqs, [key], kernel, [(f, "long") for f in fields], (k, hash, seed, True))
    sums = [F.sum("n").alias("n"), F.max("n_different").alias("n_different"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("checksum").alias("checksum")]
    held = cut(each.groupBy(key).agg(F.count("*").alias("__seqs"), *sums))
    repeated = held.where("__seqs > 1").select(F.col(key).alias("__key"))
    if repeated.isEmpty():
        return held.drop("__seqs")
    those = seqs.join(side(repeated, 16), F.col(key).eqNullSafe(F.col("__key")), "left_semi")
    again = minimizers(those, [key], k, w, hash, seed=seed).groupBy(key).agg(F.count("*").alias("n"), F.countDistinct("hash").alias("n_different"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.sum(F.col("hash") % 1000003).alias("checksum"))
    return held.where("__seqs = 1").drop("__seqs").unionByName(again)


def sketches(seqs: DataFrame, keys: list[str], k: int, w: int, hash: str = "splitmix", mode: str = "window", seed: int = 42, size: int | None = None) -> DataFrame:
    """keys, hash, qpos, sketch_size: each sequence's different hashes with their first place; of minmer mode the size least of all k-mers."""

    def kernel(seq: bytes, hashes: np.ndarray):
        if mode == "minmer":
            places = np.flatnonzero(hashes != kernels.NONE)
            found = hashes[places]
        else:
            found, places = (np.asarray(x) for x in (kernels.window_minimizers(hashes, w) if mode == "window" else kernels.exact_minimizers(hashes, w)))
        different, first = np.unique(found, return_index=True)
        if size:
            different, first = different[:size], first[:size]
        return different, np.asarray(places)[first] if len(first) else first, np.full(len(first), len(first))

    return kernel_rows(seqs, keys, kernel, [("hash", "long"), ("qpos", "long"), ("sketch_size", "long")], (k, hash, seed, mode != "exact"))


def minmer_intervals(seqs: DataFrame, keys: list[str], k: int, window: int, size: int, hash: str = "splitmix", seed: int = 42, only: np.ndarray | None = None, within: tuple[str, str] | None = None) -> DataFrame:
    """keys, hash, start, end: where a hash is among the least of the window, for each run of ACGT that holds a window.

    only: the hashes that are asked for; within: the keys that have the first and the last place asked for.
    """

    def kernel(texts: list[bytes], batch: pa.RecordBatch):
        joined = b"N".join(texts)
        hashes = kernels.kmer_hashes(joined, k, hash, seed)
        known = np.isin(np.frombuffer(joined, np.uint8), np.frombuffer(b"ACGT", np.uint8))
        edges = np.flatnonzero(np.diff(np.concatenate([[0], known.astype(np.int8), [0]])))
        begin, end = edges[::2], edges[1::2]
        wide = end - begin >= k + window - 1
        begin, counts = begin[wide], (end - begin)[wide] - (k - 1)
        places = np.arange(counts.sum()) + np.repeat(begin - (np.cumsum(counts) - counts), counts)
        run = np.repeat(np.arange(len(begin)), counts)
        valued = hashes[places] != kernels.NONE
        values, lengths = hashes[places[valued]], np.bincount(run[valued], minlength=len(begin))
        found, start, stop = kernels.minmers_of_runs(values, lengths, window, size)
        if only is not None:
            kept = np.flatnonzero(np.isin(found, only))
            found, start, stop = found[kept], start[kept], stop[kept]
        if not len(start):
            return start, found, start, stop
        firsts = np.cumsum([0] + [len(t) + 1 for t in texts])
        of = run[valued][start]
        number = np.searchsorted(firsts, begin[of], "right") - 1
        shift = begin[of] - firsts[number] - (np.cumsum(lengths) - lengths)[of]  # places without a hash are not counted
        rows = number, found, start + shift, stop + shift
        if within is None:
            return rows
        first, last = (batch.column(batch.schema.names.index(c)).to_numpy(zero_copy_only=False)[number] for c in within)
        kept = np.flatnonzero((rows[3] > first) & (rows[2] <= last))
        return tuple(r[kept] for r in rows)

    return piece_rows(seqs, keys, kernel, [("hash", "long"), ("start", "long"), ("end", "long")], MINMER_BASES)


def bottom_sketch(hashes: DataFrame, group: str, size: int) -> DataFrame:
    """group, hash, rank: the size least different hashes of each group of rows."""
    different = hashes.select(group, "hash").distinct()
    ranked = different.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("hash")))
    return ranked.where(F.col("rank") <= size)


def bottom_minimizers(seqs: DataFrame, group: str, size: int, k: int, w: int, hash: str = "splitmix", seed: int = 42) -> DataFrame:
    """bottom_sketch() of the window minimizers of all sequences of a group. A task hands on the size least hashes of each group that it has
    seen, since the least of all are among them, so what is shuffled goes by groups and tasks and not by bases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for name, found in least.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found.astype(np.int64))], [group, "hash"])
            least.clear()

        for batch in batches:
            names, texts = (batch.column(batch.schema.names.index(c)).to_pylist() for c in (group, "seq"))
            texts = [(seq or "").encode() for seq in texts]
            for first, stop in _pieces(texts):
                held: dict = {}
                for name, hashes in zip(names[first:stop], _hashed(texts[first:stop], k, hash, seed, True)):
                    held.setdefault(name, []).append(kernels.window_minimizers(hashes, w)[0])
                for name, found in held.items():
                    before = least.get(name, found[0][:0])
                    found = np.concatenate(found)
                    least[name] = np.unique(np.concatenate([before, found[found < before[-1]] if len(before) == size else found]))[:size]
            if sum(map(len, least.values())) > ROWS:  # many groups
                yield from flushed()
        yield from flushed()

    return bottom_sketch(seqs.select(group, "seq").mapInArrow(run, f"`{group}` string, hash long"), group, size)
