"""Placed contigs aligned base by base: stretches between shared hashes are cut out of both sequences by joins and aligned each for itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from strandloom.config import Config
from strandloom.functions import alignment, kernels
from strandloom.operators import order, seeds, sketch
from strandloom.operators.analytics import cut

#: Bases of a tile, by which stretches find their sequence, and query bases between two hashes that stretches are cut at.
TILE, STEP = 65_536, 500


def stretches(seqs: DataFrame, wanted: DataFrame, key: str, ids: list[str], name: str) -> DataFrame:
    """ids and, under name, the bases from start to end (exclusive) of the sequence that has the key.

    seqs: key, seq, one row a key; wanted: ids, key, start, end. Sequences go out in tiles, and a stretch only meets the tiles it lies in, so no sequence is
    sent whole to the stretches that lie on it. Stretches without bases or without a sequence don't come back.
    """
    tiles = seqs.select(key, "seq", F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / TILE).cast("int"))).alias("tile")).where("seq <> ''")
    tiles = tiles.select(key, "tile", F.col("seq").substr(F.col("tile") * TILE + 1, F.lit(TILE)).alias("text"))
    parts = wanted.where("end > start").select("*", F.explode(F.sequence(F.floor(F.col("start") / TILE).cast("int"), F.floor((F.col("end") - 1) / TILE).cast("int"))).alias("tile"))
    first = F.greatest(F.col("start") - F.col("tile") * TILE, F.lit(0)).cast("int")
    last = F.least(F.col("end") - F.col("tile") * TILE, F.lit(TILE)).cast("int")
    met = parts.join(tiles, [key, "tile"]).select(*ids, "tile", F.col("text").substr(first + 1, last - first).alias("part"))
    return met.groupBy(*ids).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tile", "part"))), lambda p: p["part"]), "").alias(name))


def _shared_places(contigs: DataFrame, references: DataFrame, top: DataFrame, config: Config) -> DataFrame:
    """contig, name, length, reference, qpos, pos: places of the k-mers, minima of windows, that contigs share with the reference they lie on."""
    k, w = config.kmer, config.resolved_window()
    hashing = (k, config.hash, config.seed, True)

    def kernel(seq: bytes, hashes: np.ndarray):
        return kernels.minimizer_places(hashes, w)

    own = contigs.join(top.select("contig", "reference"), "contig").select("contig", "name", F.length("seq").cast("long").alias("length"), "reference", "seq")
    found = sketch.kernel_rows(own, ["contig", "name", "length", "reference"], kernel, [("hash", "long"), ("qpos", "long")], hashing)
    index = sketch.kernel_rows(references.select(F.col("name").alias("reference"), "seq"), ["reference"], kernel, [("hash", "long"), ("pos", "long")], hashing)
    return found.join(seeds.without_hot(index, config.ignore_top_percent), ["reference", "hash"])


def _segments(hits: DataFrame, k: int, step: int) -> DataFrame:
    """contig, reference, piece, q0, q1, p0, p1: stretches between the hashes of each contig's chain, the last hash's own bases being the last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for contig, reference, hits in zip(*(batch.column(i) for i in range(3))):
                kept = alignment.chain([(h["q"], h["p"]) for h in hits.as_py()], step)
                q, p = ([h[i] for h in kept] + [kept[-1][i] + k] for i in (0, 1))
                n = len(kept)
                columns = [pa.array([contig.as_py()] * n, batch.schema.types[0]), pa.array([reference.as_py()] * n), pa.array(range(n), pa.int32()), *(pa.array(x, pa.int64()) for x in (q[:-1], q[1:], p[:-1], p[1:]))]
                yield pa.RecordBatch.from_arrays(columns, ["contig", "reference", "piece", "q0", "q1", "p0", "p1"])

    kind = hits.schema["contig"].dataType.simpleString()
    return hits.mapInArrow(run, f"contig {kind}, reference string, piece int, q0 long, q1 long, p0 long, p1 long")


def _aligned_pieces(pairs: DataFrame) -> DataFrame:
    """contig, piece, cigar and exact of each pair of stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [alignment.align(q.encode(), r.encode()) for q, r in zip(batch.column("q").to_pylist(), batch.column("r").to_pylist())]
            new = [pa.array([alignment.cigar_of(ops) for ops, _ in found], pa.string()), pa.array([exact for _, exact in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column("contig"), batch.column("piece"), *new], ["contig", "piece", "cigar", "exact"])

    return pairs.select("contig", "piece", "q", "r").mapInArrow(run, f"contig {pairs.schema['contig'].dataType.simpleString()}, piece int, cigar string, exact boolean")


@F.pandas_udf(StringType())
def _one_cigar(parts: pd.Series) -> pd.Series:
    return parts.map(lambda text: alignment.cigar_of(alignment.ops_of(text)))


def _bases(kinds: str) -> Column:
    """The sum of the runs of some kinds of operations in a cigar."""
    runs = F.regexp_extract_all("cigar", F.lit(rf"(\d+)[{kinds}]"), F.lit(1))
    return F.aggregate(runs, F.lit(0).cast("long"), lambda total, n: total + n.cast("long"))


def aligned(contigs: DataFrame, references: DataFrame, placed: DataFrame, config: Config, step: int = STEP) -> DataFrame:
    """contig, reference, strand, q_start, q_end, start, end, matches, columns, cost, cigar, exact: each placed contig against its place.

    contigs: contig (tells them apart), name, seq; references: name (tells them apart), seq; placed: order.placements() of them. Places are of the contig as
    it was turned for its strand, from its first hash on the chain to the end of its last one; what lies outside is not aligned. The cigar (=, X, I, D) turns
    that part of the reference into that part of the contig, at the least affine cost of each stretch between hashes that are at least step bases apart;
    exact is false if a stretch was too large for that (its alignment holds, but a cheaper one may exist). Contigs without a place don't come.
    """
    k = config.kmer
    top = placed.where("status = 'placed'").select("contig", "reference", "strand")
    hits = cut(order.on_diagonals(_shared_places(contigs, references, top, config), config).join(top, ["contig", "reference", "strand"]))
    best = order.best_bins(hits, k).select("contig", "reference", "strand", "bin")
    q = F.when(F.col("strand") == "-", F.col("length") - k - F.col("qpos")).otherwise(F.col("qpos")).cast("long").alias("q")
    own = hits.join(best, ["contig", "reference", "strand", "bin"]).groupBy("contig", "reference").agg(F.collect_list(F.struct(q, F.col("pos").cast("long").alias("p"))).alias("hits"))  # no more than a contig has hashes in a bin
    pieces = cut(_segments(own, k, step))
    ids = ["contig", "piece"]
    on_contigs = stretches(placed.where("status = 'placed'").select("contig", F.upper("seq").alias("seq")), pieces.select(*ids, F.col("q0").alias("start"), F.col("q1").alias("end")), "contig", ids, "q")
    on_references = stretches(references.select(F.col("name").alias("reference"), F.upper("seq").alias("seq")), pieces.select(*ids, "reference", F.col("p0").alias("start"), F.col("p1").alias("end")), "reference", ids, "r")
    done = _aligned_pieces(on_contigs.join(on_references, ids))
    extents = pieces.groupBy("contig").agg(F.min("q0").alias("q_start"), F.max("q1").alias("q_end"), F.min("p0").alias("start"), F.max("p1").alias("end"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "cigar"))), lambda p: p["cigar"]), "")
    whole = done.groupBy("contig").agg(joined.alias("parts"), F.min("exact").alias("exact")).select("contig", "exact", _one_cigar("parts").alias("cigar"))
    gaps = F.size(F.regexp_extract_all("cigar", F.lit(r"(\d+)[ID]"), F.lit(1)))
    cost = alignment.MISMATCH * _bases("X") + alignment.OPENING * gaps + alignment.EXTENDING * _bases("ID")
    return top.join(extents, "contig").join(whole, "contig").select(
        "contig", "reference", "strand", "q_start", "q_end", "start", "end", _bases("=").alias("matches"), _bases("=XID").alias("columns"), cost.cast("long").alias("cost"), "cigar", "exact")
