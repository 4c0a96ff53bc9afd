"""Table functions for SQL: minimizers and fragments of a sequence, for lateral joins."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from strandloom.functions import kernels


@udtf(returnType="hash long, pos long")
class Minimizers:
    """minimizers(seq, k, w, hash): the window minimizers of a sequence, as sketch.minimizers has them; none for a null. (Spark's lateral joins take no Arrow table functions.)"""

    def eval(self, seq: str, k: int, w: int, hash: str = "splitmix") -> Iterator[tuple[int, int]]:
        hashes, places = kernels.window_minimizers(kernels.kmer_hashes((seq or "").encode(), k, hash), w)
        yield from zip(hashes.tolist(), places.tolist())


@udtf(returnType="frag long, start long, tile string")
class Tiles:
    """tiles(seq, length): whole fragments of a sequence from its start."""

    def eval(self, seq: str, length: int) -> Iterator[tuple[int, int, str]]:
        for n in range(len(seq or "") // length):
            yield n, n * length, seq[n * length : (n + 1) * length]


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL: SELECT ... FROM sequences, LATERAL minimizers(seq, 16, 24)."""
    spark.udtf.register("minimizers", Minimizers)
    spark.udtf.register("tiles", Tiles)
