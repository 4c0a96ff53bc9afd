"""Table functions in SQL give what the operators give."""

import random

from strandloom.operators import sketch
from strandloom.plans import table_functions


def test_lateral_joins(spark):
    r = random.Random(1)
    rows = [("g", i, "".join(r.choices("ACGTN", weights=[9, 9, 9, 9, 1], k=n))) for i, n in enumerate([0, 5, 40, 700, 2_000])] + [("g", 9, None)]
    seqs = spark.createDataFrame(rows, "genome string, contig long, seq string").repartition(3)
    seqs.createOrReplaceTempView("some_sequences")
    table_functions.register(spark)
    got = spark.sql("SELECT genome, contig, m.hash, m.pos FROM some_sequences, LATERAL minimizers(seq, 12, 8) m")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sketch.minimizers(seqs, ["genome", "contig"], 12, 8).select("genome", "contig", "hash", "pos").collect()))
    tiles = spark.sql("SELECT contig, t.frag, t.start, t.tile FROM some_sequences, LATERAL tiles(seq, 100) t WHERE contig > 2")
    assert sorted(map(tuple, tiles.collect())) == [(i, n, n * 100, s[n * 100 : n * 100 + 100]) for _, i, s in rows if s and i > 2 for n in range(len(s) // 100)]
