"""What bounds memory and repeated work where tables are large."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from strandloom.config import Config
from strandloom.functions import kernels as kn
from strandloom.operators import sketch
from strandloom.plans import compare, registry

def dna(r, n, letters="ACGT"):
    return "".join(r.choices(letters, k=n))


@pytest.mark.parametrize("lane", [1, 5, 128])
def test_minmers_of_many_runs(monkeypatch, lane):
    monkeypatch.setattr(kn, "LANE", lane)
    r = np.random.default_rng(3)
    for window, s, top in ((9, 3, 40), (9, 8, 1 << 61), (1, 1, 3), (20, 50, 9)):
        lengths = r.integers(0, 70, 7)
        values = r.integers(0, top, lengths.sum()).astype(np.uint64)
        want, at = set(), 0
        for n in lengths.tolist():
            want |= {(x, t) for t in range(at, at + n - window + 1) for x in sorted(set(values[t : t + window].tolist()))[:s]}
            at += n
        found = [x.tolist() for x in kn.minmers_of_runs(values, lengths, window, s)]
        rows = sorted(zip(*found))
        assert {(x, t) for x, a, b in rows for t in range(a, b)} == want
        edges = set(np.cumsum(lengths).tolist())
        assert sum(b - a for _, a, b in rows) == len(want)
        assert not {(x, b) for x, _, b in rows if b not in edges} & {(x, a) for x, a, _ in rows}  # stretches that touch are one


def test_minmer_comparison_keeps_no_intervals_of_the_references(spark, monkeypatch):
    r = random.Random(5)
    refs = [("r%d" % i, i, "r%d" % i, dna(r, 1500)) for i in range(6)]
    queries = [("q", 0, "q", refs[2][3][200:900])]
    schema = "genome string, contig long, name string, seq string"
    references, asked = spark.createDataFrame(refs, schema), spark.createDataFrame(queries, schema)
    config = Config(kmer=12, fragment=150, min_fraction=0.0, window=8, mode="minmer")
    kept = []
    cut = compare.cut

    def counted(df):
        out = cut(df)
        kept.append(out.count())
        return out

    monkeypatch.setattr(compare, "cut", counted)
    found = compare.compare(asked, references, config).collect()
    assert [(x.reference, x.mapped) for x in found] == [("r2", 4)]
    assert max(kept) < compare.reference_index(references, config).count() / 2


def test_rows_of_a_batch_are_bounded(spark):
    r = random.Random(6)
    rows = spark.createDataFrame([(i, dna(r, 6000)) for i in range(150)], "contig long, seq string").coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    got = [x.n for x in sketch.minimizers(rows, ["contig"], 12, 2).mapInArrow(sizes, "n long").collect()]
    assert sum(got) > sketch.ROWS >= max(got) and len(got) > 5
    assert list(sketch._pieces([b"A" * 50_000] * 5)) == [(0, 2), (2, 4), (4, 5)]


DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_threshold_queries_read_kept_pairs(spark):
    nodes, pairs = registry._averaged(spark, DATA)
    assert "MapInArrow" not in plan(pairs) + plan(nodes) and "parquet" not in plan(pairs) + plan(nodes).lower()
    assert "MapInArrow" not in plan(registry._genome_pairs(spark, DATA))


def test_bottom_minimizers_are_those_of_all_rows(spark):
    r = random.Random(7)
    rows = spark.createDataFrame([("g%d" % (i % 3), dna(r, r.randrange(0, 300))) for i in range(80)] + [(None, dna(r, 90)), ("g1", None)], "genome string, seq string").repartition(3)
    for size in (1, 20, 5000):
        got = sketch.bottom_minimizers(rows, "genome", size, 8, 4, "md5_60").collect()
        want = sketch.bottom_sketch(sketch.minimizers(rows, ["genome"], 8, 4, "md5_60"), "genome", size).collect()
        assert sorted(map(str, got)) == sorted(map(str, want)) and got


@pytest.mark.parametrize("k", [3, 12, 13, 31, 32])
def test_md5_of_kmers_keeps_bounded_tables(monkeypatch, k):
    monkeypatch.setattr(kn, "SLOTS", 64)
    monkeypatch.setattr(kn, "MD5_BLOCK", 50)
    monkeypatch.setattr(kn, "_kept", {})
    by = lambda x: int(hashlib.md5(x).hexdigest()[:15], 16)
    seq = (dna(random.Random(k), 400) + "NAC" + dna(random.Random(k), 200) + "ACGT" * 10).encode()
    for only_acgt in (True, False, True):
        want = []
        for i in range(len(seq) - k + 1):
            x = seq[i : i + k]
            one, other = by(x), by(x.translate(bytes.maketrans(b"ACGT", b"TGCA"))[::-1])
            want.append(int(kn.NONE) if one == other or only_acgt and b"N" in x else min(one, other))
        assert kn.kmer_hashes(seq, k, "md5_60", only_acgt=only_acgt).tolist() == want
    assert len(kn._kept[k][0]) == (4**k if k <= 12 else 64)


def test_density_of_repeated_contigs(spark):
    r = random.Random(8)
    texts = [dna(r, 200) for _ in range(20)]
    rows = [(i % 17, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, texts[1]), (40, "ACG"), (41, texts[3])]
    table = spark.createDataFrame(rows, "contig long, seq string")
    want = {}
    for x in sketch.minimizers(table, ["contig"], 12, 8, "md5_60").collect():
        want.setdefault(x.contig, []).append((x.hash, x.pos))
    got = {x.contig: tuple(x)[1:] for x in sketch.density(table, "contig", 12, 8, "md5_60").collect()}
    assert got == {c: (len(m), len({h for h, _ in m}), min(p for _, p in m), max(p for _, p in m), sum(h % 1000003 for h, _ in m)) for c, m in want.items()}


def test_range_join_shuffles_no_minimizers(spark):
    found = registry.candidate_range_join(spark, DATA)
    assert "SortMergeJoin" not in plan(found) and "LeftSemi" in plan(found)


def test_minmer_intervals_of_pieces(spark):
    r = random.Random(9)
    texts = ["".join(r.choices("ACGT" * 8 + "N", k=r.randrange(0, 400))) for _ in range(30)] + ["", "ACGT" * 30, "A" * 50]
    rows = spark.createDataFrame(list(enumerate(texts)), "contig long, seq string").coalesce(1)
    want = []
    for i, t in enumerate(texts):
        for run in re.finditer("[ACGT]+", t):
            if len(run[0]) >= 6 + 15 - 1:
                want += [(i, h, run.start() + a, run.start() + b) for h, a, b in kn.minmer_intervals(kn.kmer_hashes(run[0].encode(), 6), 15, 4)]
    got = [tuple(x) for x in sketch.minmer_intervals(rows, ["contig"], 6, 15, 4).collect()]
    assert sorted(got) == sorted(want) and len(want) > 500
    some = np.array(sorted({x[1] for x in want})[::3], np.uint64)
    assert sorted(tuple(x) for x in sketch.minmer_intervals(rows, ["contig"], 6, 15, 4, only=some).collect()) == sorted(x for x in want if x[1] in set(some.tolist()))
