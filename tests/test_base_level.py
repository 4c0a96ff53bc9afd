"""Alignments of bases: each replays to both sequences, and costs what the full programme over all cells costs."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.config import Config
from strandloom.functions import alignment, kernels
from strandloom.operators import base_level, order
from strandloom.sources import sinks

SEQS = "genome string, contig int, name string, seq string, seq_raw string"
TURN = str.maketrans("ACGTacgt", "TGCAtgca")


def full_cost(q, r):
    """The least affine cost, by all cells."""
    far, first, more = 10**9, alignment.OPENING + alignment.EXTENDING, alignment.EXTENDING
    best, left, up = ([[far] * (len(r) + 1) for _ in range(len(q) + 1)] for _ in range(3))
    best[0][0] = 0
    for i in range(len(q) + 1):
        for j in range(len(r) + 1):
            if j:
                left[i][j] = min(best[i][j - 1] + first, left[i][j - 1] + more)
            if i:
                up[i][j] = min(best[i - 1][j] + first, up[i - 1][j] + more)
            through = best[i - 1][j - 1] + alignment.MISMATCH * (q[i - 1] != r[j - 1]) if i and j else far
            best[i][j] = min(best[i][j], through, left[i][j], up[i][j])
    return best[-1][-1]


def replay(cigar, q, r):
    """Whether the operations walk both sequences to their ends, each = over equal bases and each X over different ones."""
    i = j = 0
    for n, op in alignment.ops_of(cigar):
        if op in "=X" and any((q[i + k] == r[j + k]) != (op == "=") for k in range(n)):
            return False
        i, j = i + n * (op in "=XI"), j + n * (op in "=XD")
    return (i, j) == (len(q), len(r))


def edited(seq, r, edits, longest):
    seq = list(seq)
    for _ in range(edits):
        at, n = r.randrange(len(seq) + 1), r.randrange(1, longest)
        kind = r.random()
        if kind < 0.5:
            seq[at : at + 1] = r.choice("ACGT")
        elif kind < 0.75:
            del seq[at : at + n]
        else:
            seq[at:at] = r.choices("ACGT", k=n)
    return "".join(seq)


@settings(max_examples=150, deadline=None)
@given(st.text("AC", max_size=40), st.integers(0, 10), st.integers(0, 10**6))
def test_least_cost_against_all_cells(r, edits, seed):
    q = edited(r, random.Random(seed), edits, 30)
    ops, exact = alignment.align(q.encode(), r.encode())
    cigar = alignment.cigar_of(ops)
    assert exact and replay(cigar, q, r) and alignment.cost_of(alignment.ops_of(cigar)) == full_cost(q, r)


def test_a_stretch_with_too_many_cells_still_replays():
    r = random.Random(1)
    one, other = "".join(r.choices("ACGT", k=300)), "".join(r.choices("ACGT", k=280))
    for cells in (10, 20_000):  # no band fits; only the first band fits
        ops, exact = alignment.align(one.encode(), other.encode(), cells)
        assert not exact and replay(alignment.cigar_of(ops), one, other)


def test_chain_against_all_runs():
    r = random.Random(2)
    for _ in range(200):
        hits = [(r.randrange(9), r.randrange(9)) for _ in range(r.randrange(1, 8))]
        got = alignment.chain(hits, 1)
        rising = lambda run: all(a[0] < b[0] and a[1] < b[1] for a, b in zip(run, run[1:]))
        runs = [[h for k, h in enumerate(sorted(set(hits))) if mask >> k & 1] for mask in range(1, 1 << len(set(hits)))]
        assert rising(got) and set(got) <= set(hits) and len(got) == max(len(run) for run in runs if rising(run))
    assert alignment.chain([(i, i) for i in range(100)], 40) == [(0, 0), (40, 40), (80, 80), (99, 99)]


def test_places_of_minima_are_those_of_both_strands():
    r = random.Random(5)
    for n, w in ((60, 5), (200, 9), (20, 30), (40, 1)):
        seq = "".join(r.choices("AC" if n == 60 else "ACGTN", [9, 9] if n == 60 else [9, 9, 9, 9, 1], k=n))
        hashes = kernels.kmer_hashes(seq.encode(), 6, "splitmix", 42)
        want = {i for j in range(len(hashes) - w + 1) for i in range(j, j + w) if hashes[i] == min(hashes[j : j + w]) != kernels.NONE}
        got = kernels.minimizer_places(hashes, w)
        assert got[1].tolist() == sorted(want) and (got[0] == hashes[got[1]]).all()
        back = kernels.minimizer_places(kernels.kmer_hashes(seq.translate(TURN)[::-1].encode(), 6, "splitmix", 42), w)
        assert sorted(zip(got[0].tolist(), (n - 6 - got[1]).tolist())) == sorted(zip(*map(lambda x: x.tolist(), back)))


def test_stretches_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(base_level, "TILE", 7)
    texts = {"a": "".join(random.Random(3).choices("ACGT", k=50)), "b": "ACGTACG", "c": "", "d": None}
    wanted = [(i, k, lo, hi) for i, (k, lo, hi) in enumerate([("a", 0, 50), ("a", 6, 8), ("a", 7, 14), ("a", 49, 50), ("b", 0, 7), ("b", 3, 3), ("c", 0, 1), ("d", 0, 1), ("none", 0, 3)])]
    got = base_level.stretches(spark.createDataFrame(list(texts.items()), "name string, seq string"), spark.createDataFrame(wanted, "id int, name string, start long, end long"), "name", ["id"], "text")
    assert dict(map(tuple, got.collect())) == {i: texts[k][lo:hi] for i, k, lo, hi in wanted[:5]}


def test_placed_contigs_base_by_base(spark, monkeypatch):
    monkeypatch.setattr(base_level, "TILE", 1_000)
    r = random.Random(4)
    refs = {"one": "".join(r.choices("ACGT", k=12_000)), "two": "".join(r.choices("ACGT", k=9_000))}
    parts = [edited(refs["one"][1000:4000], r, 40, 12), edited(refs["one"][6000:9500], r, 60, 5), edited(refs["two"][500:6000], r, 30, 60), refs["two"][7000:8000], "".join(r.choices("ACGT", k=2000)), ""]
    parts[1], parts[2] = parts[1].translate(TURN)[::-1], parts[2].translate(TURN)[::-1]
    contigs = spark.createDataFrame([("c", i, f"n{i}", p, p.lower() if i == 2 else p) for i, p in enumerate(parts)], SEQS)
    references = spark.createDataFrame([("r", i, n, s, s) for i, (n, s) in enumerate(refs.items())], SEQS)
    config = Config(window=10)
    placed = order.placements(contigs, order.alignments(contigs, references, config)).cache()
    got = base_level.aligned(contigs, references, placed, config, 200).collect()
    assert sorted((x.contig, x.reference, x.strand) for x in got) == [(0, "one", "+"), (1, "one", "-"), (2, "two", "-"), (3, "two", "+")]
    for x in got:
        q = parts[x.contig] if x.strand == "+" else parts[x.contig].translate(TURN)[::-1]
        own, place = q[x.q_start : x.q_end], refs[x.reference][x.start : x.end]
        ops = alignment.ops_of(x.cigar)
        assert x.exact and replay(x.cigar, own, place) and x.q_end - x.q_start > 0.95 * len(q)
        assert all(a[1] != b[1] for a, b in zip(ops, ops[1:])) and x.cost == alignment.cost_of(ops)
        assert x.matches == sum(n for n, op in ops if op == "=") and x.columns == sum(n for n, _ in ops)
    assert [(x.cigar, x.cost) for x in got if x.contig == 3] == [(f"{x.q_end - x.q_start}=", 0) for x in got if x.contig == 3]
    by_name = {line[0].split("\t")[0]: line[0].split("\t") for line in sinks.paf_lines(placed, references, base_level.aligned(contigs, references, placed, config, 200)).collect()}
    assert sorted(by_name) == ["n0", "n1", "n2", "n3"]
    for name, fields in by_name.items():
        q = parts[int(name[1:])]
        own = q[int(fields[2]) : int(fields[3])]
        own = own.translate(TURN)[::-1] if fields[4] == "-" else own
        assert replay(fields[12].removeprefix("cg:Z:"), own, refs[fields[5]][int(fields[7]) : int(fields[8])]) and int(fields[1]) == len(q)
    assert base_level.aligned(contigs, references, placed.limit(0), config).count() == 0
