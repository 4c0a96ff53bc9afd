"""The whole way from sequences to mappings and identities of pairs, fragment by fragment in plain Python, in every mode."""

import random
from collections import defaultdict

import numpy as np
import pytest
from test_kernels import plain_best_window, plain_shared

from strandloom.config import Config
from strandloom.functions import kernels as kn
from strandloom.functions import statistics as st
from strandloom.plans.compare import compare, compare_split, map_fragments

NONE = int(kn.NONE)


def data(seed):
    """Genomes that share stretches, turned ones and repeats among them, with other letters than ACGT and contigs shorter than a fragment."""
    r = random.Random(seed)
    dna = lambda n: "".join(r.choices("ACGT", k=n))
    mutated = lambda s, rate: "".join(c if r.random() > rate else r.choice("ACGT") for c in s)
    turned = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    base, repeat = dna(900), dna(60)
    references = [("r1", 0, base), ("r1", 1, mutated(base[300:700], 0.04) + dna(90)), ("r2", 0, dna(120) + turned(base[100:600]) + "NNN" + dna(50)), ("r3", 0, dna(40) + repeat * 6 + base[:200]), ("r3", 1, dna(70)), ("r4", 0, dna(500))]
    queries = [("q1", 0, base[150:640]), ("q1", 1, "ACG"), ("q1", 2, mutated(base[400:760], 0.06)), ("q2", 0, repeat * 3 + dna(130)), ("q2", 4, dna(60) + "N" + base[20:190]), ("q3", 0, dna(80))]
    return queries, references


def plain_sketch(seq, c, size):
    """(hash: first place) of a fragment."""
    h = kn.kmer_hashes(seq.encode(), c.kmer, c.hash, c.seed, only_acgt=c.mode != "exact").tolist()
    first = {}
    if c.mode == "minmer":
        for at, x in enumerate(h):
            if x != NONE:
                first.setdefault(x, at)
        return {x: first[x] for x in sorted(first)[:size]}
    for x, at in plain_minimizers(seq, c):
        first.setdefault(x, at)
    return first


def plain_minimizers(seq, c):
    w = c.resolved_window()
    h = kn.kmer_hashes(seq.encode(), c.kmer, c.hash, c.seed, only_acgt=c.mode != "exact")
    if c.mode == "exact":
        return list(zip(*kn.exact_minimizers(h, w))) if len(seq) >= w else []
    least = [min(h[i : i + w].tolist()) for i in range(len(h) - w + 1)]
    return [(x, i) for i, x in enumerate(least) if x != NONE and (i == 0 or x != least[i - 1])]


def united(ranges, gap):
    out = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def plain_candidates(sketch, least, minimizers, c, length):
    hits = sorted((at, sketch[x]) for x, at in minimizers if x in sketch)
    if c.mode == "exact":
        pairs = [(hits[i][0], hits[i + least - 1][0]) for i in range(len(hits) - least + 1)]
        return united([(max(b - (length - 1), 0), a) for a, b in pairs if b - a < length], 0)
    bins = defaultdict(list)
    for at, q in hits:
        bins[(at - q) // c.diagonal_bin].append((at, q))
    ranges = []
    for some in bins.values():
        if len({q for _, q in some}) < least:
            continue
        for reverse in (False, True):
            refs, places = np.array([a for a, _ in some]), np.array([max(max(length - q, 0) - c.kmer, 0) if reverse else q for _, q in some])
            chain = kn.optimal_chain(refs, places, c.kmer, length, least) if c.optimal_chain else kn.gap_chain(refs, places, least, max(c.max_gap, length + c.kmer), max(c.diagonal_tolerance, 8 * c.kmer), c.max_predecessors)
            if len({q for _, q in chain.tolist()}) >= least:
                ranges += [(max(max(a - q, 0) - c.diagonal_band, 0), max(a - q, 0) + c.diagonal_band) for a, q in chain.tolist()]
    return united(ranges, 1)


def plain_windows(seq, c, size):
    """The least hashes of each window of a sequence, by its place, for the runs of ACGT that hold one."""
    window, held, at = c.fragment - c.kmer + 1, {}, 0
    for run in seq.replace("N", " ").split(" "):
        h = [x for x in kn.kmer_hashes(run.encode(), c.kmer, c.hash, c.seed).tolist() if x != NONE] if len(run) >= c.kmer + window - 1 else []
        for i in range(len(h) - window + 1):
            held[at + i] = sorted(set(h[i : i + window]))[: min(size, window)]
        at += len(run) + 1
    return held


def plain_map(queries, references, c):
    size, found, length, w = c.minmer_sketch(), [], c.fragment, c.resolved_window()
    for query in sorted({g for g, _, _ in queries}):
        tiles = [s[a : a + length] for g, _, s in sorted(queries) if g == query for a in range(0, len(s) - length + 1, length)]
        for frag, tile in enumerate(tiles):
            sketch = plain_sketch(tile, c, size)
            if not sketch:
                continue
            least, ordered = max(1, st.relaxed_minimum_hits(len(sketch), c.kmer, c.min_identity, c.model)), sorted(sketch)
            for genome, contig, seq in references:
                best = []
                if c.mode == "minmer":
                    held = plain_windows(seq, c, size)
                    for a, b in united([(t, t) for t, x in held.items() if len(set(x) & set(sketch)) >= least], 1):
                        each = [plain_shared(ordered, held.get(t, [])) for t in range(a, b + 1)]
                        same = [a + i for i, x in enumerate(each) if x == max(each)]
                        best.append((max(each), (same[0] + same[-1]) // 2))
                else:
                    minimizers = plain_minimizers(seq, c)
                    for a, b in plain_candidates(sketch, least, minimizers, c, length):
                        near = [(x, at) for x, at in minimizers if a <= at <= b + length - 1]
                        if near:
                            best.append(plain_best_window(ordered, [x for x, _ in near], [at for _, at in near], length - (w - 1) - (c.kmer - 1), a, b, length))
                for shared, start in filter(None, best):
                    identity, upper = st.distance_rows(len(sketch), c.kmer, c.model)[shared][1:]
                    if upper >= c.min_identity:
                        found.append((query, frag, genome, contig, len(sketch), shared, start, start + length - 1, identity))
    return found


def plain_compare(mapped, queries, references, c):
    first, second = {}, {}
    for m in mapped:
        key = (m[0], m[2], m[1])
        first[key] = max(first.get(key, m), m, key=lambda x: (x[8], x[3], x[6]))
    for m in first.values():
        key = (m[0], m[2], m[3], m[6] // max(1, c.fragment - 20))
        second[key] = max(second.get(key, m), m, key=lambda x: (x[8], x[1]))
    pairs, lengths = defaultdict(list), defaultdict(int)
    for m in second.values():
        pairs[m[0], m[2]].append(m[8])
    for g, _, s in queries + references:
        lengths[g] += len(s)
    fragments = {g: sum(len(s) // c.fragment for x, _, s in queries if x == g) for g in lengths}
    rows = [(q, g, round(sum(x) / len(x), 9), len(x), fragments[q]) for (q, g), x in pairs.items() if len(x) * c.fragment >= min(lengths[q], lengths[g]) * c.min_fraction]
    return sorted(rows)


MODES = [{}, {"optimal_chain": True, "model": "binomial"}, {"mode": "exact", "hash": "murmur3"}, {"mode": "minmer", "model": "binomial"}]


@pytest.mark.parametrize("more", MODES, ids=["window", "optimal", "exact", "minmer"])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain(spark, more, seed):
    queries, references = data(seed)
    config = Config(**({"kmer": 8, "fragment": 60, "window": 6, "min_identity": 75, "min_fraction": 0.15, "reference_size": 3_000, "diagonal_bin": 30, "diagonal_band": 12, "max_gap": 100, "diagonal_tolerance": 40} | more)).checked()
    frames = [spark.createDataFrame([(g, c, f"{g}{c}", s) for g, c, s in rows], "genome string, contig long, name string, seq string").repartition(3) for rows in (queries, references)]
    mapped = plain_map(queries, references, config)
    got = map_fragments(*frames, config).collect()
    shown = lambda rows: sorted((*r[:8], round(r[8], 9)) for r in rows)
    assert shown((r["query"], r.frag, r.genome, r.contig, r.sketch_size, r.shared, r.start, r.end, r.identity) for r in got) == shown(mapped)
    assert len(mapped) > 5
    want = plain_compare(mapped, queries, references, config)
    assert sorted((r["query"], r.reference, round(r.ani, 9), r.mapped, r.fragments) for r in compare(*frames, config).collect()) == want
    assert sorted((r["query"], r.reference, round(r.ani, 9), r.mapped, r.fragments) for r in compare_split(*frames, config, 2).collect()) == want
