import random
from collections import Counter

import numpy as np
import pytest

from strandloom.functions import kernels as kn

RC = str.maketrans("ACGT", "TGCA")


def dna(n, seed=0, letters="ACGT"):
    r = random.Random(seed)
    return "".join(r.choice(letters) for _ in range(n))


def plain_murmur3(data, seed):
    mask, c1, c2 = (1 << 64) - 1, 0x87C37B91114253D5, 0x4CF5AD432745937F
    turn = lambda x, r: (x << r | x >> (64 - r)) & mask

    def mixed(x):
        for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ x >> 33) * by & mask
        return x ^ x >> 33

    a = b = seed
    for at in range(0, len(data) + 1, 16):
        part = data[at : at + 16]
        one, two = int.from_bytes(part[:8], "little"), int.from_bytes(part[8:], "little")
        one, two = turn(one * c1 & mask, 31) * c2 & mask, turn(two * c2 & mask, 33) * c1 & mask
        if len(part) < 16:
            a, b = a ^ one, b ^ two
            break
        a = ((turn(a ^ one, 27) + b) * 5 + 0x52DCE729) & mask
        b = ((turn(b ^ two, 31) + a) * 5 + 0x38495AB5) & mask
    a, b = a ^ len(data), b ^ len(data)
    a = (a + b) & mask
    b = (b + a) & mask
    return (mixed(a) + mixed(b)) & 0xFFFFFFFF


def test_murmur_known_values():
    row = lambda *xs: np.array([list(x) for x in xs], np.uint8).reshape(len(xs), -1)
    assert kn.murmur3_low32(row(b""), 0).tolist() == [0]
    assert kn.murmur3_low32(row(b"hello", b"hello"), 0).tolist() == [0xCBD8A7B341BD9B02 & 0xFFFFFFFF] * 2
    for size in (1, 8, 9, 15, 16, 17, 31, 32, 40):
        data = [bytes(random.Random(size * 7 + i).choices(range(256), k=size)) for i in range(5)]
        assert kn.murmur3_low32(row(*data), 42).tolist() == [plain_murmur3(x, 42) for x in data]


@pytest.mark.parametrize("k", [1, 12, 16, 21])
def test_murmur_hashes_of_both_strands(k):
    seq = dna(400, k).replace("A", "N", 2).encode()
    turned = seq.translate(bytes.maketrans(b"ACGT", b"TGCA"))[::-1]
    pairs = [(plain_murmur3(seq[i : i + k], 42), plain_murmur3(turned[len(seq) - i - k : len(seq) - i], 42)) for i in range(len(seq) - k + 1)]
    assert kn.kmer_hashes(seq, k, "murmur3", 42, only_acgt=False).tolist() == [min(p) if p[0] != p[1] else int(kn.NONE) for p in pairs]


def test_hashes_are_those_of_both_strands_and_skip_palindromes():
    seq = dna(60) + "N" + "ACGT" + dna(20, 1)
    for name in ("splitmix", "md5_60", "murmur3"):
        h = kn.kmer_hashes(seq.encode(), 4, name)
        assert (h[::-1] == kn.kmer_hashes(seq.translate(RC)[::-1].encode(), 4, name)).all()
        for i in range(len(h)):
            f = seq[i : i + 4]
            assert (h[i] == kn.NONE) == ("N" in f or f == f.translate(RC)[::-1])


def test_window_minimizers_against_each_window():
    h = kn.kmer_hashes(dna(300, 3, "ACGTN" + "ACGT" * 9).encode(), 5)
    for w in (1, 2, 5, 8, 13):
        least = [h[i : i + w].min() for i in range(len(h) - w + 1)]
        want = [(x, i) for i, x in enumerate(least) if x != kn.NONE and (i == 0 or x != least[i - 1])]
        got = kn.window_minimizers(h, w)
        assert list(zip(got[0].tolist(), got[1].tolist())) == want


def test_exact_minimizers_show_each_minimum_once():
    h = kn.kmer_hashes(dna(300, 4).encode(), 5)
    w = 6
    hashes, places = kn.exact_minimizers(h, w)
    seen, want = set(), []
    for i in range(w - 1, len(h)):
        if h[i] == kn.NONE:
            continue
        inside = [j for j in range(i - w + 1, i + 1) if h[j] != kn.NONE]
        best = min(inside, key=lambda j: (h[j], -j))
        if best not in seen:
            seen.add(best)
            want.append((int(h[best]), i + 1 - w))
    assert list(zip(hashes, places)) == want


def test_minmer_intervals_against_each_window():
    h = kn.kmer_hashes(dna(200, 5).encode(), 4)
    values = h[h != kn.NONE].tolist()
    for window, s in ((20, 4), (30, 50), (7, 1)):
        member = Counter()
        for x, start, end in kn.minmer_intervals(h, window, s):
            assert start < end
            member.update((x, at) for at in range(start, end))
        want = {(x, at) for at in range(len(values) - window + 1) for x in sorted(set(values[at : at + window]))[:s]}
        assert set(member) == want and max(member.values()) == 1


def test_sliding_sketch_is_the_bottom_of_the_union():
    r = random.Random(6)
    query = r.sample(range(100), 12)
    sketch, held = kn.SlidingSketch(query), []
    for _ in range(400):
        if held and r.random() < 0.5:
            sketch.remove(held.pop(r.randrange(len(held))))
        else:
            held.append(r.randrange(100))
            sketch.add(held[-1])
        low = sorted(set(query) | set(held))[: len(query)]
        assert sketch.count() == len(set(low) & set(query) & set(held))


def test_sliding_sketch_counts_repeats():
    sketch = kn.SlidingSketch([10, 20, 30])
    counts = [0]
    for step in (1, 1, -1, -1):
        sketch.add(20) if step > 0 else sketch.remove(20)
        counts.append(sketch.count())
    assert counts == [0, 1, 1, 1, 0]


def plain_shared(query, held):
    low = sorted(set(query) | set(held))[: len(query)]
    return len(set(low) & set(query) & set(held))


def plain_best_window(query, hashes, places, span, first, last, length):
    """The windows one after the other, each with its own set."""
    later = [i for i, p in enumerate(places) if p >= first]
    if not later or span <= 0 or not query:
        return None
    stop, at, found = sum(p < last + length for p in places), places[later[0]], []
    while at <= last:
        begin, end = max(i for i, p in enumerate(places) if p <= at and i < stop or i == later[0]), sum(p < at + span for p in places)
        if end >= stop:
            break
        found.append((plain_shared(query, hashes[begin:end]), places[begin]))
        at = min([p for p in places[begin + 1 : stop]] + [p - span + 1 for p in places[end:]])
    most = max((s for s, _ in found), default=0)
    same = [p for s, p in found if s == most]
    return (most, (same[0] + same[-1]) // 2) if most else None


def test_best_window_against_plain_windows():
    r = random.Random(12)
    for _ in range(400):
        places = sorted(r.sample(range(120), r.randrange(1, 40)))
        hashes, query = [r.randrange(30) for _ in places], sorted(r.sample(range(30), r.randrange(1, 9)))
        first = r.randrange(110)
        case = (query, hashes, places, r.randrange(1, 40), first, first + r.randrange(40), r.randrange(1, 60))
        assert kn.best_window(*case) == plain_best_window(*case), case


def test_best_interval_window_against_plain_windows():
    r = random.Random(13)
    for _ in range(200):
        query, first = sorted(r.sample(range(30), r.randrange(1, 9))), r.randrange(50)
        rows = [(r.randrange(30), a, a + r.randrange(1, 30)) for a in r.choices(range(80), k=r.randrange(0, 40))]
        last = first + r.randrange(40)
        each = [plain_shared(query, [h for h, a, b in rows if a <= at < b]) for at in range(first, last + 1)]
        same = [at for at, s in zip(range(first, last + 1), each) if s == max(each)]
        got = kn.best_interval_window(query, rows, first, last)
        assert got == (max(each), (same[0] + same[-1]) // 2)


def test_best_window_does_not_score_past_the_last_end():
    assert kn.best_window([10, 20, 30], [10, 20, 30], [0, 5, 11], 10, 0, 1, 10) is None


def test_best_window_finds_the_copy():
    h = kn.kmer_hashes(dna(3000, 7).encode(), 12)
    hashes, places = kn.window_minimizers(h, 10)
    piece = kn.window_minimizers(h[1000:1200], 10)
    query = sorted(set(piece[0].tolist()))
    most, at = kn.best_window(query, hashes.tolist(), places.tolist(), 190, 800, 1300, 211)
    assert most >= len(query) - 2 and abs(at - 1000) < 20


def test_gap_chain():
    """The steady diagonal wins; a hit that drifts too far and one that goes back on the query stay out."""
    refs, queries = np.array([7_013, 7_040, 7_066, 7_093, 7_101, 7_130, 9_900]), np.array([31, 58, 84, 111, 5, 149, 160])
    assert kn.gap_chain(refs, queries, 4, 800, 900, 50).tolist() == [[7_013, 31], [7_040, 58], [7_066, 84], [7_093, 111], [7_130, 149]]
    assert len(kn.gap_chain(refs, queries, 6, 800, 900, 50)) == 0
    assert len(kn.gap_chain(np.zeros(0, int), np.zeros(0, int), 1, 10, 10, 10)) == 0


@pytest.mark.parametrize("block", [1, 2, 256])
def test_optimal_chain_against_all_chains(monkeypatch, block):
    monkeypatch.setattr(kn, "CHAIN_BLOCK", block)
    r = random.Random(8)
    for _ in range(30):
        hits = sorted({(r.randrange(60), r.randrange(40)) for _ in range(7)})
        k, length = 4, 44

        def cost(chain):
            total = chain[0][1] + max(0, length - chain[-1][1] - k)
            for (a, b), (c, d) in zip(chain, chain[1:]):
                total += max(c - a - k, d - b - k, 0) + abs(max(0, k - c + a) - max(0, k - d + b))
            return total

        chains = [[h] for h in hits]
        for chain in chains:
            chains += [chain + [h] for h in hits if h[0] > chain[-1][0] and h[1] > chain[-1][1]]
        best = min((cost(c), -len(c)) for c in chains)
        got = kn.optimal_chain(*np.array(hits).T, k, length, 1).tolist()
        assert (cost(got), -len(got)) == best


@pytest.mark.parametrize("spread", [(40, 30), (400, 300), (4_000, 3_000)])
def test_halves_of_a_chain_equal_pairs(monkeypatch, spread):
    """Blocks of any size give the chain that comparing all pairs gives, ties included."""
    r = random.Random(5)
    hits = np.array(sorted({(1_000_000 + r.randrange(spread[0]), r.randrange(spread[1])) for _ in range(600)}))
    monkeypatch.setattr(kn, "CHAIN_BLOCK", 10_000)
    want = kn.optimal_chain(*hits.T, 14, spread[1], 1)
    for block in (1, 7, 100):
        monkeypatch.setattr(kn, "CHAIN_BLOCK", block)
        assert kn.optimal_chain(*hits.T, 14, spread[1], 1).tolist() == want.tolist()


def test_optimal_chain_of_a_repeat():
    """A hundred thousand hits of one bin, as a long repeat gives them."""
    r = np.random.default_rng(2)
    refs, queries = r.integers(0, 4_000, 100_000), r.integers(0, 3_000, 100_000)
    chain = kn.optimal_chain(refs, queries, 16, 3_000, 3)
    assert (np.diff(chain, axis=0) > 0).all() and len(chain) > 100
