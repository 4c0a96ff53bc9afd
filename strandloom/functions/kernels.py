"""Array kernels that run inside tasks: k-mer hashes, minimizers, sliding sketches and chains of one sequence or group."""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left, insort
from collections import Counter, deque

import numpy as np

_CODE = np.full(256, 4, np.uint8)
_CODE[[65, 67, 71, 84]] = [0, 1, 2, 3]
_COMPLEMENT = bytes.maketrans(b"ACGT", b"TGCA")
_LETTERS = np.frombuffer(b"ACGT", np.uint8)
NONE, _UNKNOWN = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0xFFFFFFFFFFFFFFFE)
_FAR = np.iinfo(np.int64).max
#: MD5 hashes of k-mers that a Python worker keeps, in powers of two: of all k-mers where there are so few (8 bytes each), or else those met last (16 bytes each).
WHOLE, SLOTS = 1 << 24, 1 << 22
#: K-mers whose MD5 is worked out at a time, so that it stays in a core's cache.
MD5_BLOCK = 1 << 13
_kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _splitmix(x: np.ndarray, seed: int) -> np.ndarray:
    """Well mixed 62-bit hashes of 64-bit codes."""
    with np.errstate(over="ignore"):
        z = x + np.uint64(0x9E3779B97F4A7C15 * (2 * seed + 1) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (z ^ (z >> np.uint64(31))) >> np.uint64(2)


def murmur3_low32(rows: np.ndarray, seed: int = 42) -> np.ndarray:
    """The low 32 bits of MurmurHash3 x64-128, by its public definition, of each row of bytes."""
    n, size = rows.shape
    padded = np.zeros((n, -(-max(size, 1) // 16) * 16), np.uint8)
    padded[:, :size] = rows
    words = padded.view("<u8")
    c1, c2, five = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F), np.uint64(5)

    def rotated(x: np.ndarray, r: int) -> np.ndarray:
        return (x << np.uint64(r)) | (x >> np.uint64(64 - r))

    def last(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))

    h1, h2 = np.full(n, seed, np.uint64), np.full(n, seed, np.uint64)
    for at in range(0, size // 16 * 2, 2):
        h1 ^= rotated(words[:, at] * c1, 31) * c2
        h1 = (rotated(h1, 27) + h2) * five + np.uint64(0x52DCE729)
        h2 ^= rotated(words[:, at + 1] * c2, 33) * c1
        h2 = (rotated(h2, 31) + h1) * five + np.uint64(0x38495AB5)
    if size % 16:  # the rest, with zeros behind it
        h2 ^= rotated(words[:, -1] * c2, 33) * c1
        h1 ^= rotated(words[:, -2] * c1, 31) * c2
    h1, h2 = h1 ^ np.uint64(size), h2 ^ np.uint64(size)
    h1 = h1 + h2
    h2 = h2 + h1
    return (last(h1) + last(h2)) & np.uint64(0xFFFFFFFF)


def _both_strands_murmur(seq: bytes, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k-mer and of its reverse complement, some hundred thousand at a time."""
    n = len(seq) - k + 1
    forward = np.lib.stride_tricks.sliding_window_view(np.frombuffer(seq, np.uint8), k)
    backward = np.lib.stride_tricks.sliding_window_view(np.frombuffer(seq.translate(_COMPLEMENT)[::-1], np.uint8), k)[::-1]
    parts = [[murmur3_low32(side[at : at + (1 << 17)], seed) for at in range(0, n, 1 << 17)] for side in (forward, backward)]
    return np.concatenate(parts[0]), np.concatenate(parts[1])


_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]


def _md5_60(codes: np.ndarray, k: int) -> np.ndarray:
    """The first 60 bits of the MD5 of each k-mer, k up to 32, two bits a base from the last one up."""
    n, words = len(codes), k // 4 + 1
    text = np.zeros((words * 4, n), np.uint8)
    for i in range(k):
        text[i] = _LETTERS[((codes >> np.uint64(2 * (k - 1 - i))) & np.uint64(3)).astype(np.intp)]
    text[k] = 0x80
    message = [np.ascontiguousarray(text[4 * j : 4 * j + 4].T).view("<u4").ravel() for j in range(words)] + [None] * (16 - words)
    message[14] = np.uint32(8 * k)
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(n, x) for x in start)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        turn = i // 16
        if turn == 0:
            at = i
            np.bitwise_xor(c, d, f)
            f &= b
            f ^= d
        elif turn == 1:
            at = (5 * i + 1) % 16
            np.bitwise_xor(b, c, f)
            f &= d
            f ^= c
        elif turn == 2:
            at = (3 * i + 5) % 16
            np.bitwise_xor(b, c, f)
            f ^= d
        else:
            at = 7 * i % 16
            np.invert(d, f)
            f |= b
            f ^= c
        f += a
        f += _SINES[i]
        if message[at] is not None:
            f += message[at]
        by = _TURNS[turn][i % 4]
        np.left_shift(f, np.uint32(by), g)
        f >>= np.uint32(32 - by)
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    a += start[0]
    b += start[1]
    return (a.byteswap().astype(np.uint64) << np.uint64(28)) | (b.byteswap().astype(np.uint64) >> np.uint64(4))


def _both_strands_md5(forward: np.ndarray, backward: np.ndarray, k: int) -> np.ndarray:
    """The lesser hash of each k-mer and its reverse complement, and NONE for palindromes; k-mers met not long ago are looked up."""
    whole = 4**k <= WHOLE
    if k not in _kept:
        size = 4**k if whole else SLOTS
        _kept[k] = np.full(size, _UNKNOWN), np.zeros(0 if whole else size, np.uint64)
    hashes, held = _kept[k]
    codes = np.minimum(forward, backward)
    slots = (codes if whole else (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (SLOTS - 1).bit_length())).astype(np.intp)
    out = hashes[slots]
    missing = np.flatnonzero(out == _UNKNOWN if whole else (out == _UNKNOWN) | (held[slots] != codes))
    for at in range(0, len(missing), MD5_BLOCK):
        these = missing[at : at + MD5_BLOCK]
        one, other = _md5_60(forward[these], k), _md5_60(backward[these], k)
        out[these] = np.where(one == other, NONE, np.minimum(one, other))
    hashes[slots[missing]] = out[missing]
    if not whole:
        held[slots[missing]] = codes[missing]
    return out


def _text_md5(x: bytes) -> int:
    """As _both_strands_md5, of any letters."""
    one, other = (int(hashlib.md5(y).hexdigest()[:15], 16) for y in (x, x.translate(_COMPLEMENT)[::-1]))
    return min(one, other) if one != other else int(NONE)


def _codes(bases: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits a base of each k-mer and of its reverse complement, put together from spans of 1, 2, 4, ... bases."""
    one, other, span, done = bases.astype(np.uint64), np.uint64(3) - bases.astype(np.uint64), 1, 0
    n, forward, backward = len(bases) - k + 1, None, None
    while True:
        if k & span:
            bits = np.uint64(2 * done)
            if forward is None:
                forward, backward = one, other
            else:  # this span, then the bases that are done
                forward, backward = (one[: len(forward) - span] << bits) | forward[span:], other[: len(backward) - span] | (backward[span:] << np.uint64(2 * span))
            done += span
        if done == k:
            return forward[:n], backward[:n]
        bits = np.uint64(2 * span)
        one, other = (one[:-span] << bits) | one[span:], other[:-span] | (other[span:] << bits)
        span *= 2


def kmer_hashes(seq: bytes, k: int, hash: str = "splitmix", seed: int = 42, only_acgt: bool = True) -> np.ndarray:
    """The canonical hash at each place: the lesser of both strands', and NONE for palindromes and, if only_acgt, other letters."""
    n = len(seq) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    codes = _CODE[np.frombuffer(seq, np.uint8)]
    bad = np.concatenate([[0], np.cumsum(codes == 4)])
    known = bad[k:] == bad[:-k]
    if hash == "murmur3":
        one, other = _both_strands_murmur(seq, k, seed)
        out = np.minimum(one, other)
        out[one == other] = NONE
    elif k <= 32:
        forward, backward = _codes(codes & 3, k)
        if hash == "splitmix":
            only_acgt = True
            one, other = _splitmix(forward, seed), _splitmix(backward, seed)
            out = np.minimum(one, other)
            out[one == other] = NONE
        else:
            out = _both_strands_md5(forward, backward, k)
            if not only_acgt:
                others = np.flatnonzero(~known)
                out[others] = [_text_md5(seq[i : i + k]) for i in others.tolist()]
    elif hash == "splitmix":
        raise ValueError("splitmix codes hold 32 bases at most")
    else:
        out = np.fromiter((_text_md5(seq[i : i + k]) for i in range(n)), np.uint64, n)
    if only_acgt:
        out[~known] = NONE
    return out


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w consecutive values, by doubling spans."""
    span, out = 1, x
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(out) - (w - span)], out[w - span :]) if w > span else out


def window_minimizers(hashes: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first window) of each run of windows with one minimum. Windows without any hash part runs and give none."""
    if len(hashes) < w:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    least = _sliding_min(hashes, w)
    first = np.concatenate([[True], least[1:] != least[:-1]]) & (least != NONE)
    return least[first], np.flatnonzero(first)


def minimizer_places(hashes: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of each k-mer that is the minimum of a window it lies in; both strands of a sequence show the same k-mers."""
    if len(hashes) < w:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    edge = np.zeros(w - 1, np.uint64)
    most = ~_sliding_min(~np.concatenate([edge, _sliding_min(hashes, w), edge]), w)  # the largest of the minima of the windows over a place
    found = np.flatnonzero((most == hashes) & (hashes != NONE))
    return hashes[found], found


def exact_minimizers(hashes: np.ndarray, w: int) -> tuple[list[int], list[int]]:
    """(hash, window) once for each k-mer that is a window's minimum (the last of equal ones), at the window that shows it first.

    At a place without a hash nothing happens: the window there is not looked at.
    """
    queue: deque[int] = deque()
    shown, out = set(), ([], [])
    for i in np.flatnonzero(hashes != NONE).tolist():
        while queue and i >= w and queue[0] <= i - w:
            shown.discard(queue.popleft())
        while queue and hashes[queue[-1]] >= hashes[i]:
            shown.discard(queue.pop())
        queue.append(i)
        if i + 1 >= w and queue[0] not in shown:
            shown.add(queue[0])
            out[0].append(int(hashes[queue[0]]))
            out[1].append(i + 1 - w)
    return out


def minmer_intervals(hashes: np.ndarray, window: int, s: int) -> list[tuple[int, int, int]]:
    """(hash, start, end): the windows over which a hash is among the window's s least different ones. Hashes without a value are left out first."""
    values = hashes[hashes != NONE]
    found, start, end = minmers_of_runs(values, np.array([len(values)]), window, s)
    return sorted(zip(found.tolist(), start.tolist(), end.tolist()), key=lambda r: (r[1], r[2], r[0]))


#: Windows that one lane of minmers_of_runs goes through, one after the other, and rows of whole windows that are looked at together.
LANE, WINDOW_ROWS = 128, 1 << 13


def _neighbours(values: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by value, then place; and for each place those of the same value before and after it in its run, far away if there is none."""
    order = np.argsort(values, kind="stable")
    same = (values[order[1:]] == values[order[:-1]]) & (run[order[1:]] == run[order[:-1]])
    before, after = np.full(len(values), -_FAR // 2), np.full(len(values), _FAR // 2)
    before[order[1:][same]], after[order[:-1][same]] = order[:-1][same], order[1:][same]
    return order, before, after


def _thresholds(values: np.ndarray, before: np.ndarray, after: np.ndarray, starts: np.ndarray, lengths: np.ndarray, window: int, s: int) -> np.ndarray:
    """At each place that a window starts from its s-th least different value, NONE where it has fewer. starts, lengths: of the windows of each run.

    Many lanes take a step at once: a value goes, another comes, and the threshold moves to the next value of the window up or down where that changes
    how many are below it.
    """
    pieces = -(-lengths // LANE)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    lanes, sizes = np.repeat(starts, pieces) + nth * LANE, np.minimum(np.repeat(lengths, pieces) - nth * LANE, LANE)
    by = np.argsort(-sizes, kind="stable")
    lanes, sizes = lanes[by], sizes[by]
    windows, out = np.lib.stride_tricks.sliding_window_view(values, window), np.full(len(values), NONE)
    top, different = np.empty(len(lanes), np.uint64), np.empty(len(lanes), np.int64)
    for at in range(0, len(lanes), WINDOW_ROWS):
        rows = np.sort(windows[lanes[at : at + WINDOW_ROWS]], axis=1)
        again = rows[:, 1:] == rows[:, :-1]
        several = np.flatnonzero(again.any(axis=1))
        rows[several, 1:] = np.where(again[several], NONE, rows[several, 1:])
        rows[several] = np.sort(rows[several], axis=1)
        top[at : at + WINDOW_ROWS], different[at : at + WINDOW_ROWS] = rows[:, s - 1], window - again.sum(axis=1)
    out[lanes] = top
    one = np.uint64(1)
    for step in range(1, int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -step))  # lanes longer than this step come first
        i = lanes[:n] + step
        t, gone, come = top[:n], after[i - 1] > i + (window - 1), before[i + (window - 1)] < i - 1
        leaving, coming = values[i - 1], values[i + (window - 1)]
        different[:n] += come.astype(np.int64) - gone
        fewer, more, known = gone & (leaving <= t), come & (coming < t), t != NONE
        up = np.flatnonzero(known & fewer & ~more)
        down = np.flatnonzero(np.where(known, more & (~fewer | (leaving == t)), different[:n] >= s))
        for at in range(0, len(up), WINDOW_ROWS):
            these = up[at : at + WINDOW_ROWS]
            further = (windows[i[these]] - (t[these] + one)[:, None]).min(axis=1)  # values below the threshold wrap round to large ones
            t[these] = np.where(further < np.uint64(1 << 63), further + t[these] + one, NONE)
        for at in range(0, len(down), WINDOW_ROWS):
            these = down[at : at + WINDOW_ROWS]
            t[these] -= one + ((t[these] - one)[:, None] - windows[i[these]]).min(axis=1)
        out[i] = t
    return out


def minmers_of_runs(values: np.ndarray, lengths: np.ndarray, window: int, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of minmer_intervals() over many runs that follow each other in values, places counted from the first of values. Hashes are below 2**62.

    A place is the first of its value in the windows from behind the place before of that value up to itself, and of those its value is in the windows
    with a threshold at or above it; stretches that touch are one.
    """
    s, lengths = min(s, window), np.asarray(lengths, np.int64)
    whole = lengths >= window
    if not whole.all():
        starts = np.cumsum(lengths) - lengths
        kept = np.repeat(whole, lengths)
        found, a, b = minmers_of_runs(values[kept], lengths[whole], window, s)
        back = np.flatnonzero(kept)
        return found, (back[a] if len(a) else a), (back[b - 1] + 1 if len(b) else b)
    if not len(values):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, run = np.cumsum(lengths) - lengths, np.repeat(np.arange(len(lengths)), lengths)
    order, before, after = _neighbours(values, run)
    top = _thresholds(values, before, after, starts, lengths - window + 1, window, s)
    place = np.arange(len(values))
    last = (starts + lengths - window)[run]  # the run's last window
    above = np.where(top == NONE, NONE, top + np.uint64(1))
    edge = np.zeros(window - 1, np.uint64)
    most = np.concatenate([edge, np.where(place <= last, above, np.uint64(0))])  # the windows up to a place are those from it on here
    least = np.concatenate([~edge, np.where(place <= last, above, NONE)])
    first = np.maximum(np.maximum(place - (window - 1), before + 1), starts[run])
    inside = (first <= last) & (values < ~_sliding_min(~most, window))
    sure = inside & (values < _sliding_min(least, window))
    owner = np.flatnonzero(sure)
    parts = [(owner, first[owner], np.minimum(owner, last[owner]) + 1)]
    mixed, rows, columns = np.flatnonzero(inside & ~sure), np.lib.stride_tricks.sliding_window_view(most, window), np.arange(window)
    for at in range(0, len(mixed), WINDOW_ROWS):
        these = mixed[at : at + WINDOW_ROWS]
        held = np.zeros((len(these), window + 2), np.int8)
        held[:, 1:-1] = (rows[these] > values[these][:, None]) & (columns >= (first[these] - these + (window - 1))[:, None])
        steps = np.diff(held, axis=1)
        (row, a), (_, b) = np.nonzero(steps > 0), np.nonzero(steps < 0)
        base = these[row] - (window - 1)
        parts.append((these[row], base + a, base + b))
    owner, start, end = (np.concatenate(x) for x in zip(*parts))
    near = (before[owner] >= owner - window) | (after[owner] <= owner + window)
    alone, rest = np.flatnonzero(~near), np.flatnonzero(near)
    rank = np.empty(len(values), np.int64)
    rank[order] = place
    rest = rest[np.lexsort((start[rest], rank[owner[rest]]))]
    new = np.ones(len(rest), bool)
    new[1:] = (start[rest[1:]] != end[rest[:-1]]) | (values[owner[rest[1:]]] != values[owner[rest[:-1]]]) | (run[owner[rest[1:]]] != run[owner[rest[:-1]]])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(rest)) - 1 if len(heads) else heads
    return values[owner[np.append(alone, rest[heads])]], start[np.append(alone, rest[heads])], end[np.append(alone, rest[tails])]


class SlidingSketch:
    """How many of the s least different hashes of query and window are in both, while hashes come to and go from the window."""

    def __init__(self, query: list[int]):
        self.query, self.s = sorted(query), len(query)
        self.of_query = set(query)
        self.counts: Counter = Counter()
        self.shared: list[int] = []  # sorted hashes of the window that the query has
        self.others: list[int] = []  # sorted hashes of the window that it has not

    def add(self, h: int) -> None:
        self.counts[h] += 1
        if self.counts[h] == 1:
            insort(self.shared if h in self.of_query else self.others, h)

    def remove(self, h: int) -> None:
        if self.counts[h]:
            self.counts[h] -= 1
            if not self.counts[h]:
                side = self.shared if h in self.of_query else self.others
                del side[bisect_left(side, h)]

    def count(self) -> int:
        """By a search for the number q of query hashes below the s-th hash of the union."""
        low, high = 0, self.s
        while low < high:  # the most q such that the q least of the query and those of the others below fit into s
            q = (low + high + 1) // 2
            if q + bisect_left(self.others, self.query[q - 1]) <= self.s:
                low = q
            else:
                high = q - 1
        return bisect_left(self.shared, self.query[low - 1] + 1) if low else 0


def best_window(query: list[int], hashes: list[int], places: list[int], span: int, first: int, last: int, length: int) -> tuple[int, int] | None:
    """(most shared, middle of its first and last place) over windows of span places from first to last; None without any shared.

    hashes and places are a sequence's minimizers by place. A window starts at a minimizer and holds it till the next begins; windows are looked at
    where one enters or leaves, while there is a further minimizer before last + length.
    """
    begin = bisect_left(places, first)
    if begin >= len(places) or span <= 0 or not query:
        return None
    stop = bisect_left(places, last + length)
    at = places[begin]
    end = bisect_left(places, at + span)
    sketch = SlidingSketch(query)
    for h in hashes[begin:end]:
        sketch.add(h)
    most, ends = 0, None
    while end < stop and at <= last:
        shared = sketch.count()
        if shared > most:
            most, ends = shared, (places[begin], places[begin])
        elif shared == most and ends:
            ends = ends[0], places[begin]
        to_begin = places[begin + 1] - at if begin + 1 < len(places) and begin + 1 < stop else None
        to_end = places[end] - (at + span - 1)
        step = to_end if to_begin is None else min(to_begin, to_end)
        if step <= 0:
            break
        if step == to_begin:
            sketch.remove(hashes[begin])
            begin += 1
        if step == to_end:
            sketch.add(hashes[end])
            end += 1
        at += step
    return (most, (ends[0] + ends[1]) // 2) if ends else None


def best_interval_window(query: list[int], intervals: list[tuple[int, int, int]], first: int, last: int) -> tuple[int, int] | None:
    """As best_window, for hashes that are in the window over intervals (hash, start, end) of places from first to last."""
    sketch, events = SlidingSketch(query), []
    for h, start, end in intervals:
        if start <= first < end:
            sketch.add(h)
        elif first < start <= last:
            events.append((start, False, h))
        if first < end <= last:
            events.append((end, True, h))
    marks = sorted({first, *(e[0] for e in events)}) + [last + 1]
    events.sort()
    most, ends, k = 0, None, 0
    for at, following in zip(marks, marks[1:]):
        while k < len(events) and events[k][0] == at:
            sketch.remove(events[k][2]) if events[k][1] else sketch.add(events[k][2])
            k += 1
        shared = sketch.count()
        if shared > most:
            most, ends = shared, (at, following - 1)
        elif shared == most:
            ends = (ends or (at,))[0], following - 1
    return (most, (ends[0] + ends[1]) // 2) if ends else None


def gap_chain(refs: np.ndarray, queries: np.ndarray, least: int, max_gap: int, tolerance: int, predecessors: int) -> np.ndarray:
    """Places (in order of reference, query) of the longest co-linear chain of different hits, by a bounded look back; empty if shorter than least.

    A step may span max_gap on either side and tolerance between the sides; a step costs one point for each 256 of drift and each 4096 of span.
    """
    pairs = np.unique(np.column_stack([refs, queries]), axis=0)
    n = len(pairs)
    score, length, before = np.ones(n, np.int64), np.ones(n, np.int64), np.full(n, -1)
    for i in range(n):
        low = max(0, i - predecessors)
        dr, dq = pairs[i, 0] - pairs[low:i, 0], pairs[i, 1] - pairs[low:i, 1]
        drift = np.abs(dr - dq)
        fits = (dr > 0) & (dq > 0) & (np.maximum(dr, dq) <= max_gap)
        near = fits & (drift <= tolerance)
        far = np.cumsum((fits & (drift > tolerance))[::-1])[::-1]  # the look back ends after 25 that drift too far
        near &= far <= 25
        if near.any():
            js = np.flatnonzero(near)[::-1]
            points = score[low + js] + 1 - drift[js] // 256 - np.maximum(dr, dq)[js] // 4096
            best = np.lexsort((-np.arange(len(js)), length[low + js], points))[-1]
            j = low + js[best]
            if (points[best], length[j] + 1) > (score[i], length[i]):
                score[i], length[i], before[i] = points[best], length[j] + 1, j
    if not n or length.max() < least:
        return np.zeros((0, 2), np.int64)
    at = int(np.lexsort((-np.arange(n), score, length))[-1])
    chain = []
    while at >= 0:
        chain.append(at)
        at = int(before[at])
    return pairs[chain[::-1]]


#: Hits up to which a block of the optimal chain is worked out pair by pair.
CHAIN_BLOCK = 256


class _Levels:
    """Hits in order of one coordinate, in aligned blocks of 1, 2, 4, ... of them, each in order of diagonal with running minima."""

    def __init__(self, place: np.ndarray, diagonal: np.ndarray):
        self.order = np.argsort(place, kind="stable")
        self.place, self.diagonal, self.levels = place[self.order], diagonal[self.order], []
        n, size = len(place), 1
        while size <= n:
            by = np.lexsort((self.diagonal, np.arange(n) // size))
            self.levels.append((size, by, self.diagonal[by]))
            size *= 2

    def least(self, keys: np.ndarray, low: np.ndarray, high: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
        """For each query the least key of the hits low to high (in order of place) on diagonals up to its own."""
        keys, best = keys[self.order], np.full(len(low), _FAR)
        low, high, span = low.copy(), np.maximum(high, low), int(np.ptp(np.append(self.diagonal, diagonal))) + 1
        base = min(int(self.diagonal.min()), int(diagonal.min()))
        for size, by, sorted_diagonals in self.levels:
            if not (low < high).any():
                break
            padded = np.full(-(-len(by) // size) * size, _FAR)
            padded[: len(by)] = keys[by]
            running = np.minimum.accumulate(padded.reshape(-1, size), axis=1).ravel()
            blocks = np.arange(len(by)) // size * span + (sorted_diagonals - base)
            for at_low in (True, False):
                uses = np.flatnonzero((low < high) & ((low if at_low else high) & size > 0))
                if len(uses):
                    block = (low[uses] if at_low else high[uses] - size) // size
                    found = np.searchsorted(blocks, block * span + (diagonal[uses] - base), "right") - 1
                    there = found >= block * size
                    best[uses[there]] = np.minimum(best[uses[there]], running[found[there]])
                    if at_low:
                        low[uses] += size
                    else:
                        high[uses] -= size
        return best


def optimal_chain(refs: np.ndarray, queries: np.ndarray, k: int, query_len: int, least: int) -> np.ndarray:
    """Hits of the cheapest semi-global chain, where the reference's ends are free, ties going to more hits; empty if it has fewer than least.

    A step costs the greater of both gaps and the difference of both overlaps; starting and ending cost the query's uncovered ends. With d the difference
    of diagonals a step costs d where the hits overlap on either side, and else the further side's advance less k: four cases, each a least
    key over a window of places and all diagonals on one side. Halves of the hits, in order of reference, are joined by these, so n hits take about n log^3 n.
    """
    pairs = np.unique(np.column_stack([refs, queries]), axis=0)
    n = len(pairs)
    if not n:
        return pairs
    r, q = pairs[:, 0] - pairs[0, 0], pairs[:, 1].astype(np.int64)
    d = r - q
    cost, length, before = q.copy(), np.ones(n, np.int64), np.full(n, -1)
    shift = int(abs(r).max() + abs(q).max() + abs(d).max()) + 1
    bits = max(1, (n - 1).bit_length())
    if (4 * shift + query_len).bit_length() + 2 * bits + 1 > 62:
        raise ValueError(f"{n} hits over {shift} places are too many for one bin")

    def keyed(value: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Order by value, then by more hits, then by the hit's number."""
        return ((value + 2 * shift) << (2 * bits)) | ((n - length[which]) << bits) | which

    def better(these: np.ndarray, keys: np.ndarray, added: np.ndarray) -> None:
        found = keys != _FAR
        these, keys = these[found], keys[found]
        j = keys & ((1 << bits) - 1)
        total = (keys >> (2 * bits)) - 2 * shift + added[found]
        wins = (total < cost[these]) | ((total == cost[these]) & ((length[j] + 1 > length[these]) | ((length[j] + 1 == length[these]) & (before[these] >= 0) & (j < before[these]))))
        these, j = these[wins], j[wins]
        cost[these], length[these], before[these] = total[wins], length[j] + 1, j

    def pair_by_pair(a: int, b: int) -> None:
        for i in range(a + 1, b):
            dr, dq = r[i] - r[a:i], q[i] - q[a:i]
            js = np.flatnonzero((dr > 0) & (dq > 0))
            if len(js):
                step = np.abs(dr - dq)[js] + np.maximum(np.minimum(dr, dq)[js] - k, 0)
                better(np.array([i]), keyed(cost[a + js] + step, a + js).min(keepdims=True), np.zeros(1, np.int64))

    def solve(a: int, b: int) -> None:
        if b - a <= CHAIN_BLOCK:
            pair_by_pair(a, b)
            return
        middle = (a + b) // 2
        solve(a, middle)
        left, right = np.arange(a, middle), np.arange(middle, b)
        by_query, by_ref = _Levels(q[left], d[left]), _Levels(r[left], -d[left])
        c, at = cost[left], lambda levels, places: np.searchsorted(levels.place, places)
        zero = np.zeros(len(right), np.int64)
        touching, apart = at(by_query, q[right] - k + 1), at(by_query, q[right])  # the reference advances further
        better(right, by_query.least(keyed(c - r[left], left), zero, touching, d[right]), r[right] - k)
        better(right, by_query.least(keyed(c - d[left], left), touching, apart, d[right]), d[right])
        touching, apart = at(by_ref, r[right] - k + 1), at(by_ref, r[right])  # the query does
        better(right, by_ref.least(keyed(c - q[left], left), zero, touching, -d[right]), q[right] - k)
        better(right, by_ref.least(keyed(c + d[left], left), touching, apart, -d[right]), -d[right])
        solve(middle, b)

    solve(0, n)
    final = cost + np.maximum(query_len - q - k, 0)
    at = int(np.lexsort((-length, final))[0])
    if length[at] < least:
        return np.zeros((0, 2), np.int64)
    chain = []
    while at >= 0:
        chain.append(at)
        at = int(before[at])
    return pairs[chain[::-1]]
