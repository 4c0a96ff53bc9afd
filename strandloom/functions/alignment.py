"""Base-level alignment of two short stretches, and the chain of shared k-mers between which stretches are cut."""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np

#: Costs: of a base that differs, of a gap, and of each base in a gap. Equal bases cost nothing.
MISMATCH, OPENING, EXTENDING = 4, 6, 2
#: Cells of a stretch's table at most.
CELLS = 64_000_000
_FAR = np.int32(1 << 29)
_OP = re.compile(r"(\d+)([=XID])")


def chain(hits: list[tuple[int, int]], step: int) -> list[tuple[int, int]]:
    """The longest run of hits (query place, reference place) that rises in both, thinned to one in step query bases; its first and last stay."""
    hits = sorted(set(hits), key=lambda h: (h[0], -h[1]))
    tails, at, before = [], [], [-1] * len(hits)
    for i, (_, p) in enumerate(hits):
        k = bisect_left(tails, p)
        before[i] = at[k - 1] if k else -1
        tails[k : k + 1], at[k : k + 1] = [p], [i]
    run, i = [], at[-1] if at else -1
    while i >= 0:
        run.append(hits[i])
        i = before[i]
    run.reverse()
    kept = run[:1]
    for hit in run[1:-1]:
        if hit[0] - kept[-1][0] >= step:
            kept.append(hit)
    return kept + run[1:][-1:]


def cigar_of(ops: list[tuple[int, str]]) -> str:
    """Runs of operations as text; neighbours of one kind are one run."""
    out: list[list] = []
    for n, op in ops:
        if n and out and out[-1][1] == op:
            out[-1][0] += n
        elif n:
            out.append([n, op])
    return "".join(f"{n}{op}" for n, op in out)


def ops_of(cigar: str) -> list[tuple[int, str]]:
    return [(int(n), op) for n, op in _OP.findall(cigar)]


def cost_of(ops: list[tuple[int, str]]) -> int:
    return sum({"=": 0, "X": MISMATCH * n, "I": OPENING + EXTENDING * n, "D": OPENING + EXTENDING * n}[op] for n, op in ops)


def align(q: bytes, r: bytes, cells: int = CELLS) -> tuple[list[tuple[int, str]], bool]:
    """Operations (=, X, I: only in q, D: only in r) that turn all of r into all of q at the least cost, and whether the cost is known to be the least.

    Equal ends are taken off first. The rest is aligned in a band of diagonals: a path that leaves it has two gaps that reach around it, so a cost up to
    theirs is the least, and otherwise the cost found tells how wide the band must be. A stretch whose band has more than cells is deleted and inserted whole.
    """
    a, b = np.frombuffer(q, np.uint8), np.frombuffer(r, np.uint8)
    short = min(len(a), len(b))
    head = _equal(a[:short], b[:short])
    tail = _equal(a[head:][::-1][: short - head], b[head:][::-1][: short - head])
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    middle, exact = _middle(a, b, cells)
    return [(head, "="), *middle, (tail, "=")], exact


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    off = np.flatnonzero(a != b)
    return int(off[0]) if len(off) else len(a)


def _middle(a: np.ndarray, b: np.ndarray, cells: int) -> tuple[list[tuple[int, str]], bool]:
    n, m = len(a), len(b)
    if not n or not m:
        return [(n, "I"), (m, "D")], True
    width, found = 16, [(m, "D"), (n, "I")]
    while n * (abs(m - n) + 2 * width + 1) <= cells:
        cost, found = _banded(a, b, width)
        around = 2 * OPENING + EXTENDING * (abs(m - n) + 2 * width + 2)
        if cost <= around or width >= max(n, m):
            return found, True
        width += (cost - around) // (2 * EXTENDING) + 1
    return found, False


def _banded(a: np.ndarray, b: np.ndarray, width: int) -> tuple[int, list[tuple[int, str]]]:
    """The least cost within the band, and its operations. Rows are bases of a; a gap along a row is a running minimum."""
    n, m = len(a), len(b)
    low, high = min(0, m - n) - width, max(0, m - n) + width
    w = high - low + 1
    at = np.arange(w, dtype=np.int32)
    slope, start = EXTENDING * at, OPENING + EXTENDING
    padded = np.concatenate([np.zeros(-low, np.uint8), b, np.zeros(max(0, n + high - m), np.uint8)])
    column = at + low
    best = np.where(column == 0, 0, np.where((column > 0) & (column <= m), OPENING + EXTENDING * column, _FAR)).astype(np.int32)
    down = np.full(w, _FAR, np.int32)
    moves = np.zeros((n + 1, w), np.uint8)
    after, longer, base, right = (np.full(w, _FAR, np.int32) for _ in range(4))
    for i in range(1, n + 1):
        column = at + (i + low)
        outside = (column < 0) | (column > m)
        diagonal = best + np.where(padded[i - 1 : i - 1 + w] == a[i - 1], 0, MISMATCH).astype(np.int32)
        diagonal[column < 1] = _FAR
        after[:-1], longer[:-1] = best[1:] + start, down[1:] + EXTENDING
        down = np.minimum(np.minimum(after, longer), _FAR)
        base = np.minimum(diagonal, down)
        base[outside] = _FAR
        right[1:] = np.minimum.accumulate(base - slope)[:-1] + slope[1:] + OPENING
        best = np.minimum(np.minimum(base, right), _FAR)
        best[outside] = _FAR
        kind = np.where(diagonal <= best, 0, np.where(down <= best, 1, 2)).astype(np.uint8)
        kind |= (longer < after).astype(np.uint8) << 2
        kind[1:] |= (base[:-1] + start > right[1:]).astype(np.uint8) << 3
        moves[i] = kind
    i, j, state, ops = n, m, 0, []
    while i > 0:
        move = int(moves[i, j - i - low])
        if state == 0:
            state = move & 3
            if state == 0:
                ops.append((1, "=" if a[i - 1] == b[j - 1] else "X"))
                i, j = i - 1, j - 1
        elif state == 1:
            ops.append((1, "I"))
            i, state = i - 1, 1 if move & 4 else 0
        else:
            ops.append((1, "D"))
            j, state = j - 1, 2 if move & 8 else 0
    ops.append((j, "D"))
    return int(best[m - n - low]), ops_of(cigar_of(ops[::-1]))
