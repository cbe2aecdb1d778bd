"""Cutting stock by column generation on a histogram of lengths.

A pattern says how many pieces of each length share a sequence.  A linear program chooses how often each pattern
is used so that every piece is placed and the padded length is least; a knapsack over exact sums prices new
patterns by its duals.  Its size depends on the capacity alone: there are at most `capacity` lengths, dealt into
blocks of a bounded number of rows, each a linear program of its own, so that blocks are solved in parallel.

A sequence is padded to the capacity unless its length is a power of two.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np

Pattern = tuple[tuple[int, int], ...]  # (length, how many), longest first


def padded(total: int | np.ndarray, capacity: int):
    """The length a sequence of so many tokens takes up."""
    total = np.asarray(total)
    return np.where((total & (total - 1)) == 0, total, capacity)


def deal(histogram: dict[int, int], rows: int) -> list[dict[int, int]]:
    """Blocks of about `rows` lengths, short and long ones in each, dealt at random: lengths in even steps would have few exact sums.
    A length with much of all tokens goes to every block in equal parts."""
    lengths = sorted(histogram)
    blocks = max(1, -(-len(lengths) // rows))
    every = sum(n * c for n, c in histogram.items())
    out: list[dict[int, int]] = [{} for _ in range(blocks)]
    rng, turn = np.random.default_rng(3), []
    for n in lengths:
        c = histogram[n]
        if blocks > 1 and 2 * blocks * n * c > every:
            for b in range(blocks):
                if share := c // blocks + (b < c % blocks):
                    out[b][n] = share
        else:
            turn = turn or rng.permutation(blocks).tolist()
            out[turn.pop()][n] = c
    return [b for b in out if b]


class Knapsack:
    """The best pattern of each exact total, by dynamic programming over totals."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.fitting = np.searchsorted(lengths, np.arange(capacity + 1), "right")

    def solve(self, value: np.ndarray) -> np.ndarray:
        best = np.full(self.capacity + 1, -np.inf)
        best[0] = 0.0
        self.last = last = np.zeros(self.capacity + 1, np.int64)
        lengths, fitting = self.lengths, self.fitting
        for s in range(1, self.capacity + 1):
            k = fitting[s]
            if k:
                with_last = best[s - lengths[:k]] + value[:k]
                last[s] = j = with_last.argmax()
                best[s] = with_last[j]
        return best

    def pattern(self, total: int) -> np.ndarray:
        out = np.zeros(len(self.lengths))
        while total:
            j = self.last[total]
            out[j] += 1
            total -= self.lengths[j]
        return out


class Simplex:
    """min c x, A x = n, x >= 0 with an explicit inverse of the basis; columns come one block at a time."""

    def __init__(self, columns: np.ndarray, cost: np.ndarray, n: np.ndarray):
        m = len(n)
        self.columns, self.cost = columns, cost  # the first m columns are a feasible basis
        self.basis = np.arange(m)
        self.n = n * (1 + 1e-9 * np.random.default_rng(0).random(m))  # no ties in the ratio test
        self.refactor()

    def refactor(self) -> None:
        self.inverse = np.linalg.inv(self.columns[:, self.basis])
        self.x = np.maximum(self.inverse @ self.n, 0)
        self.steps = 0

    def duals(self) -> np.ndarray:
        return self.cost[self.basis] @ self.inverse

    def add(self, columns: np.ndarray, cost: np.ndarray) -> None:
        self.columns, self.cost = np.hstack((self.columns, columns)), np.concatenate((self.cost, cost))

    def run(self, most: int = 20_000) -> None:
        """Pivots until no column that is there improves."""
        for _ in range(most):
            reduced = self.cost - self.duals() @ self.columns
            j = int(reduced.argmin())
            if reduced[j] > -1e-7 * max(1.0, abs(self.cost[j])):
                return
            d = self.inverse @ self.columns[:, j]
            up = d > 1e-9
            if not up.any():
                return
            ratio = np.full(len(d), np.inf)
            ratio[up] = self.x[up] / d[up]
            i = int(ratio.argmin())
            step = ratio[i]
            self.x = np.maximum(self.x - step * d, 0)
            self.x[i] = step
            self.basis[i] = j
            row = self.inverse[i] / d[i]
            self.inverse -= np.outer(d, row)
            self.inverse[i] = row
            self.steps += 1
            if self.steps >= 100:
                self.refactor()

    def shrink(self, most: int) -> None:
        """Forgets columns that are far from the basis when there are many."""
        if self.columns.shape[1] <= most:
            return
        reduced = self.cost - self.duals() @ self.columns
        reduced[self.basis] = -np.inf
        keep = np.sort(np.argsort(reduced, kind="stable")[: most // 2])
        self.basis = np.searchsorted(keep, self.basis)
        self.columns, self.cost = self.columns[:, keep], self.cost[keep]


def solve_block(histogram: dict[int, int], capacity: int, gap: float = 1e-3, rounds: int = 100) -> list[tuple[Pattern, float]]:
    """(pattern, how often) of a basic solution of the block's linear program; what it leaves out will be cut.

    As pieces may be cut, padding is never needed: the program weighs whole pieces in sequences without padding against the
    tokens of pieces that are left over.  Columns come from the knapsack: under the duals the best pattern of each total
    that needs no padding and, for each length, the best full sequence that holds it.  It ends when no pattern
    improves, when no more than `gap` of the tokens is left over, or after `rounds`; any of its solutions can be used.
    """
    lengths = np.array(sorted(histogram), np.int64)
    n = np.array([histogram[x] for x in lengths.tolist()], float)
    m, tokens = len(lengths), float((n * lengths).sum())
    sack = Knapsack(lengths, capacity)
    lp = Simplex(np.eye(m), lengths.astype(float), n)  # to begin with all is left over
    rng = np.random.default_rng(7)
    ends = sorted({1 << k for k in range(capacity.bit_length())} | {capacity})

    def grow(value: np.ndarray, duals: np.ndarray) -> int:
        best = sack.solve(value)
        found = [sack.pattern(t) for t in ends if np.isfinite(best[t])]
        for j in np.flatnonzero(np.isfinite(best[capacity - lengths])):
            p = sack.pattern(int(capacity - lengths[j]))
            p[j] += 1
            found.append(p)
        if not found:
            return 0
        new = np.unique(np.array(found), axis=0).T
        new = new[:, duals @ new > 1.001]  # a sequence costs one token: of two ways that leave nothing over, fewer sequences
        lp.add(new, np.ones(new.shape[1]))
        return new.shape[1]

    for _ in range(rounds):
        duals = lp.duals()
        value = np.maximum(duals, 0)
        if not grow(value * (1 + 0.05 * rng.random(m)), duals) and not grow(duals, duals):
            break
        lp.run()
        if lp.cost[lp.basis] @ lp.x <= gap * tokens + lp.x[lp.cost[lp.basis] == 1].sum():
            break
        lp.shrink(8 * m)
    lp.n = n
    lp.refactor()
    out = []
    for j, x in zip(lp.basis, lp.x):
        column = lp.columns[:, j].astype(int)
        if x > 1e-9 and padded(total := int(column @ lengths), capacity) == total:
            out.append((tuple((int(lengths[i]), int(column[i])) for i in np.flatnonzero(column)[::-1]), float(x)))
    return out


@dataclass
class Plan:
    """Where pieces go, by rank among the pieces of their length.

    whole: (length, first rank, end rank, first sequence, how many a sequence, offset).
    stream: (length, first rank, end rank, place of the first token): pieces laid end to end and cut at `cuts`-many
    full sequences and then at the tail's powers of two.
    """

    whole: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    stream: list[tuple[int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    streamed: int = 0


def fill(pool: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Full sequences from single pieces, the longest first and the rest by an exact subset sum; what can't be placed so is returned."""
    left, out, over = {n: c for n, c in pool.items() if c}, [], {}
    order = sorted(left, reverse=True)
    while order:
        first = order[0]
        gap, seen, steps = capacity - first, 1, []
        mask = (1 << (gap + 1)) - 1
        for n in order:
            for _ in range(min(left[n] - (n == first), gap // n)):
                more = (seen | seen << n) & mask
                if more == seen:
                    break
                steps.append((n, seen))
                seen = more
                if seen >> gap & 1:
                    break
            if seen >> gap & 1:
                break
        parts = {first: 1}
        if seen >> gap & 1:
            for n, before in reversed(steps):
                if not before >> gap & 1:
                    parts[n] = parts.get(n, 0) + 1
                    gap -= n
            out.append(tuple(sorted(parts.items(), reverse=True)))
        else:
            over[first] = over.get(first, 0) + 1
        for n, k in parts.items():
            left[n] -= k
        order = [n for n in order if left[n]]
    return out, over


def round_patterns(histogram: dict[int, int], solved: Iterable[tuple[Pattern, float]], capacity: int) -> Plan:
    """Patterns are used as often as the whole part of their number says.  The fractions, a bounded number of pieces, are
    filled up exactly one by one.  What the program left over, and what could not be filled, is laid end to end and cut."""
    left, used, fractions = dict(histogram), [], {}
    for pattern, x in solved:
        often = min([int(x + 1e-6), *(left[n] // k for n, k in pattern)])
        for n, k in pattern:
            left[n] -= k * often
        for n, k in pattern:
            part = min(math.ceil(max(0.0, x - often) * k), left[n])
            fractions[n] = fractions.get(n, 0) + part
            left[n] -= part
        if often:
            used.append((pattern, often))
    filled, over = fill(fractions, capacity)
    used += [(p, 1) for p in filled]
    loose = {n: left[n] + over.get(n, 0) for n in histogram}
    plan, rank = Plan(), dict.fromkeys(histogram, 0)
    for pattern, often in used:
        offset = 0
        for n, k in pattern:
            plan.whole.append((n, rank[n], rank[n] + k * often, plan.sequences, k, offset))
            rank[n] += k * often
            offset += n * k
        plan.sequences += often
    for n, c in sorted(loose.items()):
        if c:
            plan.stream.append((n, rank[n], rank[n] + c, plan.streamed))
            rank[n] += c
            plan.streamed += n * c
    assert rank == {n: c for n, c in histogram.items()}, "every piece has one place"
    return plan


def tail(streamed: int, capacity: int) -> list[int]:
    """Lengths of the last sequences of the stream: powers of two that make up what is left after the full ones."""
    rest = streamed % capacity
    return [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def cut(place: int, length: int, streamed: int, capacity: int) -> list[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of the parts of a piece that lies at `place` of the stream."""
    out, start = [], 0
    full = streamed // capacity
    while start < length:
        at = place + start
        if at < full * capacity:
            seq, offset, size = at // capacity, at % capacity, capacity
        else:
            offset, seq, size = at - full * capacity, full, 0
            for size in tail(streamed, capacity):
                if offset < size:
                    break
                offset, seq = offset - size, seq + 1
        take = min(length - start, size - offset)
        out.append((start, take, seq, offset))
        start += take
    return out
