"""The packing plan: which lengths share a window, from the counts of lengths alone.

The input has one row per length, 4095 at most whatever the corpus, so the plan is small and is made in one place.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from dataclasses import dataclass


@dataclass(frozen=True)
class Run:
    """The tokens [start, start + length) of the remainders number lo .. lo + count - 1 of one length."""

    of: int
    start: int
    length: int
    lo: int
    count: int

    def split(self, n: int) -> tuple["Run", "Run"]:
        return Run(self.of, self.start, self.length, self.lo, n), Run(self.of, self.start, self.length, self.lo + n, self.count - n)

    def cut(self, n: int) -> tuple["Run", "Run"]:
        return Run(self.of, self.start, n, self.lo, self.count), Run(self.of, self.start + n, self.length - n, self.lo, self.count)


class Pool:
    """Runs by length; a sorted list of the lengths in stock finds the largest that fits."""

    def __init__(self):
        self.runs: dict[int, list[Run]] = defaultdict(list)
        self.lengths: list[int] = []

    def add(self, run: Run) -> None:
        if run.count <= 0 or run.length <= 0:
            return
        if not self.runs[run.length]:
            bisect.insort(self.lengths, run.length)
        self.runs[run.length].append(run)

    def take(self, length: int, most: int) -> Run:
        run = self.runs[length].pop()
        if run.count > most:
            run, rest = run.split(most)
            self.runs[length].append(rest)
        if not self.runs[length]:
            self.lengths.remove(length)
        return run

    def at_most(self, length: int) -> int | None:
        k = bisect.bisect_right(self.lengths, length)
        return self.lengths[k - 1] if k else None

    def above(self, length: int) -> int | None:
        k = bisect.bisect_right(self.lengths, length)
        return self.lengths[k] if k < len(self.lengths) else None


@dataclass
class Windows:
    """`count` windows of one make: the k-th holds the k-th remainder of each run, one after the other."""

    size: int
    count: int
    runs: list[Run]

    @property
    def filled(self) -> int:
        return sum(r.length for r in self.runs)

    @property
    def cost(self) -> int:
        return sum(r.length**2 for r in self.runs)


def plan(counts: dict[int, int], tiers: tuple[int, ...]) -> list[Windows]:
    """Windows for `counts` remainders of each length, all shorter than the largest tier.

    From the largest tier down, the longest remainder opens a window of its tier, and the longest ones that fit fill its gap, which
    takes from all shorter tiers. A last gap that nothing fits is closed with the head of a longer remainder, whose rest goes back
    to the stock. Windows come out full; only when the stock is empty can the last one stay open.
    """
    pool, done = Pool(), []
    for length, count in counts.items():
        pool.add(Run(length, 0, length, 0, count))
    sizes = sorted(tiers)
    while pool.lengths:
        first = pool.take(pool.lengths[-1], 1 << 62)
        size = sizes[bisect.bisect_left(sizes, first.length)]
        waiting = [Windows(size, first.count, [first])]
        while waiting:
            w = waiting.pop()
            while gap := w.size - w.filled:
                length = pool.at_most(gap)
                if length is not None:
                    run = pool.take(length, w.count)
                elif (longer := pool.above(gap)) is not None:
                    run, rest = pool.take(longer, w.count).cut(gap)
                    pool.add(rest)
                elif w.count > 1:  # nothing in stock: some of these windows feed the others
                    keep = max(1, w.count * w.filled // w.size)
                    kept = [r.split(keep) for r in w.runs]
                    for _, back in kept:
                        pool.add(back)
                    w = Windows(w.size, keep, [r for r, _ in kept])
                    continue
                else:
                    break
                if run.count < w.count:
                    halves = [r.split(run.count) for r in w.runs]
                    waiting.append(Windows(w.size, w.count - run.count, [b for _, b in halves]))
                    w = Windows(w.size, run.count, [a for a, _ in halves])
                w.runs.append(run)
            done.append(w)
    return done
