"""Partitioning functions for stateful streams after Gedik (2014): Scan, Redist and Readj.

All weigh balance (of state, computation and network load) against migration, over a bounded list
of tracked keys; other keys follow a consistent-hash ring.  The searches are folds on the driver:
Scan costs K n evaluations, Redist K^2 n, Readj more, so the caller bounds K (2n by default).
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass, field

Frequency = Callable[[float], float]


def identity(x: float) -> float:
    return x


@dataclass(frozen=True)
class Costs:
    """State and computation size by frequency, allowed imbalance by resource, and how penalties combine."""

    state: Frequency = identity
    work: Frequency = identity
    theta: tuple[float, float, float] = (0.2, 0.2, 0.2)
    utility: Callable[[float, float], float] = operator.add

    def loads(self, f: float) -> tuple[float, float, float]:
        return self.state(f), f * self.work(f), f


@dataclass
class Balance:
    """Loads of each partition by resource; penalty = cube root of the product of (max - min) / (theta avg)."""

    n: int
    costs: Costs
    loads: list[list[float]] = field(default_factory=list)

    def __post_init__(self):
        self.loads = self.loads or [[0.0] * self.n for _ in range(3)]

    def add(self, p: int, f: float, sign: int = 1) -> None:
        for row, x in zip(self.loads, self.costs.loads(f)):
            row[p] += sign * x

    def penalties(self) -> list[float]:
        out = []
        for row, theta in zip(self.loads, self.costs.theta):
            mean = sum(row) / self.n
            out.append((max(row) - min(row)) / (theta * mean) if mean > 0 else 0.0)
        return out

    def penalty(self) -> float:
        a, b, c = self.penalties()
        return max(a * b * c, 0.0) ** (1 / 3)

    def penalty_with(self, moves: list[tuple[int, float, int]]) -> float:
        for p, f, sign in moves:
            self.add(p, f, sign)
        out = self.penalty()
        for p, f, sign in moves:
            self.add(p, f, -sign)
        return out


@dataclass(frozen=True)
class Tracked:
    """Current frequencies in falling order, previous ones, and the old and ring places of all of them."""

    current: tuple[tuple[object, float], ...]
    previous: dict
    old: dict
    ring: dict
    n: int
    costs: Costs = Costs()

    def left(self) -> float:
        """Migration of keys that are tracked no more: those whose old place is not the ring's."""
        now = dict(self.current)
        return sum(self.costs.state(f) for k, f in self.previous.items() if k not in now and self.old[k] != self.ring[k])

    def ideal(self) -> float:
        """State of all known keys (the current frequency counts) over the partitions."""
        return sum(map(self.costs.state, ({**self.previous, **dict(self.current)}).values())) / self.n or 1.0

    def migration(self, moved: float) -> float:
        return moved / self.ideal()


def scan(t: Tracked) -> dict:
    """Keys in falling order, each where utility is least; ties (to 9 places) to the lowest partition."""
    balance, moved, placed = Balance(t.n, t.costs), t.left(), {}
    for key, f in t.current:
        cost = [t.costs.utility(balance.penalty_with([(p, f, 1)]), t.migration(moved + t.costs.state(f) * (p != t.old[key]))) for p in range(t.n)]
        p = min(range(t.n), key=lambda p: (round(cost[p], 9), p))
        placed[key] = p
        balance.add(p, f)
        moved += t.costs.state(f) * (p != t.old[key])
    return placed


def redist(t: Tracked) -> dict:
    """Again and again the key and place of the least utility per frequency; ties (to 9 places) by (frequency falling, key, partition)."""
    balance, moved, placed = Balance(t.n, t.costs), t.left(), {}
    left = sorted(t.current, key=lambda x: (-x[1], str(x[0])))
    while left:
        best = None
        for i, (key, f) in enumerate(left):
            for p in range(t.n):
                u = t.costs.utility(balance.penalty_with([(p, f, 1)]), t.migration(moved + t.costs.state(f) * (p != t.old[key])))
                u = round(u / f, 9) if f > 0 else float("inf")  # keys without weight come last
                if best is None or u < best[0]:
                    best = (u, i, p)
        _, i, p = best
        key, f = left.pop(i)
        placed[key] = p
        balance.add(p, f)
        moved += t.costs.state(f) * (p != t.old[key])
    return placed


def readj(t: Tracked, most: int = 5) -> dict:
    """Moves and swaps from the old places, best gain first, while one lowers the balance penalty.

    A key may take part while it has been readjusted ``most`` times or less.  The utility that gains
    are measured from is lowered within the search too; swaps of equal frequencies gain nothing
    measurable and are skipped.
    """
    f = dict(t.current)
    placed = {k: t.old[k] for k in f}
    balance, times, moved, u = Balance(t.n, t.costs), dict.fromkeys(f, 0), t.left(), 0.0
    for k, p in placed.items():
        balance.add(p, f[k])
    state = t.costs.state

    def plus(key: object, source: int, target: int) -> float:
        return state(f[key]) * ((t.old[key] == source) - (t.old[key] == target))

    while True:
        best, gain, start = None, float("-inf"), balance.penalty()
        members = [[k for k, _ in t.current if placed[k] == p and times[k] <= most] for p in range(t.n)]
        for i in range(t.n):
            for j in range(t.n):
                for a in members[i] if i != j else ():
                    for b in (*members[j], None):
                        apart = abs(f[a] - (f[b] if b is not None else 0.0))
                        if apart == 0:
                            continue
                        moves = [(i, f[a], -1), (j, f[a], 1)] + ([(j, f[b], -1), (i, f[b], 1)] if b is not None else [])
                        penalty = balance.penalty_with(moves)
                        if penalty < start - 1e-12:
                            change = plus(a, i, j) + (plus(b, j, i) if b is not None else 0.0)
                            now = t.costs.utility(penalty, t.migration(moved + change))
                            if (u - now) / apart > gain:
                                best, gain, u = (i, j, a, b, moves, change), (u - now) / apart, now
        if best is None:
            return placed
        i, j, a, b, moves, change = best
        for p, freq, sign in moves:
            balance.add(p, freq, sign)
        placed[a], times[a] = j, times[a] + 1
        if b is not None:
            placed[b], times[b] = i, times[b] + 1
        moved += change


SEARCHES = {"scan": scan, "redist": redist, "readj": readj}


def penalties(t: Tracked, placed: dict) -> dict:
    """Balance by resource and combined, and migration, of an assignment."""
    balance = Balance(t.n, t.costs)
    for k, f in t.current:
        balance.add(placed[k], f)
    s, c, n = balance.penalties()
    moved = t.left() + sum(t.costs.state(f) for k, f in t.current if placed[k] != t.old[k])
    return {"state": s, "work": c, "network": n, "balance": balance.penalty(), "migration": t.migration(moved)}
