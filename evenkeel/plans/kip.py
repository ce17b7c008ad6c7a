"""Key-isolating partitioner: heavy keys are placed one by one, the others fill up a weighted ring.

A partitioner is an immutable value that compiles to one integer column.  Placement is a fold over
at most 2n heavy keys on the driver; everything that grows with the data stays in DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions import literals
from evenkeel.functions.hashing import hash_partition, md5_unit
from evenkeel.plans.cuts import Cut, water_fill
from evenkeel.plans.ring import REPLICAS, Ring

#: How far above the level a partition may be filled.
SLACK = 0.001


def least_loaded(loads: list[float]) -> int:
    return min(range(len(loads)), key=lambda p: (loads[p], p))


def place_greedy(heavy: list[tuple[object, float]], n: int, old: Callable[[object], int]) -> tuple[dict, list[float], float]:
    """Each key to the least loaded partition, heaviest first; loads, and the mass that moved."""
    loads, placed, moved = [0.0] * n, {}, 0.0
    for key, f in heavy:
        p = least_loaded(loads)
        placed[key] = p
        loads[p] += f
        moved += f * (p != old(key))
    return placed, loads, moved


def place_staying(heavy: list[tuple[object, float]], n: int, old: Callable[[object], int], internal: Callable[[object], int], slack: float = SLACK) -> tuple[dict, list[float], float]:
    """Keys stay where they are while there is room; the others go where the ring has them, or to the least loaded."""
    loads, placed, moving = [0.0] * n, {}, []
    room = (max(heavy[0][1], 1 / n) if heavy else 1 / n) + slack
    for key, f in heavy:
        p = old(key)
        if loads[p] + f <= room or loads[p] == 0:
            placed[key] = p
            loads[p] += f
        else:
            moving.append((key, f))
    for key, f in moving:
        p = internal(key)
        if p == old(key) or not (loads[p] + f < room or loads[p] == 0):
            p = least_loaded(loads)
        placed[key] = p
        loads[p] += f
    return placed, loads, sum(f for _, f in moving)


def residual_weights(loads: list[float], depth: int = 31) -> tuple[float, list[float]]:
    """Level and ring weights of what heavy keys leave free, partitions in order of their number; equal weights if nothing is."""
    n = len(loads)
    level = water_fill(list(enumerate(loads)), n, depth).level
    free = [max(0.0, level - load) for load in loads]
    total = sum(free)
    return level, [w / total for w in free] if total > 0 else [1 / n] * n


def explicit_or(explicit: dict, key: Column, other: Column) -> Column:
    """The explicit place of a key, else ``other``."""
    return F.coalesce(literals.mapping(explicit, key), other) if explicit else other


@dataclass(frozen=True)
class KeyIsolator:
    """``explicit`` places for heavy keys, a ring for the others (a plain hash before the first update)."""

    n: int
    ring: Ring | None = None
    explicit: dict = field(default_factory=dict)
    heavy_migration: float | None = None
    small_migration: float | None = None
    stay: bool = True
    key_excess: float = 2.0
    replicas: int = REPLICAS
    unit: Callable[[Column], Column] = md5_unit
    fallback: Callable[[Column, int], Column] = hash_partition

    def internal(self, key: Column) -> Column:
        return self.fallback(key, self.n) if self.ring is None else F.coalesce(self.ring.lookup(self.unit(key)), F.lit(0))

    def target(self, key: Column) -> Column:
        """The partition of a key, an int in [0, n); the explicit places are a literal of at most 2n entries."""
        return explicit_or(self.explicit, key, self.internal(key))

    def update(self, spark: SparkSession, cut: Cut) -> KeyIsolator:
        """The partitioner for a new histogram.  Old and ring places of heavy keys come from one small query."""
        n = cut.partitions
        heavy = list(cut.heavy[: min(int(n * self.key_excess + 0.5), len(cut.heavy))])
        base = self if n == self.n else replace(self, n=n, ring=None, explicit={})
        keys = [k for k, _ in heavy] + [k for k in base.explicit if k not in dict(heavy)]
        where = base.places(spark, keys)
        old, internal = (lambda k: where[k][0]), (lambda k: where[k][1])
        placed, loads, moved = place_staying(heavy, n, old, internal) if self.stay else place_greedy(heavy, n, old)
        _, weights = residual_weights(loads)
        ring = Ring.build(weights, self.replicas) if base.ring is None else base.ring.adapt(weights)
        new = replace(base, ring=ring, explicit=placed)
        if ring.migration is None:
            return replace(new, heavy_migration=None, small_migration=None)
        gone = [k for k in base.explicit if k not in placed]
        after = new.places(spark, gone)
        left = sum(base.explicit[k] != after[k][1] for k in gone) * (heavy[-1][1] if heavy else 0.0)
        return replace(new, heavy_migration=moved + left, small_migration=(1 - sum(f for _, f in heavy)) * ring.migration)

    def places(self, spark: SparkSession, keys: list) -> dict:
        """(target, internal place) of a few keys."""
        return places(spark, keys, self.target, self.internal)


def places(spark: SparkSession, keys: list, *targets: Callable[[Column], Column]) -> dict:
    """What each of the column functions gives for a few keys."""
    if not keys:
        return {}
    rows = spark.createDataFrame([(k,) for k in keys], "k string" if isinstance(keys[0], str) else "k bigint")
    return {r[0]: tuple(r[1:]) for r in rows.select("k", *(t(F.col("k")) for t in targets)).collect()}
