"""Weighted hash rings: slots of a circle owned by partitions, built from weights and adapted to new ones."""

from __future__ import annotations

import bisect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evenkeel.functions import literals
from evenkeel.functions.hashing import md5_unit, murmur3_pair

REPLICAS = 100


def half_even(x: float) -> int:
    return round(x)


def half_up(x: float) -> int:
    import math

    return math.floor(x + 0.5)


@dataclass(frozen=True)
class Ring:
    """``owners[slot]``; ``migration`` is the share of slots that the last adaptation moved (None if built anew)."""

    owners: tuple[int, ...]
    weights: tuple[float, ...]
    replicas: int = REPLICAS
    migration: float | None = None

    @property
    def slots(self) -> int:
        return len(self.owners)

    @classmethod
    def build(cls, weights: list[float], replicas: int = REPLICAS) -> Ring:
        """Slots in proportion to the weights, in partition order; the last point is the number of slots."""
        total = sum(weights)
        weights = [w / total for w in weights] if total > 0 else [1 / len(weights)] * len(weights)
        slots, at, points = len(weights) * replicas, 0.0, []
        for w in weights:
            at += w
            points.append(half_even(at * slots))
        points[-1] = slots
        owners, before = [], 0
        for p, point in enumerate(points):
            owners += [p] * (point - before)
            before = max(before, point)
        return cls(tuple(owners[:slots]), tuple(weights), replicas)

    def transfers(self, weights: list[float]) -> list[int]:
        """Slots that each partition gains (or loses) under new weights."""
        out, at, before = [], 0.0, 0
        for new, old in zip(weights, self.weights):
            at += new - old
            out.append(half_up(at * self.slots) - before)
            before += out[-1]
        return out

    def adapt(self, weights: list[float]) -> Ring:
        """New owners for as few slots as the new weights ask for.

        In ring order a slot leaves an owner that has slots to give, for the first partition that
        still needs one.
        """
        if len(weights) != len(self.weights):
            return Ring.build(weights, self.replicas)
        total = sum(weights)
        weights = [w / total for w in weights] if total > 0 else [1 / len(weights)] * len(weights)
        open_ = self.transfers(weights)
        moved = sum(t for t in open_ if t > 0)
        owners = list(self.owners)
        takers = [p for p, t in enumerate(open_) for _ in range(max(t, 0))]
        taken = 0
        for slot, owner in enumerate(owners):
            if open_[owner] < 0 and taken < len(takers):
                owners[slot] = takers[taken]
                open_[owner] += 1
                taken += 1
        return Ring(tuple(owners), tuple(weights), self.replicas, moved / self.slots)

    def lookup(self, unit: Column) -> Column:
        """Partition of a unit hash: the slots are one array literal in the plan."""
        slot = F.pmod(F.floor(unit * self.slots), F.lit(self.slots)).cast("int")
        return F.get(literals.array(list(self.owners), "int"), slot)

    def partition(self, unit: float) -> int:
        return self.owners[int(unit * self.slots) % self.slots]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.owners)), "slot int, partition int")


def build_frame(weights: DataFrame, slots: int) -> DataFrame:
    """``slot, partition`` from ``partition, w`` (weights that sum to 1), as one window and an explode."""
    order = Window.partitionBy(F.lit(1)).orderBy("partition")  # one row a partition
    last = F.lead("partition").over(order).isNull()
    point = F.when(last, F.lit(slots)).otherwise(F.bround(F.sum("w").over(order) * slots).cast("int"))
    points = weights.select("partition", point.alias("high"))
    spans = points.withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0)))
    return spans.where("low < high").select(F.explode(F.sequence("low", F.col("high") - 1)).alias("slot"), "partition")


def adapt_frame(ring: DataFrame, old: DataFrame, new: DataFrame, slots: int) -> DataFrame:
    """``slot, partition`` after adaptation: ranks within owners choose the slots, ranks among them the takers."""
    order = Window.partitionBy(F.lit(1)).orderBy("partition")
    both = old.select("partition", F.col("w").alias("a")).join(new.select("partition", F.col("w").alias("b")), "partition")
    edge = F.floor(F.sum(F.col("b") - F.col("a")).over(order) * slots + 0.5).cast("int")
    transfer = both.select("partition", edge.alias("edge")).withColumn("t", F.col("edge") - F.coalesce(F.lag("edge").over(order), F.lit(0))).select("partition", "t")
    own = Window.partitionBy("partition").orderBy("slot")
    ranked = ring.withColumn("r", F.row_number().over(own)).join(transfer, "partition").withColumn("moves", F.col("r") <= -F.col("t"))
    moving = ranked.where("moves").withColumn("m", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("slot")))
    upper = F.sum(F.greatest("t", F.lit(0))).over(order)
    takers = transfer.select(F.col("partition").alias("taker"), (upper - F.greatest("t", F.lit(0))).alias("low"), upper.alias("high")).where("low < high")
    given = moving.join(takers, (F.col("m") > F.col("low")) & (F.col("m") <= F.col("high")), "left")
    stay = ranked.where(~F.col("moves")).select("slot", "partition")
    return stay.unionByName(given.select("slot", F.coalesce("taker", "partition").cast("int").alias("partition")))


@dataclass(frozen=True)
class PointRing:
    """Replicas of each partition at hashed points; a key belongs to the first point at or above its hash, or wraps."""

    points: tuple[tuple[float, int], ...]

    @classmethod
    def build(cls, spark: SparkSession, n: int, replicas: int = REPLICAS) -> PointRing:
        rows = spark.range(n * replicas).select((F.col("id") / replicas).cast("int").alias("p"), (F.col("id") % replicas).alias("r"))
        placed = rows.select(md5_unit(F.concat_ws("|", "p", "r")).alias("u"), "p").collect()
        return cls(tuple(sorted({r.u: r.p for r in sorted(placed)}.items())))

    @classmethod
    def hashed(cls, n: int, replicas: int = REPLICAS, pair: Callable[[int, int], int] = murmur3_pair) -> PointRing:
        """Points at ``pair(partition, replica)``, on the circle of signed ints; of equal ones the last holds."""
        return cls(tuple(sorted({pair(p, r): p for p in range(n) for r in range(replicas)}.items())))

    def target(self, value: Column) -> Column:
        """The partition of a hash value, by binary search in two literals; null goes to partition 0."""
        at = literals.lower_bound([float(x) for x, _ in self.points], value.cast("double"))
        return F.when(value.isNull(), F.lit(0)).otherwise(F.get(literals.array([p for _, p in self.points], "int"), at % len(self.points)))

    def partition(self, unit: float) -> int:
        k = bisect.bisect_left(self.points, (unit, -1))
        return self.points[k % len(self.points)][1]

    def lookup(self, keys: DataFrame, unit: Column, into: str = "partition") -> DataFrame:
        """``keys`` with a partition: an equality join on cells of the circle, then the nearest point above."""
        cells = len(self.points)
        spark = keys.sparkSession
        edges = [(-1.0, *self.points[0])] + [(a[0], b[0], b[1]) for a, b in zip(self.points, self.points[1:])] + [(self.points[-1][0], 1.0, self.points[0][1])]
        arcs = spark.createDataFrame(edges, f"lo double, hi double, {into} int")
        cell = lambda c: F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * cells).cast("int")
        grid = arcs.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))))
        drawn = keys.withColumn("_u", unit).withColumn("_cell", cell(F.col("_u")))
        return drawn.join(grid, (F.col("_cell") == F.col("cell")) & (F.col("lo") < F.col("_u")) & (F.col("_u") <= F.col("hi"))).drop("_u", "_cell", "cell", "lo", "hi")
