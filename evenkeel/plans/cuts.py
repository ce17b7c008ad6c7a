"""Water-filling: how many of the heaviest keys to isolate, and the level that the rest fills up to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cut:
    """Keys alone on a partition (``s_cut``), keys placed explicitly (``cut``), level of the other partitions."""

    partitions: int
    cut: int
    s_cut: int
    level: float
    heavy: tuple[tuple[object, float], ...] = ()

    @property
    def sorted_keys(self) -> list:
        return [k for k, _ in self.heavy]

    @property
    def sorted_values(self) -> list[float]:
        return [f for _, f in self.heavy]


def _tree_keys(depth: int) -> int:
    return 2 ** min(depth - 1, 62)


def water_fill(heavy: list[tuple[object, float]], n: int, depth: int, hint: int = 0) -> Cut:
    """The cut of a histogram in falling order, over n partitions.

    A key is isolated while it is at least the level of the partitions left.  ``depth`` bounds the
    keys placed below the isolated ones; ``hint`` is a least number of isolated keys.  If every
    partition is taken by one key the level is 0.
    """
    if n < 1:
        raise ValueError("there must be a partition")
    freqs = [f for _, f in heavy[:n]]
    isolated, rest = 0, 1.0
    while isolated < len(freqs) and rest / (n - isolated) <= freqs[isolated]:
        rest -= freqs[isolated]
        isolated += 1
    isolated = max(hint, isolated)
    level = max(0.0, (1 - sum(freqs[:isolated])) / (n - isolated)) if isolated < n else 0.0
    return Cut(n, isolated + min(_tree_keys(depth), len(freqs) - isolated), isolated, level, tuple(heavy))


def water_fill_frame(histogram: DataFrame, n: int, depth: int, hint: int = 0) -> DataFrame:
    """One row ``partitions, cut, s_cut, level`` of a histogram ``rank, key, freq``, by a prefix sum."""
    top = histogram.where(F.col("rank") <= n)
    before = F.coalesce(F.sum("freq").over(Window.partitionBy(F.lit(1)).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = top.select("rank", "freq", before.alias("before"))
    stops = (1 - F.col("before")) / (n - F.col("rank") + 1) > F.col("freq")
    found = rows.agg(
        F.greatest(F.coalesce(F.min(F.when(stops, F.col("rank") - 1)), F.count("*").cast("int")), F.lit(hint)).alias("s_cut"),
        F.count("*").cast("int").alias("kept"),
        F.array_sort(F.collect_list(F.struct("rank", "freq"))).alias("f"),
    )
    mass = F.aggregate(F.slice("f", 1, F.col("s_cut")), F.lit(0.0), lambda s, x: s + x["freq"])
    level = F.when(F.col("s_cut") >= n, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (1 - mass) / (n - F.col("s_cut"))))
    cut = F.col("s_cut") + F.least(F.lit(_tree_keys(depth)).cast("bigint"), (F.col("kept") - F.col("s_cut")).cast("bigint")).cast("int")
    return found.select(F.lit(n).alias("partitions"), cut.alias("cut"), "s_cut", level.alias("level"))


def parallelism(slots: int, level: float, top: float, force: bool = False, optimize: bool = True) -> int:
    """Partitions to use: all slots, or so many that the heaviest key weighs no more than a level."""
    import math

    return slots if force or not optimize else int(slots * math.ceil(max(level / top, 1)))
