"""What a placement costs: loads, imbalance, moved records, and a simulation batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def loads(rows: DataFrame, target: Column, weight: Column | None = None) -> DataFrame:
    """``partition, load``: rows (or summed weight) of the partitions that have any."""
    what = F.count("*").cast("double") if weight is None else F.sum(weight)
    return rows.groupBy(target.cast("int").alias("partition")).agg(what.alias("load"))


def imbalance(rows: DataFrame, target: Column, n: int) -> DataFrame:
    """One row ``partitions, total, largest, imbalance``: the largest load over the mean of n partitions."""
    found = loads(rows, target)
    return found.agg(F.lit(n).alias("partitions"), F.sum("load").alias("total"), F.max("load").alias("largest"), (F.max("load") * n / F.sum("load")).alias("imbalance"))


def migration(rows: DataFrame, old: Column, new: Column) -> DataFrame:
    """One row ``total, moved, share``: records whose partition changes."""
    return rows.agg(F.count("*").alias("total"), F.count_if(old != new).alias("moved"), (F.count_if(old != new) / F.count("*")).alias("share"))


def simulate(rows: DataFrame, batch: str, key: str, n: int, partitioners: dict[int, Callable[[Column], Column]], default: Callable[[Column], Column]) -> DataFrame:
    """For each batch: imbalance of hashing (``hash_train``), of the partitioner made from the batch on
    the batch (``train``) and on the next one (``test``).  One aggregate over the rows.
    """
    k, b = F.col(key), F.col(batch)

    def made(offset: int) -> Column:
        case = None
        for number, target in partitioners.items():
            case = (case.when if case is not None else F.when)(b == number + offset, target(k))
        return default(k) if case is None else case.otherwise(default(k))

    kinds = {"hash_train": default(k), "train": made(0), "test": made(1)}
    long = rows.select(b.alias("b"), F.inline(F.array(*(F.struct(F.lit(name).alias("kind"), t.cast("int").alias("p")) for name, t in kinds.items()))))
    per = long.groupBy("b", "kind", "p").agg(F.count("*").alias("n"))
    ratio = per.groupBy("b", "kind").agg((F.max("n") * n / F.sum("n")).alias("imbalance"))
    shown = ratio.withColumn("batch", F.when(F.col("kind") == "test", F.col("b") - 1).otherwise(F.col("b")))
    value = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("imbalance"))).alias(kind)
    return shown.where(F.col("batch") >= 0).groupBy("batch").agg(*map(value, kinds))
