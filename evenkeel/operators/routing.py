"""Deal rows to partitions by a partitioner, and aggregate, apply or join on that placement.

Routing raw rows pays where work per key cannot be combined (grouped Python, lists, keyed state,
joins).  For sums and counts the rows are combined first and only the partial results are routed.
After routing, group and join by (target, key): the target is a function of the key, so results are
the same and no second exchange is planned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions import literals

TARGET = "target_partition"


def route(rows: DataFrame, n: int, target: Column) -> DataFrame:
    """``rows`` with TARGET, each on the partition of that number (null: 0); one exchange."""
    return rows.withColumn(TARGET, F.coalesce(target.cast("int"), F.lit(0))).repartitionById(n, F.col(TARGET))


def skew_group_agg(rows: DataFrame, key: str, n: int, target: Callable[[Column], Column], **sums: str) -> DataFrame:
    """``key``, a sum for each ``name=column``, and TARGET, where the partitioner has the key.

    One exchange: sums are combined in each task before it, so a heavy key is a row a task there,
    wherever it goes; the finished sums are not dealt out again.
    """
    summed = rows.groupBy(F.col(key)).agg(*(F.sum(c).alias(a) for a, c in sums.items()))
    return summed.withColumn(TARGET, F.coalesce(target(F.col(key)).cast("int"), F.lit(0)))


def skew_apply(rows: DataFrame, key: str, n: int, target: Callable[[Column], Column], run, schema: str) -> DataFrame:
    """``applyInPandas`` by key on routed rows; ``run`` takes a frame of one key (with TARGET)."""
    return route(rows, n, target(F.col(key))).groupBy(TARGET, key).applyInPandas(run, schema)


def skew_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, n: int, target: Callable[[Column], Column], how: str = "inner", heavy: Iterable = (), spread: int | None = None) -> DataFrame:
    """Join on (target, key), both sides routed alike: their exchanges serve the join.

    ``heavy`` are keys too large for one partition of ``left``, as a histogram has them: their rows on
    the left are dealt over ``spread`` partitions (all n by default), and their rows on the right are
    repeated for each.  Only what repeats no unmatched right rows can do that.
    """
    spread = n if spread is None else max(1, min(spread, n))
    hot = dict.fromkeys(heavy, 1)
    if hot and how not in ("inner", "left", "left_outer", "leftouter", "left_semi", "semi", "leftsemi", "left_anti", "anti", "leftanti"):
        raise ValueError(f"heavy keys of the left side can't be spread in a {how} join")
    is_hot = lambda key: literals.mapping(hot, key).isNotNull() if hot else F.lit(False)
    own = lambda key: F.coalesce(target(F.col(key)).cast("int"), F.lit(0))
    salt = F.when(is_hot(F.col(left_key)), F.pmod(F.monotonically_increasing_id(), F.lit(spread)).cast("int")).otherwise(F.lit(0))
    copies = F.when(is_hot(F.col(right_key)), F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(F.lit(0)))
    a = left.withColumn(TARGET, F.pmod(own(left_key) + salt, F.lit(n))).repartitionById(n, F.col(TARGET))
    b = right.withColumn("_c", F.explode(copies)).withColumn("_t", F.pmod(own(right_key) + F.col("_c"), F.lit(n))).drop("_c").repartitionById(n, F.col("_t"))
    joined = a.join(b, (F.col(TARGET) == F.col("_t")) & (F.col(left_key) == F.col(right_key)), how)
    return joined.drop(TARGET, "_t")


def salted_join(big: DataFrame, small: DataFrame, key: str, salts: int) -> DataFrame:
    """Inner join in which each key of ``big`` is spread over ``salts`` partitions; ``small`` is repeated as often.

    The copies are dealt out and sorted, never broadcast: the planner takes them for as small as ``small``
    itself, and each task would hold all of them.
    """
    spread = big.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies.hint("merge"), [key, "_salt"]).drop("_salt")
