"""Key histograms: per task, normalised, merged, validated, compacted, and compared over time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from evenkeel.functions.hashing import md5_unit


def local(rows: DataFrame, key: str, task: str, rate: float = 1.0, record: str | None = None) -> DataFrame:
    """``task_id, key, value``: how often each key was sampled in each task.

    With a rate below 1 a record is sampled if the hash of its ``record`` column is at most the rate,
    so that the sample depends on neither order nor partitioning.
    """
    if rate < 1:
        rows = rows.where(md5_unit(F.col(record)) <= rate)
    return rows.groupBy(F.col(task).alias("task_id"), F.col(key).alias("key")).agg(F.count("*").cast("double").alias("value"))


def meta(rows: DataFrame, task: str, rate: float = 1.0, record: str | None = None) -> DataFrame:
    """``task_id, records_passed, normalization_factor``: records seen and records sampled in each task."""
    sampled = F.lit(True) if rate >= 1 else md5_unit(F.col(record)) <= rate
    return rows.groupBy(F.col(task).alias("task_id")).agg(F.count("*").alias("records_passed"), F.count_if(sampled).cast("double").alias("normalization_factor"))


def normalize(histogram: DataFrame, tasks: DataFrame) -> DataFrame:
    """``task_id, key, freq``: share of the key in its task times the task's share of all records."""
    total = tasks.agg(F.sum("records_passed").alias("total"))
    joined = histogram.join(tasks, "task_id").crossJoin(total)  # one row
    return joined.select("task_id", "key", (F.col("value") * F.col("records_passed") / (F.col("normalization_factor") * F.col("total"))).alias("freq"))


def size_limit(n: int, multiplier: int = 2) -> int:
    """Keys that a global histogram keeps at most."""
    return max(n * multiplier + 1, 2500)


def global_histogram(histogram: DataFrame, tasks: DataFrame, limit: int) -> DataFrame:
    """``rank, key, freq``: the most frequent keys of all tasks, ties by key."""
    return ranked(normalize(histogram, tasks).groupBy("key").agg(F.sum("freq").alias("freq")), limit)


def shares(rows: DataFrame, key: str) -> DataFrame:
    """``key, freq`` of every key at sampling rate 1, where tasks need not be told apart: one aggregate."""
    counts = rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(total).select("key", (F.col("n") / F.col("total")).alias("freq"))  # one row


def exact(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """``rank, key, freq`` of the ``limit`` most frequent keys: one aggregate, one top-k.  For all keys see ``shares``."""
    return ranked(shares(rows, key), limit)


def ranked(freqs: DataFrame, limit: int) -> DataFrame:
    """``rank, key, freq`` of the ``limit`` largest: the top-k first, so that the numbering sees only those.

    Frequencies that agree to 12 places are ties: sums over tasks differ in the last bits.
    """
    falling = F.desc(F.round("freq", 12))
    top = freqs.orderBy(falling, "key").limit(limit)
    number = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(falling, "key"))
    return top.select(number.alias("rank"), "key", "freq")


def merge(a: DataFrame, b: DataFrame, f: Callable[[Column, Column], Column] | None = None, zero: float = 0.0) -> DataFrame:
    """``key, value``: sums over both histograms, or with ``f``: f(b's value, a's or ``zero``) for b's keys, a's own value for the others."""
    if f is None:
        return a.select("key", "value").unionByName(b.select("key", "value")).groupBy("key").agg(F.sum("value").alias("value"))
    x, y = a.select("key", F.col("value").alias("v1")), b.select("key", F.col("value").alias("v2"))
    both = x.join(y, "key", "full_outer")
    return both.select("key", F.when(F.col("v2").isNull(), F.col("v1")).otherwise(f(F.col("v2"), F.coalesce("v1", F.lit(zero)))).alias("value"))


def weighted_merge(a: DataFrame, b: DataFrame, weight: float) -> DataFrame:
    """``key, value``: weight times a's value plus (1 - weight) times b's; a missing key counts 0."""
    x, y = a.select("key", F.col("value").alias("v1")), b.select("key", F.col("value").alias("v2"))
    value = F.lit(weight) * F.coalesce("v1", F.lit(0.0)) + F.lit(1 - weight) * F.coalesce("v2", F.lit(0.0))
    return x.join(y, "key", "full_outer").select("key", value.alias("value"))


def validity(histogram: DataFrame, column: str = "freq") -> DataFrame:
    """One row ``keys, valid``: two keys or more, and no infinite or undefined value."""
    value = F.col(column)
    sound = ~F.isnan(value) & (F.abs(value) != float("inf")) & value.isNotNull()
    return histogram.agg(F.count("*").alias("keys"), ((F.count("*") >= 2) & F.coalesce(F.bool_and(sound), F.lit(False))).alias("valid"))


def latest(snapshots: DataFrame, current: int) -> DataFrame:
    """Of snapshots ``partition_id, version, seq, ...`` of the current version each partition's last row."""
    own = snapshots.where(F.col("version") == current)
    columns = [c for c in own.columns if c != "partition_id"]
    return own.groupBy("partition_id").agg(F.max_by(F.struct(*columns), "seq").alias("s")).select("partition_id", "s.*")


def compact(histogram: DataFrame, size: int, keep: int) -> DataFrame:
    """The histogram; if it has more than ``size`` keys only its ``keep`` largest, ties by key."""
    order = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("value"), "key"))
    width = histogram.agg(F.count("*").alias("width"))
    top = histogram.orderBy(F.desc("value"), "key").limit(keep).select("key", "value", order.alias("at")).crossJoin(width)
    whole = histogram.crossJoin(width).where(F.col("width") <= size).select("key", "value")
    return top.where(F.col("width") > size).select("key", "value").unionByName(whole)


def back_off(rows: DataFrame, key: str, record: str, factor: float, steps: int) -> DataFrame:
    """``key, sampled, estimate`` after ``steps`` back-offs: rate factor^-steps, counts scaled back up."""
    rate = factor**-steps
    counts = rows.where(md5_unit(F.col(record)) <= rate).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("sampled"))
    return counts.select("key", "sampled", (F.col("sampled") / F.lit(rate)).alias("estimate"))


def throughput_gate(records: DataFrame, bound: int) -> DataFrame:
    """Of ``task_id, seq, records_passed`` the snapshots that a task sends, with ``delta``.

    A snapshot is sent when ``bound`` records or more have passed since the last one that was sent;
    ``delta`` is how many.  Snapshots of an empty histogram (``width`` 0, where there is that column) are
    not looked at.  What is sent depends on what was sent before, so each task's snapshots are folded
    in order, in batches: the state is one number.
    """
    if "width" in records.columns:
        records = records.where("width > 0")
    ordered = records.repartition("task_id").sortWithinPartitions("task_id", "seq")

    def gate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, sent = None, 0
        for pdf in batches:
            keep, deltas = [], []
            for i, (t, passed) in enumerate(zip(pdf.task_id, pdf.records_passed)):
                if t != task:
                    task, sent = t, 0
                if passed - sent >= bound:
                    keep.append(i)
                    deltas.append(passed - sent)
                    sent = passed
            yield pdf.iloc[keep].assign(delta=deltas)

    return ordered.mapInPandas(gate, StructType([*records.schema.fields, StructField("delta", LongType())]))


def concept_drift(now: DataFrame, history: DataFrame, take: int, weight: float = 0.8, old: float = 0.5) -> DataFrame:
    """One row ``width, min_top, lost, current, maximum, drift, drift_history``.

    ``now`` and ``history`` are ``key, value``; the history set is the keys of history's ``take``
    largest.  Each of those that is no longer among now's ``take`` largest adds how far it fell:
    its place behind them (or the width, if it is gone) and its value below theirs.

    Places come from a range-partitioned sort: a row's place is its number within its partition plus the
    rows of the partitions before.  So only a row for each partition, with the history keys that it
    holds, comes together.
    """
    past = history.orderBy(F.desc("value"), "key").limit(take).select(F.col("key").alias("k"))
    sorted_ = now.join(F.broadcast(past), F.col("key") == F.col("k"), "left").orderBy(F.desc("value"), "key")
    numbered = sorted_.select("key", "value", F.col("k").isNotNull().alias("known"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("i"))
    mark = F.struct("key", "value", "i")
    per = numbered.groupBy("p").agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("known"), mark)).alias("hits"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    per = per.withColumn("before", before)
    placed = F.flatten(F.collect_list(F.transform("hits", lambda h: F.struct((F.col("before") + h["i"]).alias("place"), h["value"].alias("value")))))
    all_ = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("width"), placed.alias("hits"))
    top = now.orderBy(F.desc("value")).limit(take).agg(F.min("value").alias("min_top"))
    row = all_.crossJoin(top).crossJoin(past.agg(F.count("*").alias("known")))  # one row each
    fallen = F.filter("hits", lambda h: h["place"] >= take)
    gone = F.col("known") - F.size("hits")
    fall = F.aggregate(fallen, F.lit(0.0), lambda s, h: s + (h["place"] - take + F.col("min_top") - h["value"])) + gone * (F.col("width") - take + F.col("min_top"))
    row = row.select("width", "min_top", (F.size(fallen) + gone).cast("long").alias("lost"), F.coalesce(fall, F.lit(0.0)).alias("current"))
    most = ((F.col("min_top") - take + F.col("width")) + (F.col("min_top") - 2 * take + F.col("width"))) / 2 * take
    row = row.withColumn("maximum", most).withColumn("drift", F.col("current") / F.col("maximum"))
    return row.withColumn("drift_history", F.lit(weight) * old + F.lit(1 - weight) * F.col("drift"))


def save_heavy_hitter(histogram: DataFrame, version: int, path: str) -> None:
    """Append the top key and the version to a text file set."""
    histogram.orderBy("rank").limit(1).select(F.concat(F.col("key").cast("string"), F.lit(f" ({version})"))).write.mode("append").text(path)
