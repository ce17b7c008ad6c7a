"""Bounded samplers: sequential state machines, one to a partition, fed batch by batch.

They hold a bounded histogram whatever the partition's size; the order of rows matters to them, as
back-off and cuts happen when the histogram is full.  Exact counting needs none of this: see
``operators.histogram``.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "task_id int, key string, value double, records_passed long, normalization_factor double, sample_rate double, width int, backoffs int"


@dataclass
class Sampler:
    """State that every sampler has.  ``reset`` clears the counts only: rate and totals stay."""

    seed: int = 0
    counts: dict = field(default_factory=dict)
    passed: int = 0
    factor: float = 0.0
    rate: float = 1.0
    backoffs: int = 0
    version: int = 0

    def __post_init__(self):
        self.random = random.Random(self.seed)

    def reset(self) -> None:
        self.counts = {}

    def set_value(self, counts: dict) -> None:
        self.counts = dict(counts)

    def increment_version(self) -> None:
        self.version += 1

    @property
    def is_empty(self) -> bool:
        return not self.counts

    def _keep(self, n: int) -> None:
        self.counts = dict(sorted(self.counts.items(), key=lambda x: (-x[1], str(x[0])))[: max(n, 0)])

    def normalize(self, total: int) -> dict:
        return {k: v * self.passed / (self.factor * total) for k, v in self.counts.items()} if self.factor else {}

    def rows(self, task: int) -> pd.DataFrame:
        items = list(self.counts.items())
        own = {"records_passed": self.passed, "normalization_factor": self.factor, "sample_rate": self.rate, "width": len(items), "backoffs": self.backoffs}
        return pd.DataFrame({"task_id": task, "key": [k for k, _ in items], "value": [float(v) for _, v in items], **own})


@dataclass
class Naive(Sampler):
    """Counts decay when the width reaches the next boundary; over ``size`` keys only the top ones stay."""

    scale: int = 5000
    size: int = 10000
    compaction: int = 2500
    backoff: float = 1.05

    def __post_init__(self):
        super().__post_init__()
        self.boundary = self.scale

    def add(self, key: object) -> None:
        self.passed += 1
        if self.rate < 1 and self.random.random() > self.rate:
            return
        self.factor += 1
        self.counts[key] = self.counts.get(key, 0.0) + 1
        if len(self.counts) >= self.boundary:
            self.rate /= self.backoff
            self.boundary += self.scale
            self.backoffs += 1
            self.factor /= self.backoff
            self.counts = {k: v / self.backoff for k, v in self.counts.items()}
        if len(self.counts) > self.size:
            self._keep(self.compaction)
            self.boundary = len(self.counts) + self.scale


@dataclass
class DriftRespecting(Sampler):
    """Sampled counts are scaled up; how much of the histogram is cut depends on the drift of its top keys."""

    take: int = 2000
    soft: int = 5000
    compaction: int = 2500
    backoff: float = 1.05
    drift_bound: float = 0.5
    weight: float = 0.8
    solidarity: int = 5

    def __post_init__(self):
        super().__post_init__()
        self.hard, self.step, self.history, self.calm, self.drift, self.drifts = self.soft, 1.0, None, 0, self.drift_bound, []

    def merge_with(self, other: DriftRespecting) -> None:
        """Take over the other's state: the latest snapshot wins, nothing is added up."""
        if type(other) is not type(self):
            raise TypeError("only samplers of one kind merge")
        self.__dict__.update({k: v for k, v in other.__dict__.items() if k not in ("seed", "random")})

    def add(self, key: object) -> None:
        self.passed += 1
        if self.rate < 1 and self.random.random() > self.rate:
            return
        self.factor += self.step
        self.counts[key] = self.counts.get(key, 0.0) + self.step
        if len(self.counts) >= self.hard:
            self._full()

    def _full(self) -> None:
        self.rate, self.step, self.backoffs = self.rate / self.backoff, self.step * self.backoff, self.backoffs + 1
        ranked = sorted(self.counts.items(), key=lambda x: (-x[1], str(x[0])))
        top = {k for k, _ in ranked[: self.take]}
        if self.history is None:
            self.hard, self.calm = self.hard + self.soft, 0
        else:
            self.drift = self.weight * self.drift + (1 - self.weight) * self._fallen(ranked, top)
            if self.drift > self.drift_bound:
                self.hard, self.calm = self.hard + self.soft, 0
            else:
                self.calm += 1
                if self.calm >= self.solidarity and self.hard > self.soft:
                    self.hard, self.calm = self.hard - self.soft, 0
                self._keep(self.hard - self.compaction)
        self.history = top

    def _fallen(self, ranked: list, top: set) -> float:
        width, least = len(ranked), ranked[: self.take][-1][1]
        place = {k: i for i, (k, _) in enumerate(ranked)}
        current = sum(place.get(k, width) - self.take + least - self.counts.get(k, 0.0) for k in self.history - top)
        most = ((least - self.take + width) + (least - 2 * self.take + width)) / 2 * self.take
        self.drifts.append(current / most if most else 0.0)
        return self.drifts[-1]


@dataclass
class Lossy(Sampler):
    """Lossy counting (Manku and Motwani 2002): undercounts by ``error`` times the records at most.

    Keys below their bucket's bound go at each bucket's end, so distinct keys seen once don't stay.
    """

    frequency: float = 0.01
    error: float = 0.001

    def __post_init__(self):
        super().__post_init__()
        self.bucket, self.slack = 1, {}

    def add(self, key: object) -> None:
        self.passed += 1
        self.factor += 1
        if key in self.counts:
            self.counts[key] += 1
        else:
            self.counts[key], self.slack[key] = 1.0, self.bucket - 1
        if self.passed % round(1 / self.error) == 0:
            self.counts = {k: v for k, v in self.counts.items() if v + self.slack[k] > self.bucket}
            self.slack = {k: self.slack[k] for k in self.counts}
            self.bucket += 1

    def frequent(self) -> dict:
        return {k: v for k, v in self.counts.items() if v >= (self.frequency - self.error) * self.passed}


def sample(rows: DataFrame, key: str, make, task: str | None = None) -> DataFrame:
    """One sampler for each partition (or for each value of ``task``, dealt to partitions); SCHEMA rows.

    ``make(seed)`` returns a sampler.  Keys are counted as text.  Rows are not sorted by task, which would
    hold a task's rows: each partition has the samplers of its tasks side by side, all of them bounded.
    """
    if task is not None:
        rows = rows.repartition(F.col(task))
    columns = rows.select(F.col(task).cast("int").alias("t") if task else F.spark_partition_id().alias("t"), F.col(key).cast("string").alias("k"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = {}
        for pdf in batches:
            for t, part in pdf.groupby("t", sort=True):
                if t not in own:
                    own[int(t)] = make(int(t))
                add = own[int(t)].add
                for k in part["k"]:
                    add(k)
        for t in sorted(own):
            yield own[t].rows(t)

    return columns.mapInPandas(run, SCHEMA)
