"""The decision loop: histograms of a version in, a partitioner of the next version out.

Spark tasks cannot change their partitioner while a stage runs, so decisions take effect at the next
job or micro-batch.  State is small and lives on the driver; for streams it is also written to the
shared folder, batch by batch, so that a replayed batch gets the partitioner that it had, after a
restart too.
"""

from __future__ import annotations

import atexit
import base64
import json
import logging
import os
import pickle
import shutil
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions.hashing import murmur3_pair, murmur3_text
from evenkeel.operators import histogram as H
from evenkeel.plans import gedik
from evenkeel.plans.cuts import Cut, parallelism, water_fill
from evenkeel.plans.kip import KeyIsolator, explicit_or, places
from evenkeel.plans.ring import REPLICAS, PointRing

log = logging.getLogger("evenkeel")
ENABLED, ONCE, DISABLED = "enabled", "once", "disabled"
#: Partitioners that a decider remembers.
HISTORY = 20


@dataclass(frozen=True)
class Settings:
    """Defaults of the decision loop.  ``strategy``: kip, scan, redist or readj."""

    mode: str = ENABLED
    strategy: str = "kip"
    depth: int = 10
    multiplier: int = 2
    threshold: int = 2
    force_slots: bool = False
    optimize_parallelism: bool = False
    save_path: str | None = None

    @classmethod
    def from_conf(cls, spark: SparkSession, prefix: str = "repart.") -> Settings:
        """Values of ``repart.<name>`` where the session has them."""
        out = {}
        for name, default in cls().__dict__.items():
            raw = spark.conf.get(prefix + name, None)
            if raw is not None:
                out[name] = raw.lower() == "true" if isinstance(default, bool) else type(default)(raw) if default is not None else raw
        return cls(**out)


@dataclass(frozen=True)
class Searched:
    """A partitioner whose explicit places come from Scan, Redist or Readj; other keys follow a ring of hashed points.

    ``hashed`` gives a key's place on the circle of signed ints, ``pair`` a replica's; both can be
    replaced.  A ring is built for the number of partitions when it is first asked for.
    """

    n: int
    search: str
    explicit: dict = field(default_factory=dict)
    previous: dict = field(default_factory=dict)
    replicas: int = REPLICAS
    costs: gedik.Costs = gedik.Costs()
    hashed: Callable[[Column], Column] = murmur3_text
    pair: Callable[[int, int], int] = murmur3_pair

    def internal(self, key: Column) -> Column:
        return PointRing.hashed(self.n, self.replicas, self.pair).target(self.hashed(key))

    def target(self, key: Column) -> Column:
        return explicit_or(self.explicit, key, self.internal(key))

    def update(self, spark: SparkSession, cut: Cut) -> Searched:
        """All heavy keys of the cut are placed; if n changes, keys are taken to be where the new ring has them."""
        n = cut.partitions
        base = self if n == self.n else replace(self, n=n, explicit={})
        keys = list(dict.fromkeys([k for k, _ in cut.heavy] + list(self.previous)))
        where = places(spark, keys, base.target, base.internal)
        tracked = gedik.Tracked(cut.heavy, self.previous, {k: w[0] for k, w in where.items()}, {k: w[1] for k, w in where.items()}, n, self.costs)
        return replace(base, explicit=gedik.SEARCHES[self.search](tracked), previous=dict(cut.heavy))


def make_partitioner(strategy: str, n: int) -> KeyIsolator | Searched:
    if strategy == "kip":
        return KeyIsolator(n)
    if strategy in gedik.SEARCHES:
        return Searched(n, strategy)
    raise ValueError(f"unknown partitioner {strategy!r}: kip, scan, redist or readj")


@dataclass
class Decider:
    """One stage's or stream's decisions.

    ``trace`` records each as (version, outcome), ``history`` the partitioners by version, the newest
    HISTORY of them.  ``total_slots`` is asked before each decision, if it is given; ``slots`` holds else.
    """

    spark: SparkSession
    slots: int
    settings: Settings = Settings()
    version: int = 0
    partitioner: KeyIsolator | Searched | None = None
    arrived: dict = field(default_factory=dict)
    trace: list = field(default_factory=list)
    history: list = field(default_factory=list)
    total_slots: Callable[[], int] | None = None

    def __post_init__(self):
        self.partitioner = self.partitioner or make_partitioner(self.settings.strategy, self.slots)

    def on_histogram(self, partition: int, version: int, counts: dict, passed: int, factor: float) -> bool:
        """Take one partition's histogram of the current version (the latest wins); decide when there are enough."""
        if version != self.version or self.settings.mode == DISABLED or (self.settings.mode == ONCE and self.version):
            return False
        self.arrived[partition] = (counts, passed, factor)
        if len(self.arrived) < self.settings.threshold:
            return False
        total = sum(p for _, p, _ in self.arrived.values())
        freqs: dict = {}
        for own, p, f in self.arrived.values():
            for k, v in own.items():
                freqs[k] = freqs.get(k, 0.0) + v * p / (f * total)
        limit = H.size_limit(self.slots, self.settings.multiplier)
        return self.decide(sorted(freqs.items(), key=lambda x: (-x[1], str(x[0])))[:limit])

    def on_frame(self, rows: DataFrame, key: str) -> bool:
        """Decide from the exact histogram of a frame: one aggregate, a bounded top-k on the driver."""
        top = H.exact(rows, key, H.size_limit(self.slots, self.settings.multiplier))
        return self.decide([(r.key, r.freq) for r in top.orderBy("rank").collect()])

    def decide(self, heavy: list[tuple[object, float]]) -> bool:
        """A new partitioner, if the histogram is valid (two keys or more, all finite)."""
        if len(heavy) < 2 or any(f != f or f in (float("inf"), float("-inf")) for _, f in heavy):
            self.trace.append((self.version, "invalid"))
            self.arrived = {}
            return False
        if self.total_slots is not None:
            self.slots = self.total_slots()
        level = water_fill(heavy, self.slots, self.settings.depth).level
        n = parallelism(self.slots, level, heavy[0][1], self.settings.force_slots, self.settings.optimize_parallelism)
        cut = water_fill(heavy[: self.settings.multiplier * n], n, self.settings.depth)
        self.history = [*self.history, (self.version, self.partitioner)][-HISTORY:]
        self.partitioner = self.partitioner.update(self.spark, cut)
        if self.settings.save_path:
            self.spark.createDataFrame([(f"{heavy[0][0]} ({self.version})",)], "value string").write.mode("append").text(self.settings.save_path)
        self.trace.append((self.version, "repartitioned"))
        self.version += 1
        self.arrived = {}
        log.info("version %d: %d partitions, %d keys isolated", self.version, cut.partitions, cut.s_cut)
        return True


@dataclass
class StreamController:
    """``foreachBatch`` target: batch b is dealt by the partitioner made from the batches before it.

    Histograms of batches are blended (``weight`` for the past).  ``work`` gets the routed batch.  With
    ``state`` (a folder that the stream keeps over restarts) what a batch was dealt by, and what came of
    it, is written there when the batch is done; a controller begins with what the folder has.  So a
    batch that is replayed is dealt as before, and its rows are not counted twice.  Records of the
    newest ``keep`` batches stay, as Spark replays the last one only.
    """

    decider: Decider
    key: str
    work: Callable[[DataFrame, int], None]
    weight: float = 0.5
    state: str | None = None
    keep: int = 10
    seen: dict = field(default_factory=dict)
    blended: dict = field(default_factory=dict)
    records: dict = field(default_factory=dict)
    drifts: list = field(default_factory=list)

    def __post_init__(self):
        if self.state:
            self._restore()

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        from evenkeel.operators.routing import TARGET, route

        replay = batch_id in self.seen
        used = self.seen.get(batch_id, self.decider.partitioner)
        routed = route(batch, used.n, used.target(F.col(self.key))).persist()
        try:
            self.work(routed, batch_id)
            if replay:
                return
            self.seen[batch_id] = used
            self.records[batch_id] = {r[0]: r[1] for r in routed.groupBy(TARGET).count().collect()}
            limit = H.size_limit(used.n, self.decider.settings.multiplier)
            top = H.exact(batch, self.key, limit).collect()
            now = {r.key: r.freq for r in top}
            if self.blended:
                self.drifts.append(drift(now, self.blended, used.n))
                keys = self.blended.keys() | now.keys()
                now = {k: self.weight * self.blended.get(k, 0.0) + (1 - self.weight) * now.get(k, 0.0) for k in keys}
            heavy = sorted(now.items(), key=lambda x: (-x[1], str(x[0])))[:limit]
            self.blended = dict(heavy)
            self.decider.decide(heavy)
            self.forget(batch_id - self.keep + 1)
            if self.state:
                self._save(batch_id)
        finally:
            routed.unpersist()

    def _save(self, batch_id: int) -> None:
        own = {k: getattr(self.decider, k) for k in ("slots", "version", "partitioner", "trace", "history")}
        held = {k: getattr(self, k) for k in ("seen", "blended", "records", "drifts")}
        text = base64.b64encode(pickle.dumps((own, held))).decode()
        self.decider.spark.createDataFrame([(batch_id, text)], "id long, state string").coalesce(1).write.mode("overwrite").parquet(f"{self.state}/batch={batch_id}")

    def _restore(self) -> None:
        spark = self.decider.spark
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.state)
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return
        last = spark.read.schema("id long, state string").parquet(f"{self.state}/*").orderBy(F.desc("id")).limit(1).collect()
        for row in last:  # written by this class in the stream's own folder
            own, held = pickle.loads(base64.b64decode(row.state))
            self.decider.__dict__.update(own)
            self.__dict__.update(held)

    def forget(self, before: int) -> None:
        """Drop remembered batches that can no longer be replayed."""
        self.seen = {b: p for b, p in self.seen.items() if b >= before}
        self.records = {b: r for b, r in self.records.items() if b >= before}

    def describe(self) -> str:
        return json.dumps({"version": self.decider.version, "partitions": self.decider.partitioner.n, "trace": self.decider.trace})


@dataclass
class StreamState:
    """The controllers of a stream's stages, by name; each keeps its state in a folder of its own."""

    spark: SparkSession
    slots: int
    settings: Settings = Settings()
    state: str | None = None
    stages: dict = field(default_factory=dict)

    def stage(self, name: str, key: str, work: Callable[[DataFrame, int], None]) -> StreamController:
        """The stage's controller, made when it is first asked for."""
        if name not in self.stages:
            own = f"{self.state}/{name}" if self.state else None
            self.stages[name] = StreamController(Decider(self.spark, self.slots, self.settings), key, work, state=own)
        return self.stages[name]


def drift(now: dict, past: dict, take: int) -> float:
    """How far the past's ``take`` heaviest keys fell, as a share of the most possible (see ``histogram.concept_drift``)."""
    ranked = sorted(now.items(), key=lambda x: (-x[1], str(x[0])))
    take = min(take, len(ranked))
    if not take:
        return 0.0
    width, least = len(ranked), ranked[take - 1][1]
    place = {k: i for i, (k, _) in enumerate(ranked)}
    lost = [k for k, _ in sorted(past.items(), key=lambda x: (-x[1], str(x[0])))[:take] if place.get(k, width) >= take]
    most = ((least - take + width) + (least - 2 * take + width)) / 2 * take
    return sum(place.get(k, width) - take + least - now.get(k, 0.0) for k in lost) / most if most > 0 else 0.0


def shared_folder(spark: SparkSession) -> str:
    """Where streams and sinks of this session may write: ``spark.checkpoint.dir``, or on one machine the warehouse, cleared up at the end."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir is not set: streams need a folder that all executors share")
    if named:
        return named
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/streams-{os.getpid()}"
    atexit.register(shutil.rmtree, folder.removeprefix("file:"), True)
    return folder


def unique() -> str:
    import uuid

    return uuid.uuid4().hex
