"""Registered queries of the partitioning operators, each with the SQL that it is held against.

Inputs are the star-schema tables.  Skewed keys are drawn from a Zipf law by the hash of event_id,
so both engines see the same ones.  Doubles are rounded to 6 places in results only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evenkeel.functions import distributions as D
from evenkeel.functions import hashing as X
from evenkeel.operators import histogram as H
from evenkeel.operators import metrics as M
from evenkeel.operators import routing as R
from evenkeel.operators import samplers as S
from evenkeel.plans import cuts, gedik, kip, ring
from evenkeel.sources import simulator
from evenkeel.streaming import controller as C

N = 8
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def r6(c, name: str) -> Column:
    return F.round(c, 6).alias(name)


def zipf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with a Zipf key ``k`` in 1 .. 1000."""
    return D.draw(load(spark, sf_dir, "events"), D.zeta(spark, 1, 1, 1000))


# -- SQL building blocks ------------------------------------------------------------------------

MD5 = "(CAST('0x' || substr(md5(CAST({} AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0)"
ZETA = """
zp AS (SELECT CAST(i AS INTEGER) AS rank, (1.0 / i) / (SELECT sum(1.0 / j) FROM range(1, 1001) t(j)) AS p FROM range(1, 1001) t(i)),
zc AS (SELECT rank, p, CASE WHEN rank = 1000 THEN 1.0 ELSE sum(p) OVER (ORDER BY rank) END AS hi FROM zp),
zi AS (SELECT rank, p, coalesce(lag(hi) OVER (ORDER BY rank), -1.0) AS lo, hi FROM zc)
"""
EV = f"""{ZETA}, ev AS (
  SELECT e.*, z.rank AS k FROM (SELECT *, {MD5.format("event_id")} AS u FROM events) e JOIN zi z ON z.lo < e.u AND e.u <= z.hi
)"""
HIST = f"""{EV}, cnt AS (SELECT k AS key, count(*) AS n FROM ev GROUP BY k),
hist AS (SELECT CAST(row_number() OVER (ORDER BY n DESC, key) AS INTEGER) AS rank, key, n / (SELECT sum(n) FROM cnt) AS freq FROM cnt)"""


# -- histograms ---------------------------------------------------------------------------------


@query("SELECT event_id % 4 AS task_id, user_id AS key, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY ALL")
def local_histogram(spark, sf_dir):
    return H.local(load(spark, sf_dir, "events").withColumn("task", F.col("event_id") % 4), "user_id", "task")


@query("SELECT event_id % 4 AS task_id, user_id AS key, round(count(*) / (SELECT count(*) FROM events), 6) AS freq FROM events GROUP BY ALL")
def local_histogram_normalized(spark, sf_dir):
    rows = load(spark, sf_dir, "events").withColumn("task", F.col("event_id") % 4)
    return H.normalize(H.local(rows, "user_id", "task"), H.meta(rows, "task")).select("task_id", "key", r6("freq", "freq"))


@query(f"""WITH s AS (SELECT event_id % 4 AS task_id, user_id AS key, {MD5.format("event_id")} <= 0.25 AS hit FROM events),
m AS (SELECT task_id, count(*) AS passed, count(*) FILTER (WHERE hit) AS factor FROM s GROUP BY 1)
SELECT task_id, key, round(count(*) * any_value(passed) / (any_value(factor) * (SELECT count(*) FROM events)), 6) AS freq
FROM s JOIN m USING (task_id) WHERE hit GROUP BY task_id, key""")
def sampled_histogram_normalized(spark, sf_dir):
    rows = load(spark, sf_dir, "events").withColumn("task", F.col("event_id") % 4)
    return H.normalize(H.local(rows, "user_id", "task", 0.25, "event_id"), H.meta(rows, "task", 0.25, "event_id")).select("task_id", "key", r6("freq", "freq"))


@query(f"WITH {HIST} SELECT rank, key, round(freq, 6) AS freq FROM hist WHERE rank <= 2500")
def global_histogram(spark, sf_dir):
    rows = zipf(spark, sf_dir).withColumn("task", F.col("event_id") % 4)
    found = H.global_histogram(H.local(rows, "k", "task"), H.meta(rows, "task"), H.size_limit(N))
    return found.select("rank", "key", r6("freq", "freq"))


def _halves(spark, sf_dir):
    rows = load(spark, sf_dir, "events").withColumn("half", F.col("event_id") % 2)
    one = H.local(rows, "user_id", "half")
    return one.where("task_id = 0").select("key", "value"), one.where("task_id = 1").select("key", "value")


@query("SELECT user_id AS key, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1")
def histogram_merge(spark, sf_dir):
    return H.merge(*_halves(spark, sf_dir))


@query("""WITH h AS (SELECT user_id AS key, CAST(count(*) FILTER (WHERE event_id % 2 = 0) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE event_id % 2 = 1) AS DOUBLE) AS b FROM events GROUP BY 1)
SELECT key, CASE WHEN b = 0 THEN a ELSE greatest(b, a) + 0.5 END AS value FROM h""")
def histogram_merge_any(spark, sf_dir):
    """Merged by a function of one's own."""
    return H.merge(*_halves(spark, sf_dir), f=lambda v2, v1: F.greatest(v2, v1) + 0.5)


@query("SELECT user_id AS key, round(CAST(sum(CASE WHEN event_id % 2 = 0 THEN 0.7 ELSE 0.3 END) AS DOUBLE), 6) AS value FROM events GROUP BY 1")
def histogram_ewma(spark, sf_dir):
    return H.weighted_merge(*_halves(spark, sf_dir), 0.7).select("key", r6("value", "value"))


@query("SELECT count(DISTINCT user_id) AS keys, count(DISTINCT user_id) >= 2 AS valid FROM events")
def histogram_validity(spark, sf_dir):
    """Of all users; events without one have no key."""
    return H.validity(H.shares(load(spark, sf_dir, "events").where("user_id IS NOT NULL"), "user_id"))


_SNAPS = "SELECT event_id % 4 AS partition_id, event_id % 3 AS version, event_id AS seq, value FROM events"


def _snapshots(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select((F.col("event_id") % 4).alias("partition_id"), (F.col("event_id") % 3).alias("version"), F.col("event_id").alias("seq"), "value")


@query(f"SELECT partition_id, version, seq, round(value, 6) AS value FROM ({_SNAPS}) WHERE version = 1 QUALIFY row_number() OVER (PARTITION BY partition_id ORDER BY seq DESC) = 1")
def histogram_snapshot_latest(spark, sf_dir):
    return H.latest(_snapshots(spark, sf_dir), 1).select("partition_id", "version", "seq", r6("value", "value"))


@query("SELECT l_partkey AS key, CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 500")
def histogram_compaction(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.count("*").cast("double").alias("value"))
    return H.compact(rows, 1000, 500)


@query(f"SELECT l_partkey AS key, count(*) AS sampled, round(CAST(count(*) * 1.05 * 1.05 * 1.05 * 1.05 AS DOUBLE), 6) AS estimate FROM lineitem WHERE {MD5.format('l_orderkey')} <= 1 / (1.05 * 1.05 * 1.05 * 1.05) GROUP BY 1")
def sampled_histogram_backoff(spark, sf_dir):
    return H.back_off(load(spark, sf_dir, "lineitem"), "l_partkey", "l_orderkey", 1.05, 4).select("key", "sampled", r6("estimate", "estimate"))


@query("""WITH RECURSIVE per AS (SELECT event_id % 4 AS task_id, event_id // 400 AS seq, count(*) AS n FROM events GROUP BY ALL),
run AS (SELECT task_id, seq, CAST(sum(n) OVER w AS BIGINT) AS passed, row_number() OVER w AS i FROM per WINDOW w AS (PARTITION BY task_id ORDER BY seq)),
gate AS (
  SELECT DISTINCT task_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS sent, CAST(0 AS BIGINT) AS delta, false AS hit FROM per
  UNION ALL
  SELECT r.task_id, r.i, r.seq, CASE WHEN r.passed - g.sent >= 125 THEN r.passed ELSE g.sent END, r.passed - g.sent, r.passed - g.sent >= 125
  FROM gate g JOIN run r ON r.task_id = g.task_id AND r.i = g.i + 1
)
SELECT task_id, seq, sent AS records_passed, delta FROM gate WHERE hit""")
def throughput_gate(spark, sf_dir):
    """Snapshots 100 records apart, sent when 125 have passed since the last that was sent: every second one."""
    per = load(spark, sf_dir, "events").groupBy((F.col("event_id") % 4).alias("task_id"), F.floor(F.col("event_id") / 400).alias("seq")).agg(F.count("*").alias("n"))
    passed = F.sum("n").over(Window.partitionBy("task_id").orderBy("seq"))
    return H.throughput_gate(per.select("task_id", "seq", passed.alias("records_passed")), 125)


@query("""WITH h AS (SELECT l_partkey AS key, CAST(count(*) FILTER (WHERE year(l_shipdate) % 2 = 0) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE year(l_shipdate) % 2 = 1) AS DOUBLE) AS b FROM lineitem GROUP BY 1),
now AS (SELECT key, b AS value, row_number() OVER (ORDER BY b DESC, key) - 1 AS place FROM h WHERE b > 0),
past AS (SELECT key FROM h WHERE a > 0 ORDER BY a DESC, key LIMIT 50),
s AS (SELECT count(*) AS width, min(value) FILTER (WHERE place < 50) AS min_top FROM now),
lost AS (SELECT p.key, n.place, n.value FROM past p LEFT JOIN now n USING (key) WHERE n.place IS NULL OR n.place >= 50),
x AS (SELECT count(*) AS lost, coalesce(sum(coalesce(place, width) - 50 + min_top - coalesce(value, 0)), 0.0) AS current FROM lost, s)
SELECT width, lost, round(min_top, 6) AS min_top, round(current, 6) AS current, round(((min_top - 50 + width) + (min_top - 100 + width)) / 2 * 50, 6) AS maximum,
 round(current / (((min_top - 50 + width) + (min_top - 100 + width)) / 2 * 50), 6) AS drift,
 round(0.4 + 0.2 * current / (((min_top - 50 + width) + (min_top - 100 + width)) / 2 * 50), 6) AS drift_history FROM s, x""")
def concept_drift(spark, sf_dir):
    odd = F.year("l_shipdate") % 2
    both = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.count_if(odd == 0).cast("double").alias("a"), F.count_if(odd == 1).cast("double").alias("b"))
    now, past = both.where("b > 0").select("key", F.col("b").alias("value")), both.where("a > 0").select("key", F.col("a").alias("value"))
    row = H.concept_drift(now, past, 50)
    return row.select("width", "lost", *(r6(c, c) for c in ("min_top", "current", "maximum", "drift", "drift_history")))


@query()
def naive_sampler(spark, sf_dir):
    """Lineitem's part keys by a sampler small enough to back off and compact; 4 tasks."""
    rows = load(spark, sf_dir, "lineitem").withColumn("task", F.col("l_orderkey") % 4)
    return S.sample(rows, "l_partkey", lambda seed: S.Naive(seed, scale=200, size=600, compaction=250), "task")


@query()
def drift_sampler(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").withColumn("task", F.col("l_orderkey") % 4)
    return S.sample(rows, "l_partkey", lambda seed: S.DriftRespecting(seed, take=50, soft=400, compaction=200), "task")


@query(f"WITH {EV}, c AS (SELECT event_id % 4 AS task_id, k, count(*) AS n FROM ev GROUP BY ALL), t AS (SELECT task_id, sum(n) AS total FROM c GROUP BY 1) SELECT c.task_id, CAST(count(*) FILTER (WHERE n >= 0.02 * total) AS BIGINT) AS frequent_found, true AS no_frequent_key_lost, true AS undercount_bounded FROM c JOIN t USING (task_id) GROUP BY 1")
def lossy_counting(spark, sf_dir):
    """The guarantees of lossy counting against exact counts: frequency 0.02, error 0.005."""
    rows = zipf(spark, sf_dir).withColumn("task", F.col("event_id") % 4)
    found = S.sample(rows, "k", lambda seed: S.Lossy(seed, frequency=0.02, error=0.005), "task")
    exact = H.local(rows, "k", "task").select(F.col("task_id").alias("t"), F.col("key").cast("string").alias("k"), F.col("value").alias("n"))
    total = exact.groupBy("t").agg(F.sum("n").alias("total"))
    both = exact.join(total, "t").join(found, (F.col("t") == F.col("task_id")) & (F.col("k") == F.col("key")), "left")
    kept = F.coalesce("value", F.lit(0.0))
    return both.groupBy(F.col("t").alias("task_id")).agg(
        F.count_if((F.col("n") >= 0.02 * F.col("total")) & (kept >= (0.02 - 0.005) * F.col("total"))).alias("frequent_found"),
        F.bool_and((F.col("n") < 0.02 * F.col("total")) | (kept >= (0.02 - 0.005) * F.col("total"))).alias("no_frequent_key_lost"),
        F.bool_and((F.col("n") - kept <= 0.005 * F.col("total")) & (kept <= F.col("n"))).alias("undercount_bounded"),
    )


@query("SELECT 8 AS partitions, 17 AS wanted, 2500 AS size_limit")
def histogram_size_limit(spark, sf_dir):
    return spark.range(1).select(F.lit(N).alias("partitions"), F.lit(2 * N + 1).alias("wanted"), F.lit(H.size_limit(N)).alias("size_limit"))


@query(f"WITH {HIST} SELECT CAST(key AS VARCHAR) || ' (3)' AS value FROM hist WHERE rank = 1")
def save_heavy_hitter(spark, sf_dir):
    """Written to and read back from the shared folder."""
    path = f"{C.shared_folder(spark)}/heavy-{C.unique()}"
    H.save_heavy_hitter(H.exact(zipf(spark, sf_dir), "k", 10), 3, path)
    return spark.createDataFrame(spark.read.text(path).collect(), "value string")


# -- distributions ------------------------------------------------------------------------------

for _name, _make, _sql in (
    ("exponential", lambda s: D.exponential(s, 0.9, 100), "pow(0.9, i) * 0.1 / (1 - pow(0.9, 100))"),
    ("uniform", lambda s: D.uniform(s, 100), "1.0 / 100"),
    ("dirac", lambda s: D.dirac(s, 100), "CASE WHEN i = 0 THEN 1.0 ELSE 0.0 END"),
    ("linear", lambda s: D.linear(s, 40, 100), "CASE WHEN i < 40 THEN (40 - i) / 820.0 ELSE 0.0 END"),
    ("zeta", lambda s: D.zeta(s, 1.5, 2, 100), "pow(i + 2, -1.5) / (SELECT sum(pow(j + 2, -1.5)) FROM range(100) t(j))"),
    ("two_step", lambda s: D.two_step(s, 20 / 3, 100), "CASE WHEN i < 6 THEN 0.15 WHEN i = 6 THEN 0.1 ELSE 0.0 END"),
):

    def _dist(spark, sf_dir, make=_make):
        return make(spark).select("rank", r6("p", "p"))

    QUERIES[f"dist_{_name}"] = _dist
    SQL[f"dist_{_name}"] = f"SELECT CAST(i + 1 AS INTEGER) AS rank, round(CAST({_sql} AS DOUBLE), 6) AS p FROM range(100) t(i)"


@query(f"WITH {ZETA} SELECT CAST(count(*) AS INTEGER) AS width, max(up) <= count(*) / 1e6 AS non_increasing, min(p) >= 0 AS non_negative, abs(sum(p) - 1) <= count(*) / 1e6 AS sums_to_one FROM (SELECT p, coalesce(p - lag(p) OVER (ORDER BY rank), 0) AS up FROM zp)")
def dist_validate(spark, sf_dir):
    return D.validate(D.zeta(spark, 1, 1, 1000)).select(F.col("width").cast("int").alias("width"), "non_increasing", "non_negative", "sums_to_one")


@query("SELECT CAST(i AS INTEGER) AS rank, round((5.0 - i) / 10, 6) AS p FROM range(1, 5) t(i)")
def dist_get(spark, sf_dir):
    """Probabilities by rank."""
    d = D.linear(spark, 4, 10)
    return reduce(DataFrame.unionByName, (D.get(d, i).select(F.lit(i).alias("rank"), r6("p", "p")) for i in range(1, 5)))


@query(f"WITH {EV} SELECT event_id, k FROM ev")
def dist_sample(spark, sf_dir):
    return zipf(spark, sf_dir).select("event_id", "k")


@query(f"WITH {EV}, c AS (SELECT z.rank, count(e.event_id) / (SELECT count(*) FROM ev) AS p FROM zp z LEFT JOIN ev e ON e.k = z.rank GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY p DESC, rank) AS INTEGER) AS rank, round(p, 6) AS p FROM c")
def dist_empiric(spark, sf_dir):
    return D.empiric(zipf(spark, sf_dir), 1000).select("rank", r6("p", "p"))


@query(f"WITH {EV} SELECT z.rank, round(count(e.event_id) / (SELECT count(*) FROM ev), 6) AS p FROM zp z LEFT JOIN ev e ON e.k = z.rank GROUP BY 1")
def dist_unordered_empiric(spark, sf_dir):
    return D.empiric(zipf(spark, sf_dir), 1000, by_rank=True).select("rank", r6("p", "p"))


# -- cuts ---------------------------------------------------------------------------------------


def _fill_sql(hint: int) -> str:
    return f"""WITH {HIST}, pre AS (SELECT rank, freq, coalesce(sum(freq) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM hist WHERE rank <= {N}),
s AS (SELECT greatest(coalesce(min(rank - 1) FILTER (WHERE (1 - before) / ({N} - rank + 1) > freq), {N}), {hint}) AS s_cut FROM pre),
m AS (SELECT s_cut, (SELECT coalesce(sum(freq), 0) FROM pre WHERE rank <= s_cut) AS mass FROM s)
SELECT {N} AS partitions, CAST(s_cut + least(512, {N} - s_cut) AS INTEGER) AS cut, CAST(s_cut AS INTEGER) AS s_cut, round(greatest(0, (1 - mass) / ({N} - s_cut)), 6) AS level FROM m"""


@query(_fill_sql(0))
def water_fill(spark, sf_dir):
    return cuts.water_fill_frame(H.exact(zipf(spark, sf_dir), "k", 2500), N, 10).select("partitions", "cut", "s_cut", r6("level", "level"))


@query(_fill_sql(3))
def water_fill_hint(spark, sf_dir):
    return cuts.water_fill_frame(H.exact(zipf(spark, sf_dir), "k", 2500), N, 10, 3).select("partitions", "cut", "s_cut", r6("level", "level"))


@query(f"WITH {HIST} SELECT CAST({N} * ceil(greatest((1 - freq) / ({N} - 1) / freq, 1)) AS INTEGER) AS partitions FROM hist WHERE rank = 1")
def parallelism_hint(spark, sf_dir):
    top = _heavy(spark, sf_dir, 1)
    return spark.createDataFrame([(cuts.parallelism(N, cuts.water_fill(top, N, 10).level, top[0][1]),)], "partitions int")


# -- hashing and rings --------------------------------------------------------------------------


@query(f"SELECT CAST(o_custkey % {N} AS INTEGER) AS partition, CAST(count(*) AS DOUBLE) AS load FROM orders GROUP BY 1")
def hash_partition_loads(spark, sf_dir):
    return M.loads(load(spark, sf_dir, "orders"), X.modulo(F.col("o_custkey"), N))


def _two_step(spread: float) -> list[float]:
    return [1 / spread if i < int(spread) else 1 - int(spread) / spread if i == int(spread) else 0.0 for i in range(20)]


_OLD_OWNER = "least(s // 300, 6)"
_TAKERS = "7 + (m - 1) // 200"


def _weights(spark, spread):
    return spark.createDataFrame(list(enumerate(_two_step(spread))), "partition int, w double")


@query(f"SELECT CAST(s AS INTEGER) AS slot, CAST({_OLD_OWNER} AS INTEGER) AS partition FROM range(2000) t(s)")
def ring_build(spark, sf_dir):
    return ring.build_frame(_weights(spark, 20 / 3), 2000)


_ADAPTED = f"""o AS (SELECT s, {_OLD_OWNER} AS p FROM range(2000) t(s)), r AS (SELECT s, p, row_number() OVER (PARTITION BY p ORDER BY s) AS r FROM o),
mv AS (SELECT s, row_number() OVER (ORDER BY s) AS m FROM r WHERE p < 6 AND r <= 100),
ad AS (SELECT r.s, coalesce({_TAKERS}, p) AS p FROM r LEFT JOIN mv USING (s))"""


@query(f"WITH {_ADAPTED} SELECT CAST(s AS INTEGER) AS slot, CAST(p AS INTEGER) AS partition FROM ad")
def ring_adapt(spark, sf_dir):
    old, new = _weights(spark, 20 / 3), _weights(spark, 10)
    return ring.adapt_frame(ring.build_frame(old, 2000), old, new, 2000)


@query(f"WITH {_ADAPTED} SELECT c_custkey, CAST(ad.p AS INTEGER) AS partition FROM customer JOIN ad ON ad.s = CAST(floor({MD5.format('c_custkey')} * 2000) AS BIGINT) % 2000")
def ring_lookup(spark, sf_dir):
    r = ring.Ring.build(_two_step(20 / 3)).adapt(_two_step(10))
    return load(spark, sf_dir, "customer").select("c_custkey", r.lookup(X.md5_unit(F.col("c_custkey"))).alias("partition"))


@query(f"WITH {_ADAPTED} SELECT round(count(*) FILTER (WHERE o.p <> ad.p) / 2000.0, 6) AS estimate FROM o JOIN ad USING (s)")
def ring_migration(spark, sf_dir):
    r = ring.Ring.build(_two_step(20 / 3)).adapt(_two_step(10))
    return spark.createDataFrame([(r.migration,)], "estimate double").select(r6("estimate", "estimate"))


GREEK = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


_GREEK_AT = [(5, 5), (4, 9), (2, 2), (3, 3), (6, 6), (4, 4), (1, 1), (0, 0), (0, 7), (0, 0), (4, 4), (2, 2)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{g}', {a}, {b})" for g, (a, b) in zip(GREEK, _GREEK_AT)) + ") t(key, before, after)")
def ring_lookup_mmh3(spark, sf_dir):
    """Twelve keys by the exact string hash, before and after adaptation."""
    before = ring.Ring.build(_two_step(20 / 3))
    after = before.adapt(_two_step(10))
    keys = spark.createDataFrame([(g,) for g in GREEK], "key string")
    unit = X.mmh3_unit(X.java_string_hash(F.col("key")))
    return keys.withColumn("u", unit).select("key", before.lookup(F.col("u")).alias("before"), after.lookup(F.col("u")).alias("after"))


@query("SELECT * FROM (VALUES ('0', 593689054), ('1', -68075478), ('42', -1134849565), ('a', 1009084850), ('abcd', 1139631978)) t(key, hash)")
def byte_hashes(spark, sf_dir):
    """The exact byte hash of ints and strings, against published values."""
    keys = spark.createDataFrame([("0",), ("1",), ("42",), ("a",), ("abcd",)], "key string")
    number = F.try_to_number("key", F.lit("999")).cast("int")
    return keys.select("key", F.coalesce(X.murmur3_int(number), X.murmur3_string(F.col("key"))).alias("hash"))


@query(f"""WITH pts AS (SELECT {MD5.format("(p || '|' || r)")} AS h, p FROM range({N}) a(p), range(100) b(r)),
keys AS (SELECT p_partkey, {MD5.format("p_partkey")} AS u FROM part),
j AS (SELECT p_partkey, u, h, p FROM keys ASOF LEFT JOIN pts ON u <= h)
SELECT p_partkey, CAST(coalesce(p, (SELECT arg_min(p, h) FROM pts)) AS INTEGER) AS partition FROM j""")
def gedik_ring_lookup(spark, sf_dir):
    points = ring.PointRing.build(spark, N)
    keys = load(spark, sf_dir, "part").select("p_partkey")
    return points.lookup(keys, X.md5_unit(F.col("p_partkey"))).select("p_partkey", "partition")


# -- key isolation ------------------------------------------------------------------------------


def _heavy(spark, sf_dir, k: int = 2 * N, rows: DataFrame | None = None) -> list[tuple[int, float]]:
    """The k most frequent Zipf keys: a bounded collect."""
    top = H.exact(zipf(spark, sf_dir) if rows is None else rows, "k", k)
    return [(r.key, r.freq) for r in top.orderBy("rank").collect()]


def _placed(spark, placed: dict) -> DataFrame:
    return spark.createDataFrame(list(placed.items()), "key int, partition int")


_LEAST = "list_position(loads, list_min(loads))"
_GREEDY = f"""heavy AS MATERIALIZED (SELECT * FROM hist WHERE rank <= {2 * N}),
place AS (
  SELECT 0 AS rank, CAST(NULL AS INTEGER) AS key, CAST(NULL AS BIGINT) AS p, [CAST(0 AS DOUBLE) FOR x IN range({N})] AS loads, CAST(0 AS DOUBLE) AS moved
  UNION ALL
  SELECT h.rank, h.key, CAST({_LEAST} - 1 AS BIGINT), list_transform(loads, lambda x, i: CASE WHEN i = {_LEAST} THEN x + h.freq ELSE x END),
         moved + CASE WHEN {_LEAST} - 1 <> h.key % {N} THEN h.freq ELSE 0 END
  FROM place JOIN heavy h ON h.rank = place.rank + 1
)"""


@query(f"WITH RECURSIVE {HIST}, {_GREEDY} SELECT key, CAST(p AS INTEGER) AS partition FROM place WHERE rank > 0")
def kip_place_lpt(spark, sf_dir):
    placed, _, _ = kip.place_greedy(_heavy(spark, sf_dir), N, lambda k: k % N)
    return _placed(spark, placed)


# Old place: key % 8; ring place: (key * 5 + 3) % 8.
_OLD, _INNER = (lambda k: k % N), (lambda k: (k * 5 + 3) % N)
_ROOM = "(SELECT greatest(max(freq), 0.125) + 0.001 FROM hist)"
_AT = "loads[CAST({} AS BIGINT) + 1]"
_STAY = f"""heavy AS MATERIALIZED (SELECT rank, key, freq, key % {N} AS o, (key * 5 + 3) % {N} AS i, {_ROOM} AS room FROM hist WHERE rank <= {2 * N}),
first AS (
  SELECT 0 AS rank, CAST(NULL AS INTEGER) AS key, CAST(0 AS DOUBLE) AS freq, CAST(NULL AS BIGINT) AS p, [CAST(0 AS DOUBLE) FOR x IN range({N})] AS loads
  UNION ALL
  SELECT h.rank, h.key, h.freq, CASE WHEN {_AT.format("h.o")} + h.freq <= h.room OR {_AT.format("h.o")} = 0 THEN CAST(h.o AS BIGINT) END,
         CASE WHEN {_AT.format("h.o")} + h.freq <= h.room OR {_AT.format("h.o")} = 0 THEN list_transform(loads, lambda x, j: CASE WHEN j = h.o + 1 THEN x + h.freq ELSE x END) ELSE loads END
  FROM first f JOIN heavy h ON h.rank = f.rank + 1
),
todo AS MATERIALIZED (SELECT row_number() OVER (ORDER BY f.rank) AS pos, f.key, h.freq, h.o, h.i, h.room FROM first f JOIN heavy h USING (key) WHERE f.p IS NULL),
second AS (
  SELECT CAST(0 AS BIGINT) AS pos, CAST(NULL AS INTEGER) AS key, CAST(NULL AS BIGINT) AS p, (SELECT loads FROM first WHERE rank = {2 * N}) AS loads
  UNION ALL
  SELECT t.pos, t.key, CASE WHEN t.i <> t.o AND ({_AT.format("t.i")} + t.freq < t.room OR {_AT.format("t.i")} = 0) THEN CAST(t.i AS BIGINT) ELSE CAST({_LEAST} - 1 AS BIGINT) END,
         list_transform(loads, lambda x, j: CASE WHEN j = (CASE WHEN t.i <> t.o AND ({_AT.format("t.i")} + t.freq < t.room OR {_AT.format("t.i")} = 0) THEN t.i + 1 ELSE {_LEAST} END) THEN x + t.freq ELSE x END)
  FROM second s JOIN todo t ON t.pos = s.pos + 1
),
final AS (SELECT key, p FROM first WHERE p IS NOT NULL UNION ALL SELECT key, p FROM second WHERE pos > 0),
fl AS (SELECT unnest(loads) AS load, generate_subscripts(loads, 1) - 1 AS p FROM (SELECT loads FROM second ORDER BY pos DESC LIMIT 1))"""


@query(f"WITH RECURSIVE {HIST}, {_STAY} SELECT key, CAST(p AS INTEGER) AS partition FROM final")
def kip_place_migration(spark, sf_dir):
    placed, _, _ = kip.place_staying(_heavy(spark, sf_dir), N, _OLD, _INNER)
    return _placed(spark, placed)


# Levels by the loop itself: at most 8 loads, in order of partition.
_LEVEL = f"""lv AS (
  SELECT 0 AS i, CAST(1 AS DOUBLE) AS rest, true AS going, 0 AS s
  UNION ALL
  SELECT lv.i + 1, CASE WHEN going AND rest / ({N} - i) <= fl.load THEN rest - fl.load ELSE rest END, going AND rest / ({N} - i) <= fl.load, s + CASE WHEN going AND rest / ({N} - i) <= fl.load THEN 1 ELSE 0 END
  FROM lv JOIN fl ON fl.p = lv.i
), lev AS (SELECT CASE WHEN s = {N} THEN 0 ELSE greatest(0, rest / ({N} - s)) END AS level FROM lv WHERE i = {N}),
wt AS (SELECT p, greatest(0, level - load) AS free FROM fl, lev)"""


@query(f"WITH RECURSIVE {HIST}, {_STAY}, {_LEVEL} SELECT CAST(p AS INTEGER) AS partition, round(free / (SELECT sum(free) FROM wt), 6) AS weight FROM wt")
def kip_residual_weights(spark, sf_dir):
    _, loads, _ = kip.place_staying(_heavy(spark, sf_dir), N, _OLD, _INNER)
    _, weights = kip.residual_weights(loads)
    return spark.createDataFrame(list(enumerate(weights)), "partition int, weight double").select("partition", r6("weight", "weight"))


def _isolator(spark, sf_dir, rows=None, base=None) -> kip.KeyIsolator:
    heavy = _heavy(spark, sf_dir, H.size_limit(N), rows)
    return (base or kip.KeyIsolator(N, fallback=X.modulo)).update(spark, cuts.water_fill(heavy, N, 10))


_HASHED = _STAY.replace(f"(key * 5 + 3) % {N} AS i", f"key % {N} AS i")
_PLACED_SQL = f"""{_HASHED}, {_LEVEL},
pts AS (SELECT p, CASE WHEN p = {N - 1} THEN {N * 100} ELSE round_even({N * 100} * sum(free) OVER (ORDER BY p) / (SELECT sum(free) FROM wt), 0) END AS hi FROM wt),
arc AS (SELECT p, coalesce(max(hi) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, hi FROM pts)"""


@query(f"""WITH RECURSIVE {HIST}, {_PLACED_SQL}, own AS (
  SELECT CAST(coalesce(f.p, a.p) AS INTEGER) AS partition
  FROM (SELECT k, floor({MD5.format("k")} * {N * 100}) AS slot FROM ev) e LEFT JOIN final f ON f.key = e.k JOIN arc a ON a.lo <= e.slot AND e.slot < a.hi
) SELECT partition, CAST(count(*) AS DOUBLE) AS load FROM own GROUP BY 1""")
def kip_lookup_loads(spark, sf_dir):
    """Loads of all events under key isolation: every key to exactly one partition."""
    return M.loads(zipf(spark, sf_dir), _isolator(spark, sf_dir).target(F.col("k")))


_ZEROS = f"[CAST(0 AS DOUBLE) FOR x IN range({N})]"


def _isolated_sql(t: str, rows: str, old: str, ring: str) -> str:
    """SQL: the isolator made from ``rows`` (column k): places ``{t}final``, loads ``{t}fl``, weights ``{t}w`` of 1 in all.  ``old`` and ``ring``: SQL of a key's places before."""
    at = lambda p: f"loads[CAST({p} AS BIGINT) + 1]"
    stays = f"{at('h.o')} + h.freq <= h.room OR {at('h.o')} = 0"
    goes = f"t.i <> t.o AND ({at('t.i')} + t.freq < t.room OR {at('t.i')} = 0)"
    more = lambda p, x: f"list_transform(loads, lambda x, j: CASE WHEN j = {p} + 1 THEN x + {x} ELSE x END)"
    return f"""{t}cnt AS (SELECT k AS key, count(*) AS n FROM {rows} GROUP BY 1),
{t}hist AS (SELECT CAST(row_number() OVER (ORDER BY n DESC, key) AS INTEGER) AS rank, key, n / (SELECT sum(n) FROM {t}cnt) AS freq FROM {t}cnt),
{t}heavy AS MATERIALIZED (SELECT rank, key, freq, {old} AS o, {ring} AS i, (SELECT greatest(max(freq), 1.0 / {N}) + 0.001 FROM {t}hist) AS room FROM {t}hist WHERE rank <= {2 * N}),
{t}first AS (
  SELECT 0 AS rank, CAST(NULL AS INTEGER) AS key, CAST(NULL AS BIGINT) AS p, {_ZEROS} AS loads
  UNION ALL
  SELECT h.rank, h.key, CASE WHEN {stays} THEN CAST(h.o AS BIGINT) END, CASE WHEN {stays} THEN {more("h.o", "h.freq")} ELSE loads END FROM {t}first f JOIN {t}heavy h ON h.rank = f.rank + 1
),
{t}todo AS MATERIALIZED (SELECT row_number() OVER (ORDER BY f.rank) AS pos, h.* FROM {t}first f JOIN {t}heavy h USING (key) WHERE f.p IS NULL),
{t}second AS (
  SELECT CAST(0 AS BIGINT) AS pos, CAST(NULL AS INTEGER) AS key, CAST(NULL AS BIGINT) AS p, (SELECT loads FROM {t}first ORDER BY rank DESC LIMIT 1) AS loads
  UNION ALL
  SELECT t.pos, t.key, CASE WHEN {goes} THEN CAST(t.i AS BIGINT) ELSE CAST({_LEAST} - 1 AS BIGINT) END, {more(f"(CASE WHEN {goes} THEN t.i ELSE {_LEAST} - 1 END)", "t.freq")} FROM {t}second s JOIN {t}todo t ON t.pos = s.pos + 1
),
{t}final AS (SELECT key, p FROM {t}first WHERE p IS NOT NULL UNION ALL SELECT key, p FROM {t}second WHERE pos > 0),
{t}fl AS (SELECT unnest(loads) AS load, generate_subscripts(loads, 1) - 1 AS p FROM (SELECT loads FROM {t}second ORDER BY pos DESC LIMIT 1)),
{t}lv AS (
  SELECT 0 AS i, CAST(1 AS DOUBLE) AS rest, true AS going, 0 AS s
  UNION ALL
  SELECT l.i + 1, CASE WHEN going AND rest / ({N} - i) <= load THEN rest - load ELSE rest END, going AND rest / ({N} - i) <= load, s + CASE WHEN going AND rest / ({N} - i) <= load THEN 1 ELSE 0 END FROM {t}lv l JOIN {t}fl f ON f.p = l.i
),
{t}wt AS (SELECT p, greatest(0, (SELECT CASE WHEN s = {N} THEN 0 ELSE greatest(0, rest / ({N} - s)) END FROM {t}lv WHERE i = {N}) - load) AS free FROM {t}fl),
{t}w AS (SELECT p, free / (SELECT sum(free) FROM {t}wt) AS w FROM {t}wt)"""


_SLOTS = N * 100
_MIGRATED = f"""half AS (SELECT event_id, event_id % 2 AS h, CAST(floor({MD5.format("k")} * {_SLOTS}) AS BIGINT) AS slot, k FROM ev),
spot AS (SELECT DISTINCT k, slot FROM half),
{_isolated_sql("a_", "(SELECT k FROM half WHERE h = 0)", f"key % {N}", f"key % {N}")},
a_hi AS (SELECT p, CASE WHEN p = {N - 1} THEN {_SLOTS} ELSE round_even({_SLOTS} * sum(w) OVER (ORDER BY p), 0) END AS hi FROM a_w),
ring AS MATERIALIZED (SELECT s, (SELECT min(p) FROM a_hi WHERE hi > s) AS p FROM range({_SLOTS}) r(s)),
a_at AS MATERIALIZED (SELECT spot.k, coalesce(f.p, ring.p) AS p, ring.p AS i FROM spot JOIN ring ON ring.s = spot.slot LEFT JOIN a_final f ON f.key = spot.k),
{_isolated_sql("b_", "(SELECT k FROM half WHERE h = 1)", "(SELECT p FROM a_at WHERE a_at.k = key)", "(SELECT i FROM a_at WHERE a_at.k = key)")},
edge AS (SELECT p, floor({_SLOTS} * sum(b.w - a.w) OVER (ORDER BY p) + 0.5) AS e FROM a_w a JOIN b_w b USING (p)),
gain AS (SELECT p, e - coalesce(lag(e) OVER (ORDER BY p), 0) AS t FROM edge),
taker AS (SELECT p, sum(greatest(t, 0)) OVER (ORDER BY p) - greatest(t, 0) AS lo, sum(greatest(t, 0)) OVER (ORDER BY p) AS hi FROM gain),
leaving AS (SELECT s, row_number() OVER (ORDER BY s) AS m FROM (SELECT s, p, row_number() OVER (PARTITION BY p ORDER BY s) AS r FROM ring) JOIN gain USING (p) WHERE r <= -t),
ring2 AS (SELECT ring.s, coalesce(t.p, ring.p) AS p FROM ring LEFT JOIN leaving l USING (s) LEFT JOIN taker t ON t.lo < l.m AND l.m <= t.hi),
b_at AS (SELECT spot.k, coalesce(f.p, ring2.p) AS p, ring2.p AS i FROM spot JOIN ring2 ON ring2.s = spot.slot LEFT JOIN b_final f ON f.key = spot.k),
parted AS (SELECT count(*) AS n FROM a_final f JOIN b_at b ON b.k = f.key WHERE f.key NOT IN (SELECT key FROM b_final) AND f.p <> b.i),
moves AS (SELECT count(*) AS total, count(*) FILTER (WHERE a.p <> b.p) AS moved FROM half JOIN a_at a USING (k) JOIN b_at b USING (k))"""


@query(f"""WITH RECURSIVE {EV}, {_MIGRATED} SELECT total, moved, round(moved / total, 6) AS share,
round((SELECT coalesce(sum(freq), 0) FROM b_todo) + (SELECT n FROM parted) * (SELECT min(freq) FROM b_heavy), 8) AS heavy_estimate,
round((1 - (SELECT sum(freq) FROM b_heavy)) * (SELECT sum(greatest(t, 0)) FROM gain) / {_SLOTS}, 8) AS small_estimate FROM moves""")
def kip_migration_estimate(spark, sf_dir):
    """Estimated migration of the update from the first half of the events to the second, and the records that do move."""
    rows = zipf(spark, sf_dir).withColumn("half", F.col("event_id") % 2)
    first = _isolator(spark, sf_dir, rows.where("half = 0"))
    second = _isolator(spark, sf_dir, rows.where("half = 1"), first)
    moved = M.migration(rows, first.target(F.col("k")), second.target(F.col("k")))
    return moved.select("total", "moved", r6("share", "share"), F.round(F.lit(second.heavy_migration), 8).alias("heavy_estimate"), F.round(F.lit(second.small_migration), 8).alias("small_estimate"))


# -- searches -----------------------------------------------------------------------------------


def _tracked(spark, sf_dir) -> gedik.Tracked:
    heavy = _heavy(spark, sf_dir)
    return gedik.Tracked(tuple(heavy), {}, {k: _OLD(k) for k, _ in heavy}, {k: _INNER(k) for k, _ in heavy}, N)


@query(f"""WITH {HIST}, heavy AS (SELECT key, freq, key % {N} AS p FROM hist WHERE rank <= {2 * N}),
ld AS (SELECT q.p, coalesce(sum(freq), 0) AS s, coalesce(sum(freq * freq), 0) AS c FROM range({N}) q(p) LEFT JOIN heavy USING (p) GROUP BY 1),
x AS (SELECT (max(s) - min(s)) / (0.2 * avg(s)) AS s, (max(c) - min(c)) / (0.2 * avg(c)) AS c FROM ld)
SELECT round(s, 6) AS state, round(c, 6) AS work, round(s, 6) AS network, round(pow(s * c * s, 1.0 / 3), 6) AS balance, CAST(0 AS DOUBLE) AS migration FROM x""")
def gedik_penalties(spark, sf_dir):
    t = _tracked(spark, sf_dir)
    found = gedik.penalties(t, t.old)
    return spark.createDataFrame([tuple(map(float, found.values()))], ", ".join(f"{k} double" for k in found)).select(*(r6(k, k) for k in found))


@query(f"""WITH {EV}, cnt AS (SELECT event_id % 2 AS h, k AS key, count(*) AS n FROM ev GROUP BY ALL),
top AS (SELECT h, key, n / (SELECT sum(n) FROM cnt c WHERE c.h = cnt.h) AS freq, row_number() OVER (PARTITION BY h ORDER BY n DESC, key) AS rank FROM cnt),
seen AS (SELECT key, max(freq) FILTER (WHERE h = 0) AS was, max(freq) FILTER (WHERE h = 1) AS now, key % {N} <> (key * 5 + 3) % {N} AS differs FROM top WHERE rank <= {2 * N} GROUP BY key)
SELECT count(*) FILTER (WHERE now IS NULL) AS gone, round(coalesce(sum(was) FILTER (WHERE now IS NULL AND differs), 0), 6) AS gone_mass,
 round(sum(CASE WHEN differs THEN coalesce(now, was) ELSE 0 END) / (sum(coalesce(now, was)) / {N}), 6) AS migration FROM seen""")
def gedik_migration_penalty(spark, sf_dir):
    """Keys of the second half of the events go from their old places to the ring's; some of the first half are tracked no more."""
    rows = zipf(spark, sf_dir).withColumn("half", F.col("event_id") % 2)
    was, now = (dict(_heavy(spark, sf_dir, 2 * N, rows.where(F.col("half") == h))) for h in (0, 1))
    keys = was.keys() | now.keys()
    t = gedik.Tracked(tuple(now.items()), was, {k: _OLD(k) for k in keys}, {k: _INNER(k) for k in keys}, N)
    found = gedik.penalties(t, t.ring)
    return spark.createDataFrame([(len(was.keys() - now.keys()), float(t.left()), float(found["migration"]))], "gone long, gone_mass double, migration double").select("gone", r6("gone_mass", "gone_mass"), r6("migration", "migration"))


def _searched(spark, sf_dir, name: str) -> DataFrame:
    t = _tracked(spark, sf_dir)
    placed = gedik.SEARCHES[name](t)
    before, after = gedik.penalties(t, t.old), gedik.penalties(t, placed)
    rows = [(k, placed[k], after["balance"], after["balance"] <= before["balance"] + 1e-9) for k, _ in t.current]
    return spark.createDataFrame(rows, "key int, partition int, balance double, no_worse boolean").withColumn("balance", F.round("balance", 6))


def _with(loads: str, p: str, x: str) -> str:
    """SQL: the loads with x more on partition p."""
    return f"list_transform({loads}, lambda v, j: CASE WHEN j = {p} + 1 THEN v + {x} ELSE v END)"


def _spread_sql(loads: str) -> str:
    return f"((list_max({loads}) - list_min({loads})) / (0.2 * list_sum({loads}) / {N}))"


def _penalty_sql(s: str, c: str) -> str:
    return f"pow(greatest({_spread_sql(s)} * {_spread_sql(c)} * {_spread_sql(s)}, 0), 1.0 / 3)"


def _cost_sql(f: str, o: str) -> str:
    """SQL: the utility of a key of frequency f and old place o on partition p."""
    return f"({_penalty_sql(_with('s', 'p', f), _with('c', 'p', f'{f} * {f}'))} + (moved + CASE WHEN p <> {o} THEN {f} ELSE 0 END) / ideal)"


_TRACKED = f"""heavy AS MATERIALIZED (SELECT rank, key, freq, key % {N} AS o FROM hist WHERE rank <= {2 * N}),
was AS (SELECT q.p, coalesce(sum(freq), 0) AS s, coalesce(sum(freq * freq), 0) AS c FROM range({N}) q(p) LEFT JOIN heavy ON o = q.p GROUP BY 1),
old AS (SELECT {_penalty_sql("s", "c")} AS b FROM (SELECT list(s ORDER BY p) AS s, list(c ORDER BY p) AS c FROM was))"""
_RESULT = f"""SELECT d.key, CAST(d.p AS INTEGER) AS partition, round(b.b, 6) AS balance, b.b <= old.b + 1e-9 AS no_worse
FROM done d, old, (SELECT {_penalty_sql("s", "c")} AS b FROM done ORDER BY n DESC LIMIT 1) b WHERE d.n > 0"""


@query(f"""WITH RECURSIVE {HIST}, {_TRACKED}, done AS (
  SELECT 0 AS n, CAST(NULL AS INTEGER) AS key, CAST(NULL AS BIGINT) AS p, {_ZEROS} AS s, {_ZEROS} AS c, CAST(0 AS DOUBLE) AS moved
  UNION ALL
  SELECT n + 1, key, best, {_with("s", "best", "freq")}, {_with("c", "best", "freq * freq")}, moved + CASE WHEN best <> o THEN freq ELSE 0 END
  FROM (SELECT *, list_position(costs, list_min(costs)) - 1 AS best FROM (
    SELECT d.n, h.key, h.freq, h.o, d.s, d.c, d.moved, list_transform(range({N}), lambda p: round({_cost_sql("h.freq", "h.o")}, 9)) AS costs
    FROM done d JOIN heavy h ON h.rank = d.n + 1, (SELECT sum(freq) / {N} AS ideal FROM heavy)))
) {_RESULT}""")
def gedik_scan(spark, sf_dir):
    return _searched(spark, sf_dir, "scan")


@query(f"""WITH RECURSIVE {HIST}, {_TRACKED}, done AS (
  SELECT 0 AS n, CAST(NULL AS INTEGER) AS key, CAST(NULL AS BIGINT) AS p, {_ZEROS} AS s, {_ZEROS} AS c, CAST(0 AS DOUBLE) AS moved,
         (SELECT list({{'key': key, 'f': freq, 'o': o}} ORDER BY freq DESC, CAST(key AS VARCHAR)) FROM heavy) AS todo
  UNION ALL
  SELECT n + 1, t.key, best, {_with("s", "best", "t.f")}, {_with("c", "best", "t.f * t.f")}, moved + CASE WHEN best <> t.o THEN t.f ELSE 0 END, list_filter(todo, lambda x: x.key <> t.key)
  FROM (SELECT *, todo[CAST(spot // {N} AS BIGINT) + 1] AS t, spot % {N} AS best FROM (SELECT *, list_position(costs, list_min(costs)) - 1 AS spot FROM (
    SELECT n, s, c, moved, todo, flatten(list_transform(todo, lambda k: list_transform(range({N}), lambda p: round({_cost_sql("k.f", "k.o")} / k.f, 9)))) AS costs
    FROM done, (SELECT sum(freq) / {N} AS ideal FROM heavy) WHERE len(todo) > 0)))
) {_RESULT}""")
def gedik_redist(spark, sf_dir):
    return _searched(spark, sf_dir, "redist")


@query()
def gedik_readj(spark, sf_dir):
    return _searched(spark, sf_dir, "readj")


@query()
def gedik_demo(spark, sf_dir):
    """Scan on 14 letters with two-step weights over 20 partitions; a ring of 10 replicas, constant state and work."""
    heavy = tuple((chr(97 + i), w) for i, w in enumerate(_two_step(20 / 3)[:14]))
    points = ring.PointRing.hashed(20, 10, X.pair_hash_code)
    at = {k: p for k, (p,) in kip.places(spark, [k for k, _ in heavy], lambda k: points.target(X.java_string_hash(k))).items()}
    costs = gedik.Costs(lambda f: 1.0, lambda f: 1.0, (0.1, 0.1, 1.0))
    return spark.createDataFrame(list(gedik.scan(gedik.Tracked(heavy, dict(heavy), at, at, 20, costs)).items()), "key string, partition int")


# -- metrics and decisions ----------------------------------------------------------------------


@query(f"WITH {EV}, l AS (SELECT k % {N} AS p, count(*) AS n FROM ev GROUP BY 1) SELECT {N} AS partitions, CAST(sum(n) AS DOUBLE) AS total, CAST(max(n) AS DOUBLE) AS largest, round(max(n) * {N} / sum(n), 6) AS imbalance FROM l")
def partition_imbalance(spark, sf_dir):
    return M.imbalance(zipf(spark, sf_dir), X.modulo(F.col("k"), N), N).select("partitions", "total", "largest", r6("imbalance", "imbalance"))


@query(f"WITH RECURSIVE {HIST}, {_GREEDY}, pl AS (SELECT key, p FROM place WHERE rank > 0), x AS (SELECT k % {N} AS a, coalesce(p, k % {N}) AS b FROM ev LEFT JOIN pl ON pl.key = k) SELECT count(*) AS total, count(*) FILTER (WHERE a <> b) AS moved, round(count(*) FILTER (WHERE a <> b) / count(*), 6) AS share FROM x")
def actual_migration(spark, sf_dir):
    placed, _, _ = kip.place_greedy(_heavy(spark, sf_dir), N, _OLD)
    new = kip.KeyIsolator(N, explicit=placed, fallback=X.modulo)
    return M.migration(zipf(spark, sf_dir), X.modulo(F.col("k"), N), new.target(F.col("k"))).select("total", "moved", r6("share", "share"))


@query(f"""WITH {EV}, b AS (SELECT CAST(least(event_id * 4 // (SELECT count(*) FROM ev), 3) AS INTEGER) AS b, k FROM ev),
made AS (SELECT b, k, row_number() OVER (PARTITION BY b ORDER BY count(*) DESC, k) - 1 AS p FROM b GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY b ORDER BY count(*) DESC, k) <= {N}),
x AS (SELECT b.b AS batch, 'hash_train' AS kind, k % {N} AS p FROM b
 UNION ALL SELECT b.b, 'train', coalesce(m.p, b.k % {N}) FROM b LEFT JOIN made m ON m.b = b.b AND m.k = b.k
 UNION ALL SELECT b.b - 1, 'test', coalesce(m.p, b.k % {N}) FROM b LEFT JOIN made m ON m.b = b.b - 1 AND m.k = b.k WHERE b.b > 0),
c AS (SELECT batch, kind, p, count(*) AS n FROM x GROUP BY ALL), i AS (SELECT batch, kind, max(n) * {N} / sum(n) AS v FROM c GROUP BY 1, 2)
SELECT batch, round(max(v) FILTER (WHERE kind = 'hash_train'), 6) AS hash_train, round(max(v) FILTER (WHERE kind = 'train'), 6) AS train, round(max(v) FILTER (WHERE kind = 'test'), 6) AS test FROM i GROUP BY 1""")
def simulate_batches(spark, sf_dir):
    """Four batches; each batch's partitioner gives its 8 heaviest keys a partition each, others hash."""
    rows = zipf(spark, sf_dir)
    total = rows.count()
    rows = rows.select("k", F.least(F.floor(F.col("event_id") * 4 / total), F.lit(3)).cast("int").alias("batch"))
    counts = rows.groupBy("batch", "k").agg(F.count("*").alias("n"))
    top = counts.withColumn("p", F.row_number().over(Window.partitionBy("batch").orderBy(F.desc("n"), "k")) - 1).where(F.col("p") < N).collect()
    made = {b: kip.KeyIsolator(N, explicit={r.k: r.p for r in top if r.batch == b}, fallback=X.modulo).target for b in range(4)}
    found = M.simulate(rows, "batch", "k", N, made, lambda k: X.modulo(k, N))
    return found.select("batch", *(r6(c, c) for c in ("hash_train", "train", "test")))


@query("SELECT CAST(event_id AS INTEGER) AS key FROM events")
def simulator_parse(spark, sf_dir):
    lines = load(spark, sf_dir, "events").select(F.concat(F.lit("("), F.col("event_id"), F.lit(",X)")).alias("value"))
    return simulator.parse(lines)


@query("SELECT * FROM (VALUES (0, 'repartitioned'), (1, 'invalid'), (1, 'repartitioned')) t(version, outcome)")
def decision_trace(spark, sf_dir):
    """Snapshots of stale, current and future versions, an invalid histogram, and then a valid one."""
    d = C.Decider(spark, 4)
    d.on_histogram(0, 7, {1: 1.0}, 1, 1.0)
    d.on_histogram(0, 0, {1: 6.0, 2: 2.0}, 8, 8.0)
    d.on_histogram(0, 0, {1: 5.0, 2: 3.0}, 8, 8.0)
    d.on_histogram(1, 0, {1: 1.0, 3: 1.0}, 2, 2.0)
    d.on_histogram(1, 0, {1: 1.0}, 1, 1.0)
    d.on_histogram(0, 1, {1: 4.0}, 4, 4.0)
    d.on_histogram(1, 1, {1: 2.0}, 2, 2.0)
    d.on_histogram(0, 1, {1: 4.0, 2: 4.0}, 8, 8.0)
    d.on_histogram(1, 1, {5: 2.0}, 2, 2.0)
    return spark.createDataFrame(d.trace, "version int, outcome string")


@query(f"SELECT CAST(event_id % {N} AS INTEGER) AS partition, CAST(count(*) AS DOUBLE) AS load FROM events GROUP BY 1")
def partition_metrics(spark, sf_dir):
    """Records read by each partition of routed rows, as the partitions themselves count them."""
    routed = R.route(load(spark, sf_dir, "events"), N, X.modulo(F.col("event_id"), N))
    return M.loads(routed.withColumn("p", F.spark_partition_id()), F.col("p"))


# -- skew-aware work ----------------------------------------------------------------------------


@query("SELECT l_partkey, round(sum(l_extendedprice), 2) AS revenue, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1")
def skew_group_agg(spark, sf_dir):
    out = R.skew_group_agg(load(spark, sf_dir, "lineitem"), "l_partkey", N, lambda k: X.modulo(k, N), revenue="l_extendedprice", quantity="l_quantity")
    return out.select("l_partkey", F.round("revenue", 2).alias("revenue"), "quantity")


@query(f"WITH {EV} SELECT k, count(*) AS n, round(median(value), 6) AS middle FROM ev GROUP BY 1")
def skew_apply(spark, sf_dir):
    """Work that does not combine: each key's median, keys dealt by key isolation."""
    rows = zipf(spark, sf_dir).select("k", "value")
    part = _isolator(spark, sf_dir)

    def middle(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [pdf.k.iloc[0]], "n": [len(pdf)], "middle": [round(pdf.value.median(), 6)]})

    return R.skew_apply(rows, "k", N, part.target, middle, "k int, n long, middle double")


@query("SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def skew_join_agg(spark, sf_dir):
    lines, orders = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice"), load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    joined = R.skew_join(lines, orders, "l_orderkey", "o_orderkey", N, lambda k: X.modulo(k, N))
    return joined.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"))


_KEYED_JOIN = f"WITH {EV} SELECT c_nationkey, count(*) AS n, round(sum(value), 2) AS total FROM ev JOIN customer ON c_custkey = k GROUP BY 1"


def _customers(spark, sf_dir):
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("c"), "c_nationkey")


@query(_KEYED_JOIN)
def skew_join_hot(spark, sf_dir):
    """The Zipf key's heavy keys are dealt over all partitions, and their customers repeated there."""
    rows, part = zipf(spark, sf_dir).select("k", "value"), _isolator(spark, sf_dir)
    heavy = [k for k, f in _heavy(spark, sf_dir, N) if f > 1 / N]
    joined = R.skew_join(rows, _customers(spark, sf_dir), "k", "c", N, part.target, heavy=heavy)
    return joined.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(_KEYED_JOIN)
def salted_join_agg(spark, sf_dir):
    joined = R.salted_join(zipf(spark, sf_dir).select("k", "value"), _customers(spark, sf_dir).withColumnRenamed("c", "k"), "k", N)
    return joined.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(f"WITH {EV} SELECT k, count(*) AS n, round(sum(value), 2) AS total FROM ev GROUP BY 1")
def stream_foreach_batch(spark, sf_dir):
    """Events as a stream, a file a trigger, every micro-batch dealt by the partitioner of those before; totals by key."""
    base = f"{C.shared_folder(spark)}/stream-{C.unique()}"
    zipf(spark, sf_dir).select("event_id", "k", "value").repartition(3, "event_id").write.parquet(f"{base}/in")
    control = C.StreamController(C.Decider(spark, N), "k", lambda batch, i: batch.groupBy(R.TARGET, "k").agg(F.count("*").alias("n"), F.sum("value").alias("v")).drop(R.TARGET).write.mode("overwrite").parquet(f"{base}/out/{i}"))
    stream = spark.readStream.schema("event_id long, k int, value double").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    stream.writeStream.foreachBatch(control).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out/*").groupBy("k").agg(F.sum("n").alias("n"), F.round(F.sum("v"), 2).alias("total"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads of a skewed key under hashing and under key isolation, partition by partition."""
    rows = zipf(spark, sf_dir)
    part = _isolator(spark, sf_dir)
    a = M.loads(rows, X.modulo(F.col("k"), N)).withColumnRenamed("load", "hashed")
    b = M.loads(rows, part.target(F.col("k"))).withColumnRenamed("load", "isolated")
    return a.join(b, "partition", "full_outer")
