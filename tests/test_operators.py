"""Histograms, samplers, routing and controllers."""

import collections

import pytest
from pyspark.sql import functions as F

from evenkeel.functions import distributions as D
from evenkeel.functions import hashing as X
from evenkeel.operators import histogram as H
from evenkeel.operators import routing as R
from evenkeel.operators import samplers as S
from evenkeel.streaming import controller as C


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_draw_equals_search(spark):
    dist = D.zeta(spark, 1, 1, 50)
    edges = [(r.rank, r.hi) for r in D.cumulative(dist).orderBy("rank").collect()]
    drawn = D.draw(spark.range(500).withColumnRenamed("id", "event_id"), dist).withColumn("u", X.md5_unit(F.col("event_id"))).collect()
    assert len(drawn) == 500
    assert all(r.k == next(k for k, hi in edges if r.u <= hi) for r in drawn)


def test_validity_rejects_non_numbers(spark):
    for values, valid in (([0.5, 0.5], True), ([0.5], False), ([0.5, float("nan")], False), ([0.5, float("inf")], False), ([], False)):
        frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "key int, freq double")
        assert H.validity(frame).first().valid is valid


def test_validity_is_of_every_key(spark, tmp_path):
    """More keys than a global histogram keeps, and events without a user: as its SQL counts them."""
    import duckdb

    from evenkeel import queries

    for at, users in (("many", "i % 2600"), ("one", "CASE WHEN i % 2 = 0 THEN 7 END"), ("none", "CASE WHEN i < 0 THEN 7 END")):
        (tmp_path / at).mkdir()
        duckdb.execute(f"COPY (SELECT i AS event_id, {users} AS user_id FROM range(5200) t(i)) TO '{tmp_path}/{at}/events.parquet'")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/{at}/events.parquet'")
        row = queries.histogram_validity(spark, str(tmp_path / at)).first()
        assert [tuple(row)] == con.execute(queries.SQL["histogram_validity"]).fetchall(), at


def test_naive_sampler_is_bounded_and_exact_while_small():
    s = S.Naive(1, scale=50, size=100, compaction=30)
    for i in range(40):
        s.add(i % 7)
    assert s.counts == collections.Counter(i % 7 for i in range(40)) and s.rate == 1
    for i in range(5000):
        s.add(i)
    assert len(s.counts) <= 100 and s.backoffs > 0 and s.rate < 1


def test_drift_sampler_grows_on_its_first_boundary():
    s = S.DriftRespecting(1, take=10, soft=50, compaction=20)
    for i in range(50):
        s.add(i)
    assert s.hard == 100 and s.backoffs == 1 and len(s.counts) == 50
    other = S.DriftRespecting(2)
    other.merge_with(s)
    assert other.counts == s.counts
    with pytest.raises(TypeError):
        s.merge_with(S.Naive())


def test_lossy_counting_guarantees():
    s, exact = S.Lossy(frequency=0.05, error=0.01), collections.Counter()
    for i in range(3000):
        k = i % 10 if i % 2 else i
        s.add(k)
        exact[k] += 1
    assert all(exact[k] - s.counts.get(k, 0) <= 0.01 * 3000 for k in exact)
    assert {k for k, v in exact.items() if v >= 0.05 * 3000} <= s.frequent().keys()


def test_reset_keeps_rate_and_totals():
    s = S.Naive()
    s.add("a")
    s.reset()
    assert s.is_empty and s.passed == 1
    s.set_value({"b": 2.0})
    assert s.normalize(1) == {"b": 2.0}


def test_routing_places_rows_and_adds_no_second_exchange(spark):
    rows = spark.range(1000).select((F.col("id") % 37).alias("k"), F.lit(1.0).alias("v"))
    routed = R.route(rows, 5, X.modulo(F.col("k"), 5))
    assert routed.where(F.spark_partition_id() != F.col(R.TARGET)).isEmpty()
    grouped = routed.groupBy(R.TARGET, "k").agg(F.sum("v").alias("v"))
    assert exchanges(grouped) == 1
    found = R.skew_group_agg(rows, "k", 5, lambda k: X.modulo(k, 5), v="v")
    assert exchanges(found) == 1
    assert sorted(map(tuple, found.drop(R.TARGET).collect())) == sorted(map(tuple, rows.groupBy("k").agg(F.sum("v")).collect()))
    assert all(r[R.TARGET] == r.k % 5 for r in found.collect())


def test_null_keys_go_to_partition_0(spark):
    rows = spark.createDataFrame([(None,), (3,)], "k bigint")
    assert {r.k: r[1] for r in rows.select("k", X.modulo(F.col("k"), 5)).collect()} == {None: 0, 3: 3}


def test_salted_join_equals_join(spark):
    big = spark.range(300).select((F.col("id") % 3).alias("k"), "id")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, x string")
    assert sorted(map(tuple, R.salted_join(big, small, "k", 4).collect())) == sorted(map(tuple, big.join(small, "k").collect()))


def test_salted_join_never_broadcasts_its_copies(spark):
    """The planner takes the copies for as small as the table they are made of; every task would hold all of them."""
    big = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 50).alias("k"), "id")
    small = spark.range(1, 40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x")).unionByName(spark.createDataFrame([(1, 5), (None, 6)], "k long, x long"))
    joined = R.salted_join(big, small, "k", 4)
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, big.join(small, "k").collect()))
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


def test_stream_controller_replays_without_counting_twice(spark):
    control = C.StreamController(C.Decider(spark, 4), "k", lambda batch, i: None)
    batch = spark.range(200).select((F.col("id") % 9).alias("k"))
    control(batch, 0)
    used, version = control.seen[0], control.decider.version
    control(batch, 0)
    assert control.seen[0] is used and control.decider.version == version == 1
    assert sum(control.records[0].values()) == 200


def test_heavy_keys_of_a_join_are_spread(spark):
    left = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    right = spark.createDataFrame([(i, f"x{i}") for i in range(40)] + [(7, "again"), (None, "none")], "c int, x string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = R.skew_join(left, right, "k", "c", 8, lambda k: X.modulo(k, 8), how, heavy=[7], spread=5)
        want = left.join(right, F.col("k") == F.col("c"), how)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), how
    spread = R.skew_join(left, right, "k", "c", 8, lambda k: X.modulo(k, 8), heavy=[7])
    per = spread.where("k = 7").groupBy(F.spark_partition_id()).count().collect()
    assert len(per) == 8 and max(r[1] for r in per) < 2 * min(r[1] for r in per)
    with pytest.raises(ValueError):
        R.skew_join(left, right, "k", "c", 8, lambda k: X.modulo(k, 8), "full_outer", heavy=[7])


def test_gate_remembers_what_was_sent(spark):
    rows = [(t, s, 100 * (s + 1), 1) for t in (3, 4) for s in range(10)] + [(5, 0, 500, 0), (5, 1, 510, 2)]
    got = H.throughput_gate(spark.createDataFrame(rows, "task_id int, seq int, records_passed long, width int"), 125)
    assert sorted((r.task_id, r.seq, r.delta) for r in got.collect()) == [(t, s, 200) for t in (3, 4) for s in (1, 3, 5, 7, 9)] + [(5, 1, 510)]


def test_drift_has_no_global_window_and_equals_the_loop(spark):
    import random

    r = random.Random(4)
    for take, width in ((5, 40), (12, 30), (10, 200)):
        now = {k: 1 + 30 * r.random() for k in r.sample(range(width + 20), width)}
        past = {k: 1 + 30 * r.random() for k in r.sample(range(width + 20), width)}
        frames = [spark.createDataFrame(list(x.items()), "key int, value double").repartition(3) for x in (now, past)]
        row = H.concept_drift(*frames, take).first()
        ranked = sorted(now.items(), key=lambda x: (-x[1], x[0]))
        place = {k: i for i, (k, _) in enumerate(ranked)}
        least = min(v for _, v in ranked[:take])
        lost = [k for k, _ in sorted(past.items(), key=lambda x: (-x[1], x[0]))[:take] if place.get(k, len(now)) >= take]
        assert row.width == len(now) and row.min_top == least and row.lost == len(lost)
        assert row.current == pytest.approx(sum(place.get(k, len(now)) - take + least - now.get(k, 0.0) for k in lost))
        if 2 * take <= width:
            assert row.drift == pytest.approx(C.drift(now, past, take))


def test_a_file_of_many_splits_is_numbered_in_order(spark, tmp_path):
    from evenkeel.sources import simulator

    n = 5000
    (tmp_path / "keys.txt").write_text("".join(f"({i},X)\n" if i % 7 else f"({i},X)\nnone\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = simulator.read(spark, str(tmp_path / "keys.txt"), 300)
        assert spark.read.text(str(tmp_path / "keys.txt")).rdd.getNumPartitions() > 5
        assert {r.key: r.batch for r in got.collect()} == {i: i // 300 for i in range(n)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_random_draws_follow_the_distribution(spark):
    dist = D.zeta(spark, 1, 1, 20)
    drawn = {r.k: r[1] / 4000 for r in D.sample(spark, dist, 4000, 3).groupBy("k").count().collect()}
    assert all(abs(drawn.get(r.rank, 0) - r.p) < 0.03 for r in dist.collect())
    assert [D.get(dist, k).first().p for k in (1, 21)] == [dist.where("rank = 1").first().p, None]


def test_naive_sampler_by_a_plain_loop(spark):
    """Through Spark, two tasks: counts, decay at the boundaries and cuts, step by step."""
    import random

    keys = [(t, f"k{random.Random(t).randint(0, 9) if i % 3 else i}") for t in (0, 1) for i in range(300)]
    got = S.sample(spark.createDataFrame(keys, "t int, k string").coalesce(1), "k", lambda seed: S.Naive(seed, scale=40, size=60, compaction=25), "t")
    for t in (0, 1):
        draw, counts, rate, bound, factor, passed = random.Random(t), {}, 1.0, 40, 0.0, 0
        for own, k in keys:
            if own != t:
                continue
            passed += 1
            if rate < 1 and draw.random() > rate:
                continue
            factor += 1
            counts[k] = counts.get(k, 0.0) + 1
            if len(counts) >= bound:
                rate, bound, factor = rate / 1.05, bound + 40, factor / 1.05
                counts = {x: v / 1.05 for x, v in counts.items()}
            if len(counts) > 60:
                counts = dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:25])
                bound = len(counts) + 40
        rows = [r for r in got.collect() if r.task_id == t]
        assert {r.key: r.value for r in rows} == pytest.approx(counts) and {(r.records_passed, r.width) for r in rows} == {(passed, len(counts))}
        assert rows[0].normalization_factor == pytest.approx(factor) and rows[0].sample_rate == pytest.approx(rate)


@pytest.mark.parametrize("make", [lambda seed: S.Naive(seed, scale=40, size=60, compaction=25), lambda seed: S.DriftRespecting(seed, take=10, soft=50, compaction=20)])
def test_samplers_share_a_partition_and_hold_no_rows(spark, make):
    """Nothing is sorted by task; tasks that come mixed, over many batches, are sampled as if each were alone."""
    rows = [(i % 3, f"k{i * i % 99991 % 500}") for i in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = S.sample(spark.createDataFrame(rows, "t int, k string").coalesce(1), "k", make, "t")
        assert "Sort" not in got._jdf.queryExecution().executedPlan().toString()
        found = got.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for t in range(3):
        alone = make(t)
        for own, k in rows:
            if own == t:
                alone.add(k)
        assert alone.backoffs > 0
        assert {r.key: (r.value, r.records_passed, r.backoffs) for r in found if r.task_id == t} == {k: (v, 1000, alone.backoffs) for k, v in alone.counts.items()}


@pytest.mark.parametrize("strategy", ["kip", "scan"])
def test_stream_controller_restarts_where_it_was(spark, tmp_path, strategy):
    worked = []
    state = f"file://{tmp_path}/state"

    def start():
        return C.StreamController(C.Decider(spark, 4, C.Settings(strategy=strategy)), "k", lambda batch, i: worked.append(sorted((r.k, r.target_partition) for r in batch.distinct().collect())), state=state, keep=2)

    one = start()
    batches = [spark.range(200).select((F.col("id") % (9 + b)).alias("k")) for b in range(3)]
    for b, batch in enumerate(batches):
        one(batch, b)
    two = start()
    assert (two.decider.version, two.blended, two.decider.trace) == (3, one.blended, one.decider.trace) and set(two.seen) == {1, 2}
    two(batches[2], 2)
    assert worked[3] == worked[2] and two.decider.version == 3 and len(two.drifts) == 2
    assert [v for v, _ in two.decider.history] == [0, 1, 2]
    keys = spark.range(50)
    assert keys.where(two.decider.partitioner.target(F.col("id")) != one.decider.partitioner.target(F.col("id"))).isEmpty()
    two(batches[0], 3)
    assert two.decider.version == 4


def test_stages_of_a_stream_have_controllers_of_their_own(spark):
    stages = C.StreamState(spark, 4)
    a = stages.stage("a", "k", lambda batch, i: None)
    assert stages.stage("a", "k", lambda batch, i: None) is a and stages.stage("b", "k", lambda batch, i: None) is not a


def test_decider_asks_for_the_slots(spark):
    d = C.Decider(spark, 4, total_slots=lambda: 6)
    assert d.decide([(1, 0.5), (2, 0.5)]) and d.partitioner.n == 6


def test_unknown_strategy_is_an_error():
    with pytest.raises(ValueError):
        C.make_partitioner("other", 4)
