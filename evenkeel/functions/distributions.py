"""Non-increasing probability distributions over ranks 1 .. width, and sampling from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evenkeel.functions.hashing import md5_unit

#: Cells of the unit interval by which draws find their rank.
CELLS = 4096


def _table(spark: SparkSession, width: int, p: Column) -> DataFrame:
    """``rank, p`` from an expression of the 0-based place ``i``."""
    if width < 1:
        raise ValueError("a distribution has a width of 1 at least")
    return spark.range(width).select((F.col("id") + 1).cast("int").alias("rank"), F.col("id").alias("i")).select("rank", p.cast("double").alias("p"))


def exponential(spark: SparkSession, rate: float, width: int) -> DataFrame:
    norm = (1 - rate**width) / (1 - rate) if rate < 1 else width
    return _table(spark, width, F.pow(F.lit(float(rate)), F.col("i")) / norm)


def uniform(spark: SparkSession, width: int) -> DataFrame:
    return _table(spark, width, F.lit(1.0 / width))


def dirac(spark: SparkSession, width: int) -> DataFrame:
    return _table(spark, width, F.when(F.col("i") == 0, 1.0).otherwise(0.0))


def linear(spark: SparkSession, spread: int, width: int) -> DataFrame:
    m = min(spread, width)
    return _table(spark, width, F.greatest(F.lit(spread) - F.col("i"), F.lit(0)) / (m * (2 * spread - m + 1) / 2))


def zeta(spark: SparkSession, exponent: float, shift: float, width: int) -> DataFrame:
    raw = _table(spark, width, F.pow(F.col("i") + shift, F.lit(-float(exponent))))
    return raw.crossJoin(raw.agg(F.sum("p").alias("s"))).select("rank", (F.col("p") / F.col("s")).alias("p"))  # one row


def two_step(spark: SparkSession, spread: float, width: int) -> DataFrame:
    """1/spread for whole places below ``spread``, the rest on the next, then 0."""
    if spread < 1:
        return dirac(spark, width)
    if spread >= width:
        return uniform(spark, width)
    floor = int(spread)
    return _table(spark, width, F.when(F.col("i") < floor, 1.0 / spread).when(F.col("i") == floor, 1 - floor / spread).otherwise(0.0))


def validate(dist: DataFrame) -> DataFrame:
    """One row: ``width``, ``non_increasing``, ``non_negative``, ``sums_to_one`` (within width / 1e6)."""
    before = F.lag("p").over(Window.partitionBy("one").orderBy("rank"))
    steps = dist.withColumn("one", F.lit(1)).withColumn("up", F.coalesce(F.col("p") - before, F.lit(0.0)))
    slack = F.count("*") / 1e6
    return steps.agg(
        F.count("*").alias("width"),
        (F.max("up") <= slack).alias("non_increasing"),
        (F.min("p") >= 0).alias("non_negative"),
        (F.abs(F.sum("p") - 1) <= slack).alias("sums_to_one"),
    )


def cumulative(dist: DataFrame) -> DataFrame:
    """``rank, p, lo, hi``: each rank's interval (lo, hi]; the first holds 0, the last ends at 1."""
    ranks = Window.partitionBy("one").orderBy("rank")  # a distribution is a small table
    hi = F.when(F.lead("rank").over(ranks).isNull(), F.lit(1.0)).otherwise(F.sum("p").over(ranks))
    rows = dist.withColumn("one", F.lit(1)).withColumn("hi", hi)
    return rows.withColumn("lo", F.coalesce(F.lag("hi").over(ranks), F.lit(-1.0))).select("rank", "p", "lo", "hi")


def draw(rows: DataFrame, dist: DataFrame, key: str = "event_id", into: str = "k", unit: Column | None = None) -> DataFrame:
    """``rows`` with a rank drawn for each by the hash of its key, or by ``unit``: the rank whose interval holds it.

    A range join as an equality join: ranks are listed under every cell of the unit interval that
    they touch (width + CELLS rows), rows look up their own cell.
    """
    cell = lambda c: F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * CELLS).cast("int")
    grid = cumulative(dist).where("lo < hi").select("rank", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    drawn = rows.withColumn("_u", md5_unit(F.col(key)) if unit is None else unit).withColumn("_cell", cell(F.col("_u")))
    hit = (F.col("_cell") == F.col("cell")) & (F.col("lo") < F.col("_u")) & (F.col("_u") <= F.col("hi"))
    return drawn.join(grid, hit).withColumn(into, F.col("rank")).drop("_u", "_cell", "rank", "lo", "hi", "cell")


def get(dist: DataFrame, rank: int) -> DataFrame:
    """One row ``p``: the probability of a rank (ranks begin at 1; null beyond the width)."""
    return dist.agg(F.max(F.when(F.col("rank") == rank, F.col("p"))).alias("p"))


def sample(spark: SparkSession, dist: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``id, k``: n ranks drawn at random."""
    return draw(spark.range(n), dist, unit=F.rand(seed), key="id")


def empiric(draws: DataFrame, width: int, key: str = "k", by_rank: bool = False) -> DataFrame:
    """``rank, p``: relative frequencies of drawn ranks, in falling order or by rank (0 where none was drawn)."""
    spark = draws.sparkSession
    counts = draws.groupBy(F.col(key).alias("r")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    every = spark.range(1, width + 1).select(F.col("id").cast("int").alias("rank"))
    full = every.join(counts, every.rank == counts.r, "left").crossJoin(total).select("rank", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("p"))
    if by_rank:
        return full
    order = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("p"), "rank"))
    return full.select(order.alias("rank"), "p")
