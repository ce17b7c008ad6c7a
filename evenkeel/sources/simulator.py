"""Recorded key streams: text lines ``(<int>,X)``, numbered into batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BATCH = 100_000


def parse(lines: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key`` (and columns to keep): the first character and the last three are stripped; lines that then are no number are dropped."""
    return lines.select(F.expr(f"try_cast(substring(`{column}`, 2, length(`{column}`) - 4) AS INT)").alias("key"), *keep).where("key is not null")


def read(spark: SparkSession, path: str, batch: int = BATCH) -> DataFrame:
    """``batch, key`` of one file in the order of its lines.

    A file of several splits is numbered split by split: a line's number is its place in its split plus
    the lines of the splits that begin before it, so only a row for each split comes together.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("split"))
    rows = parse(lines, keep=("split",)).withColumn("at", F.monotonically_increasing_id())  # without gaps inside a split
    splits = rows.groupBy("split").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.col("before") + F.col("at") - F.col("first")
    return rows.join(splits.select("split", "first", before.alias("before")), "split").select(F.floor(place / batch).cast("int").alias("batch"), "key")
