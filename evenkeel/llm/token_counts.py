"""Exact token counts: a histogram of encoded lengths, whose suffix sums answer every context limit.

Texts are encoded whole, by a byte-level BPE given as a rank file.  Each task counts its documents
by length, so what is shuffled are (length, documents) pairs.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.common import durable

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths whose suffix sums are taken together; the sums over blocks are added afterwards.
BLOCK = 4096


def encoder(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def lengths(docs: DataFrame, text: str = "text", path: str = RANKS) -> DataFrame:
    """``n_tokens, n_docs``: how many of the task's documents have each length, by task.

    The rank file is read by the driver and broadcast (under 1 MB).
    """
    with open(path, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = encoder(ranks.value), Counter()
        for batch in batches:
            seen.update(len(own.encode_ordinary(x)) if x else 0 for x in (v.as_py() for v in batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["n_tokens", "n_docs"])

    return docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(count, "n_tokens long, n_docs long")


def histogram(docs: DataFrame, text: str = "text", path: str = RANKS) -> DataFrame:
    """A row for each encoded length that occurs, ``n_tokens``, with

    ``n_docs`` and ``tokens`` of that length, ``docs_from`` and ``tokens_from`` of that length or
    more, ``total_docs`` and ``total_tokens``, ``truncated_total`` (tokens left when every document
    is cut to this length) and ``quantile`` (the share of documents of this length or less).

    Null and empty texts have length 0.  An empty table gives no rows.
    """
    counts = lengths(docs, text, path).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    return suffix_sums(durable(counts))  # read twice


def suffix_sums(counts: DataFrame) -> DataFrame:
    rows = counts.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    # One row for each BLOCK lengths: the longest text's tokens / BLOCK rows at most.
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    later = blocks.select(
        "block",
        *(F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_later") for c in "dt"),
        *(F.sum(c).over(everything).alias(f"{c}_all") for c in "dt"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    df = rows.join(later, "block").withColumn("docs_from", F.sum("n_docs").over(inside) + F.col("d_later"))
    df = df.withColumn("tokens_from", F.sum("tokens").over(inside) + F.col("t_later"))
    return df.select(
        "n_tokens",
        "n_docs",
        "tokens",
        "docs_from",
        "tokens_from",
        F.col("d_all").alias("total_docs"),
        F.col("t_all").alias("total_tokens"),
        (F.col("t_all") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_total"),
        ((F.col("d_all") - F.col("docs_from") + F.col("n_docs")) / F.col("d_all")).alias("quantile"),
    )


def at_limits(table: DataFrame, limits: list[int]) -> DataFrame:
    """For any context limits, also lengths that no document has: ``limit, docs_over, truncated_total``."""
    over = lambda c: F.when(F.col("n_tokens") > c, F.col("n_docs")).otherwise(0)
    sums = [F.struct(F.lit(int(c)).cast("long").alias("limit"), F.coalesce(F.sum(over(c)), F.lit(0)).alias("docs_over"), F.coalesce(F.sum(F.least("n_tokens", F.lit(int(c))) * F.col("n_docs")), F.lit(0)).alias("truncated_total")) for c in sorted(set(limits))]
    return table.agg(F.array(*sums).alias("x")).select(F.inline("x"))


def quantiles(table: DataFrame, shares: list[float]) -> DataFrame:
    """``share, n_tokens``: the least length that this share of the documents doesn't exceed."""
    picks = [F.struct(F.lit(float(q)).alias("share"), F.min(F.when(F.col("quantile") >= q, F.col("n_tokens"))).alias("n_tokens")) for q in sorted(set(shares))]
    return table.agg(F.array(*picks).alias("x")).select(F.inline("x"))
