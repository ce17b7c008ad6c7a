"""Column helpers that several text operators share."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Word separators: ASCII white space.
SPACE = "[\\x20\\x09-\\x0D]"
#: What a table that grows with the data may take in memory and still be broadcast, in bytes.
BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    """The text's words, in order; none for null and for blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` evaluated once a row even where ``body`` uses it in a lambda."""
    return F.transform(F.array(value), body)[0]


def drop_head(items: Column, n: int) -> Column:
    """The array without its first ``n`` elements."""
    return F.slice(items, n + 1, F.greatest(F.size(items) - n, F.lit(0)))


def take_head(items: Column, n: Column) -> Column:
    """The array's first ``n`` elements; none for a negative ``n``."""
    return F.slice(items, 1, F.greatest(n, F.lit(0)))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_key(doc_id: Column, text: Column) -> Column:
    """What tells documents apart: the id (null ids last) and a hash of the text, so that rows which share an id but not a text are two."""
    return F.struct(doc_id.isNull().alias("nameless"), doc_id.alias("id"), F.xxhash64(text).alias("own"))


def labelled_texts(docs: DataFrame, few: DataFrame) -> DataFrame:
    """``few``, a bounded table by ``doc_id``, with the ``text`` of its document: one row an id, of several texts the least."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(few), "doc_id")
    return durable(texts.groupBy(few.columns).agg(F.min("text").alias("text")))


def durable(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage, kept in the shared folder that the cluster names.

    The folder is ``spark.checkpoint.dir``, or the one that the context was given.  Without either
    a session on one machine (``local``) uses its warehouse, and clears up when it ends; on a cluster
    that is an error.  Files go when the frame is garbage collected, if the cluster says so.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints-{uuid.uuid4().hex}"
        context.setCheckpointDir(folder)
        atexit.register(shutil.rmtree, folder.removeprefix("file:"), True)
    return df.checkpoint(eager=True)


def _bytes(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, T.StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(16))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.AtomicType) and not isinstance(kind.elementType, (T.StringType, T.BinaryType)):
        return 16 + 8 * F.coalesce(F.size(value), F.lit(0))
    if isinstance(kind, T.ArrayType):
        return F.aggregate(F.coalesce(value, F.array().cast(kind)), F.lit(16), lambda n, x: n + _bytes(x, kind.elementType).cast("int"))
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return 16 + F.coalesce(F.octet_length(value), F.lit(0))
    return F.lit(8)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its values take ``most`` bytes at most, else as it is.  Adds up their sizes: make it durable first."""
    width = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))
    return F.broadcast(df) if (df.agg(F.sum(width.cast("long"))).first()[0] or 0) <= most else df
