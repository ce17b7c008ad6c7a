"""Sharding by a hierarchical weighted hash tree.

A tree has regions, regions have racks, racks have shards; every shard has a weight and every
inner node weighs as much as the shards below it.  A row descends the tree: at each node every
child draws ``-ln(u) / weight`` with ``u`` hashed from the row's key and the child's name, and the
least draw wins.  A child whose weight does not change keeps its draws, so a change of weights
moves rows only into or out of the subtrees whose weights changed.

A shard added by :meth:`HashTree.grow` hangs from the root as a branch of its own (its region and
rack are labels) until a tree is built anew.  Then no draw of an older subtree changes, and the new
shard takes rows only into itself; growth inside a rack would also reshuffle rows below the region
that got heavier.

Everything is a Column expression over ``md5``; the only exchange deals out per-bucket counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.common import let

#: Hash buckets inside a shard, within which rows are numbered.  A power of 16.
BUCKETS = 4096


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


@dataclass(frozen=True)
class HashTree:
    """Shards below racks below regions.  ``added`` shards are branches of the root."""

    shards: tuple[Shard, ...]
    added: tuple[Shard, ...] = ()

    @classmethod
    def balanced(cls, n: int, regions: int = 3, racks: int = 2) -> HashTree:
        """``n`` shards of weight 1, dealt in order over ``regions`` x ``racks``."""
        if n < 1:
            raise ValueError("a tree needs a shard")
        cells = regions * racks
        return cls(tuple(Shard(f"r{i * cells // n // racks}", f"k{i * cells // n % racks}", i) for i in range(n)))

    def grow(self, weight: float = 1.0) -> HashTree:
        """The tree with one more shard, numbered next."""
        new = 1 + max(s.shard for s in (*self.shards, *self.added))
        return HashTree(self.shards, (*self.added, Shard(f"r+{new}", "k0", new, weight)))

    def assign(self, key: Column) -> Column:
        """The shard of each key, an int.  ``key`` is a string; null counts as an empty string."""
        key = F.coalesce(key, F.lit(""))
        regions: dict[str, dict[str, list[Shard]]] = {}
        for s in self.shards:
            if s.weight <= 0:
                raise ValueError("weights must be positive")
            regions.setdefault(s.region, {}).setdefault(s.rack, []).append(s)

        def leaves(region: str, rack: str) -> Column:
            return _least(key, [(f"{region}/{rack}/{s.shard}", s.weight, F.lit(s.shard)) for s in regions[region][rack]])

        def racks(region: str) -> Column:
            return _least(key, [(f"{region}/{rack}", sum(s.weight for s in own), leaves(region, rack)) for rack, own in regions[region].items()])

        top = [(region, sum(s.weight for own in kids.values() for s in own), racks(region)) for region, kids in regions.items()]
        top += [(s.region, s.weight, F.lit(s.shard)) for s in self.added]
        return _least(key, top).cast("int")


def unit(key: Column, name: str) -> Column:
    """A hash of key and name in (0, 1)."""
    return (F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{name}"))), 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(16**12))


def _least(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The outcome below the child with the least draw; only that branch is evaluated."""
    if len(children) == 1:
        return children[0][2]
    draws = [-F.log(unit(key, name)) / F.lit(float(weight)) for name, weight, _ in children]
    # min_by over the few children: the winner's index first, then one branch of a CASE.
    pairs = [F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(draws)]
    outcomes = [c[2] for c in children]

    def branch(i: Column) -> Column:
        case = F.when(i == 0, outcomes[0])
        for k, out in enumerate(outcomes[1:], 1):
            case = case.when(i == k, out)
        return case

    return let(F.array_min(F.array(*pairs))["i"], branch)


def shard_documents(docs: DataFrame, tree: HashTree, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs``.

    Law ``key``: the row's key and the tree alone decide.  ``size`` is the text's UTF-8 bytes plus
    8, ``slot`` numbers a shard's rows from 0 without gaps, in the order of (hash bucket, key,
    CRC).  A null text counts as empty, a null key as an empty string; repeated rows share a shard
    and get slots of their own; an empty table gives an empty result.  Other columns are ignored.  Hash
    buckets come from key and CRC, so that rows without a key are spread over a shard's buckets.
    """
    id_, body = F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    name = F.coalesce(id_.cast("string"), F.lit(""))
    rows = docs.select(
        id_.alias("doc_id"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        tree.assign(name).alias("shard"),
        tree.grow().assign(name).alias("grown_shard"),
        F.conv(F.substring(F.md5(F.concat_ws("|", name, F.crc32(body))), 1, _hex_digits(BUCKETS)), 16, 10).cast("int").alias("bucket"),
    )
    return _slots(rows).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _hex_digits(n: int) -> int:
    digits = len(f"{n - 1:x}")
    if 16**digits != n:
        raise ValueError("the number of buckets is no power of 16")
    return digits


def _slots(rows: DataFrame) -> DataFrame:
    """Number each shard's rows: inside its buckets, plus the rows of the buckets before.

    The table of offsets has shards x BUCKETS rows at most, whatever the input.  Rows that agree in all
    columns are counted in the task that reads them and numbered together, so repeats of one row, however
    many, are a row a task in their bucket's window.
    """
    counted = rows.groupBy(*rows.columns, F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))
    cells = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(F.col("shard").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size", "part").rowsBetween(Window.unboundedPreceding, -1)
    return (
        counted.withColumn("at", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(F.broadcast(offsets), (F.col("shard") == F.col("s")) & (F.col("bucket") == F.col("b")))
        .withColumn("slot", F.explode(F.sequence(F.col("first") + F.col("at"), F.col("first") + F.col("at") + F.col("n") - 1)))
    )
