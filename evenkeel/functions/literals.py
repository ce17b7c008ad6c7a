"""Lookup tables as literals: one node of the plan each, whatever their size.

Tables are written as JSON text that the optimizer parses once (constant folding), so a plan does not
hold an expression for each entry.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def array(values: list, kind: str) -> Column:
    """An array literal of ints or doubles."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def lower_bound(sorted_values: list[float], value: Column) -> Column:
    """How many of the sorted values are less than ``value``, by binary search."""
    n = len(sorted_values)
    table = array(sorted_values, "double")
    steps = array([1 << k for k in reversed(range(n.bit_length()))], "int")

    def step(at: Column, s: Column) -> Column:
        return F.when((at + s <= n) & (F.get(table, at + s - 1) < value), at + s).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def mapping(entries: dict, key: Column) -> Column:
    """The int that ``entries`` has for a key, null for other keys; keys are compared as text.

    The entries are dealt into as many buckets by the crc32 of their text, so a row looks at one
    bucket.  Keys must be ints or strings, whose text is the same here and in a plan.
    """
    if any(not isinstance(k, (int, str)) or isinstance(k, bool) for k in entries):
        raise TypeError("keys must be ints or strings")
    buckets: list[dict] = [{} for _ in range(max(1, len(entries)))]
    for k, p in entries.items():
        buckets[zlib.crc32(str(k).encode()) % len(buckets)][str(k)] = p
    table = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")
    text = key.cast("string")
    return F.try_element_at(F.get(table, (F.crc32(text) % len(buckets)).cast("int")), text)
