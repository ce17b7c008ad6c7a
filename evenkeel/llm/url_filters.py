"""URL filters as of the time of fetching: dated list entries, validity intervals, an as-of join.

A list entry says that from a time on a pattern is on a list (``add``) or off it (``remove``).  For
each list and pattern the entries become intervals, each valid until the next.  A capture is judged
by the entries active when it was fetched, not by those of today.

Patterns are domains (``example.org``: the host and every subdomain) or host and path
(``example.org/en/``: that path and all below it).  A URL matches by equality of one of its keys:
its host's suffixes and its path's prefixes.  So the join is an equality join on the key with a
time filter on the intervals; each capture and pattern meet at most one interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.common import durable, let, small

BLOCK, ALLOW = "block", "allow"


def host(url: Column) -> Column:
    """The host in lower case, without user, port and final dot; empty where there is none."""
    authority = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), "[.]?(:[0-9]*)?$", ""))


def path(url: Column) -> Column:
    """The path without query and fragment; ``/`` where there is none."""
    found = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    return F.when(found == "", F.lit("/")).otherwise(found)


def keys(url: Column) -> Column:
    """The host's suffixes, and host and path at each slash and as a whole."""

    def suffixes(parts: Column) -> Column:
        return F.transform(parts, lambda _, i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "."))

    def prefixes(parts: Column) -> Column:
        # "/a/b" has the parts "", a, b: prefixes "/", "/a/" and the whole
        return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda _, i: F.concat(F.array_join(F.slice(parts, 1, i + 1), "/"), F.lit("/")))

    domains = let(F.split(host(url), "[.]"), suffixes)
    paths = F.concat(let(F.split(path(url), "/"), prefixes), F.array(path(url)))
    return F.when(host(url) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, F.transform(paths, lambda p: F.concat(host(url), p)))))


def intervals(entries: DataFrame) -> DataFrame:
    """``list, pattern, since, until`` of the times on the list, from ``list, pattern, action, at``.

    ``since`` belongs to the interval, ``until`` (null: no end) doesn't.  Of entries of one list and
    pattern at one time, ``remove`` holds.  Entries with a null in any column are ignored.
    """
    name = F.substring_index("pattern", "/", 1)  # hosts have no case, paths have
    pattern = F.concat(F.lower(name), F.substring("pattern", F.length(name) + 1, F.length("pattern")))
    known = entries.select("list", pattern.alias("pattern"), "action", "at").dropna()
    dated = known.groupBy("list", "pattern", "at").agg(F.max("action").alias("action"))
    following = Window.partitionBy("list", "pattern").orderBy("at")
    return dated.select("list", "pattern", F.col("at").alias("since"), F.lead("at").over(following).alias("until"), "action").where("action = 'add'").drop("action")


def judge(captures: DataFrame, entries: DataFrame, capture_id: str = "page_id", url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """``page_id, url, fetched_at, n_block, n_allow, blocked`` for every capture.

    The counts are of patterns active at the time of fetching; a capture is blocked if some list
    blocks it and none allows it.  A capture with a null or malformed URL, or a null time, matches
    nothing.  Captures with the same id, URL and time are judged alike, each keeps its row.
    """
    source = captures.select(F.col(f"`{capture_id}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{fetched}`").alias("fetched_at"))
    spans = small(durable(intervals(entries)))
    # what is judged is a URL at a time: repeats meet once
    distinct = source.where("url is not null and fetched_at is not null").select("url", "fetched_at").distinct()
    met = distinct.select("url", "fetched_at", F.explode(keys(F.col("url"))).alias("pattern")).join(spans, "pattern")
    met = met.where((F.col("since") <= F.col("fetched_at")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until"))))
    hits = met.groupBy("url", "fetched_at").agg(F.count_if(F.col("list") == BLOCK).alias("n_block"), F.count_if(F.col("list") == ALLOW).alias("n_allow"))
    judged = source.join(hits, ["url", "fetched_at"], "left")
    block, allow = (F.coalesce(c, F.lit(0)).cast("long") for c in ("n_block", "n_allow"))
    return judged.select("page_id", "url", "fetched_at", block.alias("n_block"), allow.alias("n_allow"), ((block > 0) & (allow == 0)).alias("blocked"))
