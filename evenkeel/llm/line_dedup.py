"""Line deduplication: exact repeats, and lines one edit away from an earlier line.

A line is dropped if an equal line, or one within EDITS = 1 insertion, deletion or substitution of a
character, comes earlier in the order of (doc_id, text, line number); "earlier" is the other line's
first occurrence, dropped or not.  Lines shorter than ``near_from`` characters (NEAR_FROM by default,
2 at least) are compared for equality only.  Lines without a word stay and are not compared.

Candidates come from segments (Pass-Join): within one edit, of the EDITS + 1 halves of the shorter
line one occurs unchanged in the other, at its beginning or at its end.  So every line has four
keys: both halves by its own length, and by the length less one.  Only keys that two different
lines share are looked at again.

Inside a key, up to SMALL lines are compared pairwise.  A larger group is split by the same
argument again and again: the edit lies in one of WINDOWS windows of the part that is not matched yet,
and what is left and right of that window is equal.  At windows of one character lines of one
length that agree in all but one place are within one edit, so the earliest of them is enough, and a
line that equals another less one character is found by equality.  No pair is lost, no group's pairs
are all written out, and a line's length counts once for each level of windows.

Candidates are verified by a bit-parallel automaton over the 2 EDITS + 1 diagonals of the band.
Lines travel as two 64-bit hashes; texts are read again for candidates only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import SPACE, durable, let, row_key, small

EDITS = 1
NEAR_FROM = 16
SMALL, WINDOWS = 32, 8


def within(a: Column, b: Column, k: int = EDITS) -> Column:
    """Whether the edit distance of two strings is k or less.

    For each number of errors e up to k a word holds the diagonals d = -k .. k (place in a less
    place in b) that e errors reach; a column of b moves all of them at once.
    """
    width = 2 * k + 1
    full = (1 << width) - 1

    def run(x: Column, y: Column) -> Column:
        def column(state: Column, j: Column) -> Column:
            match = None
            for d in range(-k, k + 1):
                bit = F.when(F.get(x, j + d) == y[j], F.lit(1 << (d + k))).otherwise(F.lit(0))
                match = bit if match is None else match.bitwiseOR(bit)
            return let(match, lambda m: _step(state, m, k, full))

        reached = F.aggregate(F.sequence(F.lit(0), F.size(y) - 1), _begin(k, full), column)
        end = F.call_function("shiftleft", F.lit(1), F.size(x) - F.size(y) + k)
        return let(reached, lambda r: _any(r, k).bitwiseAND(end) != 0)

    chars = lambda s: F.split(s, "")
    near = F.abs(F.length(a) - F.length(b)) <= k
    blank = (F.length(a) == 0) | (F.length(b) == 0)
    compared = let(F.struct(chars(a).alias("x"), chars(b).alias("y")), lambda s: run(s["x"], s["y"]))
    return F.when(~near, F.lit(False)).when(blank, F.greatest(F.length(a), F.length(b)) <= k).otherwise(compared)


def _begin(k: int, full: int) -> Column:
    words = [1 << k]
    for _ in range(k):
        words.append((words[-1] | words[-1] << 1) & full)
    return F.struct(*(F.lit(w).alias(f"r{e}") for e, w in enumerate(words)))


def _step(state: Column, match: Column, k: int, full: int) -> Column:
    new = [state["r0"].bitwiseAND(match)]
    for e in range(1, k + 1):
        before, after = state[f"r{e - 1}"], new[-1]
        moved = before.bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(after, 1))
        new.append(state[f"r{e}"].bitwiseAND(match).bitwiseOR(moved).bitwiseAND(F.lit(full)))
    return F.struct(*(w.alias(f"r{e}") for e, w in enumerate(new)))


def _any(state: Column, k: int) -> Column:
    out = state["r0"]
    for e in range(1, k + 1):
        out = out.bitwiseOR(state[f"r{e}"])
    return out


#: A line's place: its document (see ``row_key``) and its number.
PLACE = ("nameless", "id", "own", "line_no")


def lines_of(docs: DataFrame) -> DataFrame:
    """PLACE (lines are numbered from 0), ``line`` and its hashes ``k1, k2``, of the lines with a word."""
    rows = docs.where("text is not null").select(row_key(F.col("doc_id"), F.col("text")).alias("r"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    worded = rows.where(F.regexp_like("line", F.lit(f"[^{SPACE[1:]}")))
    return worded.select("r.*", "line_no", "line", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), F.col("line")).alias("k2"))


def _segments(lines: DataFrame, near_from: int) -> DataFrame:
    """The lines with ``seg`` for each of their four keys, ``tag`` (length of the shorter line) and ``part``."""
    n = F.length("line")

    def keys(tag: Column) -> list[Column]:
        head = F.floor(tag / 2).cast("int")
        parts = (F.substring("line", F.lit(1), head), F.substring("line", n - (tag - head) + 1, tag - head))
        return [F.struct(F.xxhash64(tag, F.lit(i), p).alias("seg"), tag.alias("tag"), F.lit(i).alias("part")) for i, p in enumerate(parts)]

    return lines.where(n >= near_from).select("*", F.inline(F.array(*keys(n), *keys(n - 1))))


def _first() -> Column:
    return F.min(F.struct(*PLACE)).alias("first")


def _large_groups(members: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Members of keys with 2 to SMALL different lines, and of keys with more."""
    sizes = members.groupBy(key).agg(F.count("*").alias("size")).where("size > 1")
    held = members.join(sizes, key)
    return held.where(F.col("size") <= SMALL), held.where(F.col("size") > SMALL)


def _pairs(members: DataFrame, key: str) -> DataFrame:
    """(x, y) of every two lines of a key, the one that occurs first in front."""
    a, b = members.alias("a"), members.alias("b")
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.first") < F.col("b.first"))).select(F.col("a.first").alias("x"), F.col("b.first").alias("y"))


def near_lines(docs: DataFrame, near_from: int = NEAR_FROM) -> DataFrame:
    """``first``: first occurrence (a PLACE) of every line that is one edit from an earlier one."""
    segments = _segments(lines_of(docs), near_from)
    shared = segments.groupBy("seg").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).where("low != high").select("seg")
    shared = small(durable(shared))
    members = durable(segments.join(shared, "seg").groupBy("seg", "tag", "part", "k1", "k2").agg(_first()))
    few, many = _large_groups(members, "seg")
    texts = durable(_texts(docs, members))
    pairs, sure = _pairs(few, "seg"), None
    many = durable(many.select("seg", "tag", "part", "first"))
    if not many.isEmpty():
        finer, sure = _refined(many, texts)
        pairs = pairs.unionByName(finer)
    side = lambda s: texts.select(F.col("first").alias(s), F.col("line").alias(f"{s}_line"))
    checked = pairs.distinct().join(side("x"), "x").join(side("y"), "y").where(within(F.col("x_line"), F.col("y_line"))).select(F.col("y").alias("first"))
    return (checked if sure is None else checked.unionByName(sure)).distinct()


def _texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``first, line`` of the members' lines, read from the documents that hold them."""
    wanted = durable(members.select("first").distinct())
    ids = durable(wanted.select(F.struct(*(f"first.{c}" for c in PLACE[:3])).alias("r")).distinct())
    some = docs.where("text is not null").withColumn("r", row_key(F.col("doc_id"), F.col("text"))).join(small(ids), "r")
    rows = some.select("r", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select(F.struct("r.*", "line_no").alias("first"), "line")
    return rows.join(small(wanted), "first").dropDuplicates(["first"])


def _around(line: Column, tag: Column, begin: Column, end: Column) -> Column:
    """What stands left and right of the window, counted from the line's two ends."""
    return F.struct(F.substring(line, F.lit(1), begin), F.substring(line, F.length(line) - (tag - end) + 1, tag - end))


def _refined(many: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs of large groups; and lines that are sure to be near an earlier one."""
    head = F.floor(F.col("tag") / 2).cast("int")
    begin = F.when(F.col("part") == 0, head).otherwise(F.lit(0))  # the half that the key does not hold
    end = F.when(F.col("part") == 0, F.col("tag")).otherwise(head)
    many = many.select(F.col("seg").alias("key"), "tag", "first", begin.alias("begin"), end.alias("end"))
    pairs = []
    while True:
        step = F.greatest(F.ceil((F.col("end") - F.col("begin")) / WINDOWS).cast("int"), F.lit(1))

        def windows(step: Column) -> Column:
            def window(b: Column) -> Column:
                e = F.least(b + step, F.col("end"))
                return F.struct(F.xxhash64("key", b, _around(F.col("line"), F.col("tag"), b, e)).alias("w"), b.alias("b"), e.alias("e"))

            return F.transform(F.sequence("begin", F.col("end") - 1, step), window)

        split = many.join(texts, "first").select("tag", "first", F.inline(let(step, windows)))
        few, more = _large_groups(split.select(F.col("w").alias("key"), "tag", "first", F.col("b").alias("begin"), F.col("e").alias("end")), "key")
        # a large member of one window group is compared with others of its group only
        pairs.append(_pairs(few, "key"))
        many = durable(more.drop("size"))
        if not many.agg(F.max(F.col("end") - F.col("begin"))).first()[0]:
            break
        if many.where(F.col("end") - F.col("begin") > 1).isEmpty():
            break
    return reduce(DataFrame.unionByName, pairs), _one_place(many.join(texts, "first"))


def _one_place(rows: DataFrame) -> DataFrame:
    """``first`` of lines near an earlier one, in groups that agree but for a window of one character (two in the longer lines)."""
    n, line = F.length("line"), F.col("line")
    less = lambda at, put: F.concat(F.substring(line, F.lit(1), at), F.lit(put), F.substring(line, at + 2, n))
    # lines of one length that agree but for the place `at`
    places = F.when(n == F.col("tag"), F.array("begin")).otherwise(F.array("begin", F.col("begin") + 1))
    spot = rows.select("first", F.explode(F.transform(places, lambda at: F.xxhash64("key", n, at, less(at, "\n")))).alias("one"))
    least = spot.groupBy("one").agg(F.min("first").alias("least"))
    same = spot.join(least, "one").where(F.col("first") != F.col("least")).select("first")
    # a line that equals a longer one without one of the window's characters
    cut = rows.where(n == F.col("tag") + 1).select("key", F.col("first").alias("a"), F.explode(F.transform(places, lambda at: less(at, ""))).alias("rest"))
    short = rows.where(n == F.col("tag")).select(F.col("key").alias("k"), F.col("first").alias("b"), line.alias("other"))
    cross = cut.join(short, (F.col("key") == F.col("k")) & (F.xxhash64("rest") == F.xxhash64("other")) & (F.col("rest") == F.col("other"))).select(F.greatest("a", "b").alias("first"))
    return same.unionByName(cross).distinct()


def dropped_lines(docs: DataFrame, near_from: int = NEAR_FROM) -> DataFrame:
    """``nameless, id, own, dropped`` (numbers of the lines to drop) and ``n_near`` of them, of the documents that lose lines."""
    lines = lines_of(docs).drop("line")
    seen = lines.groupBy("k1", "k2").agg(_first(), F.count("*").alias("n"))
    near = durable(near_lines(docs, near_from)).withColumn("near", F.lit(True))
    marked = seen.join(small(near), "first", "left").withColumn("near", F.coalesce("near", F.lit(False))).where("n > 1 or near")
    marked = durable(marked.select("k1", "k2", "first", "near"))
    # repeated lines, and the documents that hold them, grow with the corpus: both joins shuffle at every size
    found = lines.join(marked, ["k1", "k2"]).where(F.col("near") | (F.struct(*PLACE) != F.col("first")))
    gone = found.groupBy(*PLACE[:3]).agg(F.collect_set(F.struct("line_no", "near")).alias("gone"))
    return gone.select(*PLACE[:3], F.col("gone.line_no").alias("dropped"), F.size(F.filter("gone", lambda x: x["near"])).alias("n_near"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", near_from: int = NEAR_FROM) -> DataFrame:
    """``docs`` with the text less its dropped lines, and ``n_lines``, ``n_dropped``, ``n_near`` (ints).

    Every row stays; a document whose lines are all dropped has the empty text.  Null texts stay
    null, with no lines.  A document is an id and a text: rows that share an id but not a text are
    different documents, rows that share both are one, and none of them is a repeat of another.  Null
    ids come last.  Columns with these names are replaced.
    """
    body = F.col(f"`{text}`").cast("string")
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), body.alias("text"))
    gone = durable(dropped_lines(source, near_from)).select(F.struct(*PLACE[:3]).alias("_row"), F.col("dropped").alias("_dropped"), F.col("n_near").alias("_near"))
    held = docs.withColumn("_own", row_key(F.col(f"`{doc_id}`"), body)).join(gone, F.col("_own") == F.col("_row"), "left")
    parts = F.split(F.col(f"`{text}`"), "\n")

    def kept(x: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_dropped"))
        return F.array_join(F.transform(left, lambda i: F.get(x, i)), "\n")

    n = F.when(F.col(f"`{text}`").isNull(), F.lit(0)).otherwise(F.size(parts))
    return held.withColumns(
        {
            "n_lines": n,
            "n_dropped": F.coalesce(F.size("_dropped"), F.lit(0)),
            "n_near": F.coalesce(F.col("_near").cast("int"), F.lit(0)),
            text: F.when(F.col("_dropped").isNull(), F.col(f"`{text}`")).otherwise(let(parts, kept)),
        }
    ).drop("_own", "_row", "_dropped", "_near")
