"""Benchmark decontamination by SimHash windows, multi-index Hamming search and exact verification.

A benchmark item of 15 words or more is searched by windows of W = 8 words, a shorter one by windows
of 4.  Of the items every window is indexed; of the documents those that begin at multiples of W / 2.
So a run of 1.5 W - 1 words in common (11, or 5), from anywhere in the item, holds a document window
that equals one of the item's.

THRESHOLD leaves such a run in every leak.  Of an item's n - 4 shingles K = floor(0.2 (n - 4)) may be
missing.  A gap inside the item (words put in; changed words cost more) takes 4 at least, so what is
left lies in c + 1 pieces, c = floor(K / 4) at most, and the longest has (n - 4 - K) / (c + 1) shingles
or more: 12 words for n of 15 and more (24 words with one put in), and 5 or more for n below.  So
equality alone finds every leak; the radius adds candidates.

A fingerprint has 48 bits: the majority over the window's words of bits of their hashes.  Sums over
words are kept in six longs of eight 8-bit lanes, so window sums are additions.  The bits form three
blocks of 16; two fingerprints at distance RADIUS = 2 or less agree in one block, so equality joins
on blocks find all of them, and the distance is then computed.

Candidates are verified on words: the weighted 5-word shingles of the item, against those of the
stretch of the document where it would lie.  similarity = sum of min(item's count, stretch's count)
/ sum of the item's counts; at THRESHOLD or more the document holds the item.

Everything is DataFrame functions.  The index is broadcast in slices of SLICE rows at most, the
documents' windows are made and probed in the scanning task, and only hits are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import drop_head, durable, let, row_key, small, take_head, words

SHINGLE, THRESHOLD = 5, 0.8
RADIUS, LONGEST = 2, 8
#: Index rows that are broadcast at once (about 80 bytes each).
SLICE = 300_000
_LANES = 0x0101010101010101
_SUMS = 6


def normal_words(text: Column) -> Column:
    return words(F.lower(text))


def window_size(n: Column) -> Column:
    """Window of an item of n words; null for items without a shingle, see ``_short_leaks``."""
    case = F.when(n < SHINGLE, F.lit(None).cast("int"))
    w = LONGEST
    while w > 4:
        case = case.when(n >= 2 * w - 1, F.lit(w))
        w //= 2
    return case.otherwise(F.lit(4))


def _word_sums(h: Column, first: Column, count: int) -> Column:
    """Lane sums of ``count`` word hashes from a place on."""
    out = []
    for p in range(_SUMS):
        total = None
        for j in range(count):
            lane = F.shiftright(h[first + j], p).bitwiseAND(F.lit(_LANES))
            total = lane if total is None else total + lane
        out.append(total.alias(f"s{p}"))
    return F.struct(*out)


def _add(a: Column, b: Column) -> Column:
    return F.struct(*((a[f"s{p}"] + b[f"s{p}"]).alias(f"s{p}") for p in range(_SUMS)))


def _joined(sums: Column, apart: int) -> Column:
    """Sums of neighbouring windows ``apart`` places from each other: windows twice as long."""
    return let(sums, lambda s: F.zip_with(take_head(s, F.size(s) - apart), drop_head(s, apart), _add))


def _keys(s: Column, size: int) -> list[Column]:
    """The fingerprint's three blocks, from lane sums over ``size`` words (a bit is set from half on)."""
    bits = [F.shiftright(s[f"s{p}"] + F.lit(_LANES * (64 - size // 2)), 6).bitwiseAND(F.lit(_LANES)) for p in range(_SUMS)]
    return [bits[2 * k].bitwiseOR(F.shiftleft(bits[2 * k + 1], 1)) for k in range(3)]


def _windows(h: Column, sizes: list[int], dense: bool) -> Column:
    """Array of (place, size, k0, k1, k2): from every place (dense) or from multiples of half the size."""
    step = 1 if dense else min(sizes) // 2
    length = min(sizes) if dense else step
    count = F.floor((F.size(h) - length) / step).cast("int") + 1
    base = F.when(F.size(h) >= length, F.transform(F.sequence(F.lit(0), count - 1), lambda k: _word_sums(h, k * step, length)))

    def longer(sums: Column, size: int) -> Column:
        own = _placed(sums, size, step, 1 if dense else size // 2) if size in sizes else None
        if size >= max(sizes):
            return own
        rest = let(_joined(sums, size // step), lambda s: longer(s, 2 * size))
        return rest if own is None else F.concat(own, rest)

    return let(base, lambda s: longer(s, length))


def _placed(sums: Column, size: int, step: int, every: int) -> Column:
    """(place, size, k0, k1, k2) of sums that stand ``step`` words apart, at multiples of ``every`` words."""
    numbered = F.transform(sums, lambda x, i: F.struct((i * step).alias("place"), F.lit(size).alias("size"), *(k.alias(f"k{j}") for j, k in enumerate(_keys(x, size)))))
    if every > step:
        numbered = F.filter(numbered, lambda w: w["place"] % every == 0)
    return F.coalesce(numbered, F.array().cast("array<struct<place:int,size:int,k0:bigint,k1:bigint,k2:bigint>>"))


def _block_keys(size: Column, k: list[Column]) -> Column:
    """The window's three index keys: block, its number and the window's size in one long."""
    tag = lambda j: F.shiftleft((F.log2(size).cast("long") * 3 + j), 58)
    return F.array(*(F.struct((k[j] + tag(j)).alias("key"), F.lit(j).alias("block")) for j in range(3)))


def _shingles(h: Column) -> Column:
    return F.transform(take_head(h, F.size(h) - (SHINGLE - 1)), lambda x, i: F.xxhash64(x, *(h[i + j] for j in range(1, SHINGLE))))


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, similarity, first_word``: every document that holds a benchmark item.

    ``first_word`` is about where the item begins, within a quarter of its length (of several places
    the most similar, then the first).  Words are lower-cased and split at white space.  Items of fewer
    than SHINGLE words are found only where they are a whole text or line; null and blank texts are not
    searched.  Of rows that share an id every text is searched, of items that share one every text is
    looked for; the ids are reported once, with the best of their places.  Null document ids are reported
    as one id; items with a null id are left out.  No items, no rows.
    """
    best = F.max(F.struct("similarity", (-F.col("first_word")).alias("at")))
    found = _leaks(docs, benchmark, doc_id, text, item_id, item_text).groupBy(F.col("row.id").alias("doc_id"), "item_id").agg(best.alias("b"))
    return found.select("doc_id", "item_id", "b.similarity", (-F.col("b.at")).alias("first_word"))


def _leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str, item_id: str, item_text: str) -> DataFrame:
    """``row, item_id, similarity, first_word``; row: see ``row_key``."""
    given = benchmark.select(F.col(f"`{item_id}`").alias("item_id"), normal_words(F.col(f"`{item_text}`")).alias("w")).where(F.col("item_id").isNotNull())
    given = durable(given.distinct().withColumns({"item": F.monotonically_increasing_id(), "n": F.size("w"), "size": window_size(F.size("w"))}))
    items = durable(given.where("size is not null").withColumn("h", F.transform("w", lambda x: F.xxhash64(x))).drop("w"))
    sizes = [r[0] for r in items.select("size").distinct().orderBy("size").collect()]
    body = F.col(f"`{text}`").cast("string")
    source = docs.select(row_key(F.col(f"`{doc_id}`"), body).alias("row"), body.alias("text")).where("text is not null")
    short = durable(_short_leaks(source, given.where(F.col("n").between(1, SHINGLE - 1)).select("item_id", "w")))
    if not sizes:
        return short

    def dense(size: int) -> DataFrame:
        return items.where(F.col("size") == size).select("item", F.inline(let(F.col("h"), lambda h: _windows(h, [size], True))))

    index = reduce(DataFrame.unionByName, map(dense, sizes))
    index = durable(index.select("item", "place", "k0", "k1", "k2", F.inline(_block_keys(F.col("size"), [F.col(f"k{j}") for j in range(3)]))))
    slices = max(1, -(-index.count() // SLICE))

    hashed = source.select("row", F.transform(normal_words(F.col("text")), lambda x: F.xxhash64(x)).alias("h"))
    found = None
    for part in range(slices):
        some = index if slices == 1 else index.where(F.pmod(F.xxhash64("key"), F.lit(slices)) == part)
        near = _candidates(hashed, some, sizes)
        found = near if found is None else found.unionByName(near)
    return _verified(source, items, durable(found.distinct())).unionByName(short)


def _short_leaks(source: DataFrame, items: DataFrame) -> DataFrame:
    """Items of fewer than SHINGLE words (``item_id, w``) that are a document's whole text or one of its lines."""
    items = durable(items)
    rows = source if not items.isEmpty() else source.limit(0)
    counted = F.transform(F.split("text", "\n"), normal_words)
    whole = F.struct(F.lit(0).alias("first_word"), normal_words(F.col("text")).alias("w"))

    def placed(lines: Column) -> Column:
        few = lambda w: F.size(w).between(1, SHINGLE - 1)
        hits = F.filter(F.transform(lines, lambda w, i: F.when(few(w), F.struct(i.alias("line"), w.alias("w")))), lambda x: x.isNotNull())
        before = lambda i: F.aggregate(F.slice(lines, 1, i), F.lit(0), lambda n, w: n + F.size(w))
        return F.transform(hits, lambda x: F.struct(before(x["line"]).alias("first_word"), x["w"].alias("w")))

    found = rows.select("row", F.inline(F.concat(let(counted, placed), F.filter(F.array(whole), lambda x: F.size(x["w"]) < SHINGLE))))
    met = found.join(small(items), "w").groupBy("row", "item_id").agg(F.min("first_word").alias("first_word"))
    return met.select("row", "item_id", F.lit(1.0).alias("similarity"), "first_word")


def _candidates(hashed: DataFrame, index: DataFrame, sizes: list[int]) -> DataFrame:
    """(row, item, at): documents' windows within RADIUS of an item's window; at: where the item would begin."""
    windows = hashed.select("row", F.inline(let(F.col("h"), lambda h: _windows(h, sizes, False))))
    probes = windows.select("row", "place", "k0", "k1", "k2", F.inline(_block_keys(F.col("size"), [F.col(f"k{j}") for j in range(3)])))
    entry = index.select("item", F.col("place").alias("from"), "key", *(F.col(f"k{j}").alias(f"i{j}") for j in range(3)))
    distance = sum((F.bit_count(F.col(f"k{j}").bitwiseXOR(F.col(f"i{j}"))) for j in range(1, 3)), F.bit_count(F.col("k0").bitwiseXOR(F.col("i0"))))
    return probes.join(F.broadcast(entry), "key").where(distance <= RADIUS).select("row", "item", (F.col("place") - F.col("from")).alias("at"))


def _verified(source: DataFrame, items: DataFrame, candidates: DataFrame) -> DataFrame:
    spot = candidates.join(small(items.select("item", "n")), "item")
    texts = source.join(small(durable(candidates.select("row").distinct())), "row").dropDuplicates(["row"])
    texts = texts.select("row", F.transform(normal_words(F.col("text")), lambda x: F.xxhash64(x)).alias("h"))
    slack = F.floor(F.col("n") / 4).cast("int")
    begin = F.greatest(F.col("at") - slack, F.lit(0))
    stretch = F.slice("h", begin + 1, F.greatest(F.col("at") + F.col("n") + slack - begin, F.lit(0)))
    there = texts.join(spot, "row").select("row", "item", "at", F.explode(let(stretch, _shingles)).alias("s")).groupBy("row", "item", "at", "s").agg(F.count("*").alias("c"))
    wanted = items.select("item", F.explode(let(F.col("h"), _shingles)).alias("s")).groupBy("item", "s").agg(F.count("*").alias("want"))
    held = there.join(wanted, ["item", "s"]).groupBy("row", "item", "at").agg(F.sum(F.least("c", "want")).alias("held"))
    scored = held.join(items.select("item", "item_id", (F.col("n") - (SHINGLE - 1)).alias("total")), "item").withColumn("similarity", F.col("held") / F.col("total"))
    return scored.where(F.col("similarity") >= THRESHOLD).select("row", "item_id", "similarity", F.greatest("at", F.lit(0)).alias("first_word"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item."""
    leaks = durable(_leaks(docs, benchmark, "doc_id", "text", "item_id", "text").select(F.col("row").alias("_leak")).distinct())
    held = docs.withColumn("_row", row_key(F.col("doc_id"), F.col("text").cast("string")))
    return held.join(small(leaks), F.col("_row") == F.col("_leak"), "left_anti").select(docs.columns)
