"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A text is a weighted set: its distinct runs of SHINGLE words, each weighing as often as it occurs.
ProbMinHash gives every element a Poisson process of arrivals whose rate is its weight; each arrival
picks one of the registers, a register keeps its earliest arrival's element, and an element stops as
soon as its next arrival comes later than every register's.  Two texts agree in a register with the
probability Jaccard similarity

    J(x, y) = sum over common i of 1 / sum over j of max(x_j / x_i, y_j / y_i),

which is the Jaccard similarity where no shingle repeats.  Bands of registers propose candidates;
J of the whole weighted sets decides.  With 20 bands of 4 a pair at J = 0.8 is missed with
probability 3e-5.

Equal texts meet first (two 64-bit hashes of the whole text) and are one node from then on, whatever
their ids; rows that share an id but not a text are different nodes.  Inside a bucket candidates are
not all pairs: every member is compared with the bucket's hub, linked texts are joined into
components, and only texts of a bucket in different components are compared further.  In buckets above
LARGE texts, those pairs come from differences to a consensus (see :func:`_differing`): texts that
deviate little from it are linked to the one that deviates least, and others can only be similar if
they share some of their rarest deviations (texts with repeated shingles: one of their rarest shingles).
No link is lost to these steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm import scan
from evenkeel.llm.common import durable, small
from evenkeel.llm.components import components

SHINGLE = 5
BANDS, ROWS = 20, 4
THRESHOLD = 0.8
#: Buckets above this many texts are not compared pair by pair, but by deviations from a consensus.
LARGE = 16


def registers(doc: np.ndarray, items: np.ndarray, weights: np.ndarray, n_docs: int, m: int) -> tuple[np.ndarray, int]:
    """(n_docs, m) elements that won each register (0 for texts without elements); arrivals drawn."""
    time = np.full(n_docs * m, np.inf)
    won = np.zeros(n_docs * m, np.uint64)
    t, d, e, w = np.zeros(len(doc)), doc.astype(np.int64), items, weights.astype(float)
    arrivals, step = 0, 0
    while len(d):
        step += 1
        arrivals += len(d)
        with np.errstate(over="ignore"):
            x = scan.mix(e + np.uint64(step) * np.uint64(0xD1B54A32D192ED03))
        t = t - np.log(((x >> np.uint64(11)).astype(float) + 0.5) / 2.0**53) / w
        slot = d * m + (scan.mix(x) % np.uint64(m)).astype(np.int64)
        early = t < time[slot]
        s, ts, es = slot[early], t[early], e[early]
        np.minimum.at(time, s, ts)
        hit = time[s] == ts
        won[s[hit]] = es[hit]
        on = t < time.reshape(n_docs, m).max(axis=1)[d]
        t, d, e, w = t[on], d[on], e[on], w[on]
    return won.reshape(n_docs, m), arrivals


def bands(won: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    """(n_docs, n_bands) hashes; equal where all registers of the band agree."""
    h = np.zeros((len(won), n_bands), np.uint64)
    parts = won.reshape(len(won), n_bands, rows)
    with np.errstate(over="ignore"):
        h += np.arange(1, n_bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(rows):
            h = scan.mix(h * np.uint64(31) + parts[:, :, k])
    return h.view(np.int64)


def _sets(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Portions of the texts: first, end, and (text, shingle, weight) of their elements in order."""
    data, at = scan.buffers(texts)
    for a, b in scan.portions(at):
        doc, words, _, _ = scan.hashed_words(data[at[a] : at[b]], at[a : b + 1] - at[a])
        yield a, b, *scan.weighted(*scan.shingles(doc, words, SHINGLE))


def _lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), values)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, doc, items, weights in _sets(batch.column("text")):
            won, _ = registers(doc, items, weights, b - a, BANDS * ROWS)
            some = np.bincount(doc, minlength=b - a) > 0
            h = bands(won, BANDS, ROWS)[some]
            own = [batch.column(c).slice(a, b - a) for c in ("doc_id", "k1", "k2")]
            yield pa.RecordBatch.from_arrays([*own, _lists(pa.array(h.ravel()), some * BANDS)], names=["doc_id", "k1", "k2", "bands"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, doc, items, weights in _sets(batch.column("text")):
            n = np.bincount(doc, minlength=b - a)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").slice(a, b - a), _lists(pa.array(items.view(np.int64)), n), _lists(pa.array(weights.astype(np.int32)), n)],
                names=["node", "items", "weights"],
            )


def similarity(x: np.ndarray, xw: np.ndarray, y: np.ndarray, yw: np.ndarray) -> float:
    """Probability Jaccard of two weighted sets (distinct items, each with its weight)."""
    if not len(x) or not len(y):
        return 0.0
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    only_x, only_y = xw.sum() - xw[i].sum(), yw.sum() - yw[j].sum()
    pairs, n = np.unique(np.stack([xw[i], yw[j]]), axis=1, return_counts=True)
    a, b = pairs.astype(float)
    both = np.maximum(a[None, :] / a[:, None], b[None, :] / b[:, None]) @ n
    return float((n / (both + only_x / a + only_y / b)).sum())


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = []
        for side in "ab":
            items, weights = batch.column(f"{side}_items"), batch.column(f"{side}_weights")
            sides.append((items.offsets.to_numpy(), items.values.to_numpy(), weights.offsets.to_numpy(), weights.values.to_numpy()))
        keep = []
        for k in range(batch.num_rows):
            x, xw, y, yw = (v for o, items, p, weights in sides for v in (items[o[k] : o[k + 1]], weights[p[k] : p[k + 1]]))
            keep.append(similarity(x, xw, y, yw) >= THRESHOLD - 1e-9)
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in "ab"], names=["a", "b"])


def _links(pairs: DataFrame, elements: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose weighted sets are similar."""
    side = lambda s: elements.select(F.col("node").alias(s), F.col("items").alias(f"{s}_items"), F.col("weights").alias(f"{s}_weights"))
    return pairs.distinct().join(side("a"), "a").join(side("b"), "b").mapInArrow(_verify, "a long, b long")


def _shares(own: DataFrame) -> DataFrame:
    """``own`` with ``n``, the text's weight, ``plain``, whether no shingle repeats, and ``u``, the weight of shingles that no other text of ``own`` has."""
    flat = own.select("node", F.inline(F.arrays_zip("items", "weights"))).toDF("node", "item", "weight")
    once = flat.groupBy("item").agg(F.count("*").alias("n"), F.min("node").alias("node"), F.min("weight").alias("weight")).where("n = 1")
    unique = once.groupBy("node").agg(F.sum("weight").alias("u"))
    size = own.withColumns({"n": F.aggregate("weights", F.lit(0).cast("long"), lambda s, w: s + w), "plain": F.array_max("weights") == 1})
    return size.join(unique, "node", "left").withColumn("u", F.coalesce("u", F.lit(0)))


def _provably_alone(members: DataFrame) -> DataFrame:
    """(bucket, node) of members of large buckets that are not similar to any other member.

    Let u be the weight of the shingles that no other text in any large bucket has, n the text's
    weight.  J is at most the share of common weight in either text, so u > (1 - THRESHOLD) n
    proves it.  Where no shingle repeats in any text of the bucket, J is the Jaccard similarity, at
    most (n - u) / (n' + u) for a partner of n' shingles, so the bucket's least n' can prove it too.
    """
    bucket = members.groupBy("bucket").agg(F.min("n").alias("least"), F.min("plain").alias("all_plain"))
    alone = (F.col("u") > (1 - THRESHOLD) * F.col("n") + 1e-6) | (
        F.col("all_plain") & (F.col("n") - F.col("u") < THRESHOLD * (F.col("least") + F.col("u")) - 1e-6)
    )
    return members.join(bucket, "bucket").where(alone).select("bucket", "node")


def _cannot_link(a: str, b: str) -> Column:
    """Whether the weights that two texts share with no other prove that they are not similar.

    With shares P and Q of either text's weight that the other may hold, J <= 1 / (1 / P + 1 / Q - 1)
    (the sum is concave in the common weights); for texts without repeats the common shingles are
    at most the lesser n - u, which bounds the Jaccard similarity.  Unknown weights prove nothing.
    """
    n, u, m, v = (F.col(f"{t}.{c}").cast("double") for t in (a, b) for c in "nu")
    common = F.least(n - u, m - v)
    plain = F.col(f"{a}.plain") & F.col(f"{b}.plain") & (common < THRESHOLD * (n + m - common) - 1e-6)
    shares = (n - u) * (m - v) * (1 / THRESHOLD + 1) < n * (m - v) + m * (n - u) - 1e-6
    return F.coalesce(plain | shares, F.lit(False))


def near_duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, class_id, is_first`` for every row of ``docs``.

    A class is a connected component of texts linked by J >= THRESHOLD, ``class_id`` the least id of
    its rows (null if none has one); ``is_first`` marks one row of the class, of those with the least
    id.  Equal texts share a class, whatever their ids; rows that share an id but not a text are judged
    each by its own text.  Null counts as the empty text.  A text of fewer than SHINGLE words is one
    shingle; blank texts are linked to equal ones only.  Ids are longs.
    """
    return _classes(docs, doc_id, text).select("doc_id", "class_id", (F.col("row") == F.col("head.row")).alias("is_first"))


def _keys(text: Column) -> tuple[Column, Column]:
    """A row's text as two 64-bit hashes."""
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")


def _classes(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, k1, k2, row, class_id, head`` for every row: its text's hashes, a number of its own, and its class's first row."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), body.alias("text"), *_keys(body))
    signed = durable(source.mapInArrow(_sign, "doc_id long, k1 long, k2 long, bands array<long>").withColumn("row", F.monotonically_increasing_id()))
    head = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), "k1", "k2", "row")
    texts = signed.groupBy("k1", "k2").agg(F.min(head).alias("head"), F.first("bands").alias("bands"))
    texts = durable(texts.withColumn("node", F.monotonically_increasing_id()))

    spread = texts.select("node", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("hub")).where("size > 1")
    members = durable(spread.join(shared, "bucket"))

    wanted = texts.join(members.select("node").distinct(), "node").select("k1", "k2", F.col("head.id").alias("id"), "node")
    # of equal texts only the rows with the least id are read again
    found = source.join(wanted, ["k1", "k2"]).where(F.col("doc_id").eqNullSafe(F.col("id"))).select("node", "text")
    elements = durable(found.mapInArrow(_elements, "node long, items array<long>, weights array<int>").dropDuplicates(["node"]))

    links = durable(_links(members.where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")), elements))
    classes = components(links)
    held = _mixed(members, classes)
    if not held.where(F.col("size") > LARGE).isEmpty():
        differing = _differing(held, elements)
        links = durable(links.unionByName(_links(_deviating_least(differing), elements)))
        classes = components(links)
        held = _mixed(held, classes)
        more = _unresolved(held, differing, classes)
    else:
        more = _bucket_pairs(held.where("node != hub"), F.lit(False))
    more = durable(_links(more, elements))
    if not more.isEmpty():
        classes = components(links.unionByName(more))
    known = texts.join(classes.withColumnRenamed("node", "id"), texts.node == F.col("id"), "left").select("k1", "k2", "head", F.coalesce("component", "node").alias("component"))
    first = known.groupBy("component").agg(F.min("head").alias("head"))
    return signed.select("doc_id", "k1", "k2", "row").join(known.drop("head").join(first, "component"), ["k1", "k2"]).withColumn("class_id", F.col("head.id"))


def _mixed(members: DataFrame, classes: DataFrame) -> DataFrame:
    """``bucket, size, hub, node, component`` of buckets whose members are in several components."""
    held = members.select("bucket", "size", "hub", "node").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = held.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("bucket")
    return durable(held.join(mixed, "bucket"))


def _differing(held: DataFrame, elements: DataFrame) -> DataFrame:
    """``node, crowd, n, plain, u, d, lacks, deviations, outside, weights, away`` of the texts of large buckets.

    A crowd is what large buckets connect; its consensus is the shingles that more than half of its
    texts have.  ``deviations`` are the text's shingles outside the consensus and those of the consensus
    that it lacks, ``d`` and ``lacks`` in number, rarest deviation first: the symmetric difference of two
    texts of a crowd is that of their deviations.  ``outside`` are those of the first kind, with their
    weights, ``away`` the share of the text's weight that they are.  What is known of a crowd are the shingles of more than a 16th of its texts, at
    most 16 times as many as a text has on average.
    """
    large = held.where(F.col("size") > LARGE)
    crowds = components(large.select(F.col("hub").alias("a"), F.col("node").alias("b"))).withColumnRenamed("component", "crowd")
    own = durable(_shares(elements.join(large.select("node").distinct(), "node")).join(crowds, "node"))
    texts = durable(own.groupBy("crowd").agg(F.count("*").alias("texts")))
    # a crowd has more than LARGE texts
    often = own.select("crowd", F.explode("items").alias("item")).groupBy("crowd", "item").agg(F.count("*").alias("c")).where(16 * F.col("c") > LARGE)
    often = durable(often).join(small(texts), "crowd").where("16 * c > texts")
    known = durable(often.groupBy("crowd").agg(F.first("texts").alias("texts"), F.collect_list(F.struct("item", "c")).alias("k")))
    known = known.select("crowd", "texts", F.col("k.item").alias("often"), F.col("k.c").alias("counts"))
    both = own.join(small(known), "crowd", "left").select("node", "crowd", "n", "plain", "u", "items", "weights", "texts", "often", "counts")
    kinds = "node long, crowd long, n long, plain boolean, u long, d int, lacks int, deviations array<long>, outside array<long>, weights array<int>, away double"
    return durable(both.mapInArrow(_deviations, kinds))


def _deviations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        deviations, outside, weights, lacks = [], [], [], []
        texts, often_, counts_ = (batch.column(c).to_pylist() for c in ("texts", "often", "counts"))
        (at, items_), (_, weights_) = ((c.offsets.to_numpy(), c.values.to_numpy()) for c in (batch.column("items"), batch.column("weights")))
        for k in range(batch.num_rows):
            items = items_[at[k] : at[k + 1]]
            often, counts = np.array(often_[k] or [], np.int64), np.array(counts_[k] or [], np.int64)
            order = np.argsort(often)
            often, counts = often[order], counts[order]
            place = np.minimum(np.searchsorted(often, items), max(len(often) - 1, 0))
            c = np.where(often[place] == items, counts[place], 0) if len(often) else np.zeros(len(items), np.int64)
            common = 2 * counts > (texts[k] or 0)
            lack = common & ~np.isin(often, items)
            out = ~np.isin(items, often[common])
            dev, seldom = np.append(items[out], often[lack]), np.append(c[out], (texts[k] or 0) - counts[lack])
            deviations.append(dev[np.lexsort((dev, seldom))])
            outside.append(items[out])
            weights.append(weights_[at[k] : at[k + 1]][out])
            lacks.append(int(lack.sum()))
        d, n = (np.array([len(x) for x in part], np.int32) for part in (deviations, outside))
        join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
        away = np.array([x.sum() for x in weights], float) / batch.column("n").to_numpy()
        own = [batch.column(c) for c in ("node", "crowd", "n", "plain", "u")]
        lists = [_lists(pa.array(join(deviations, np.int64)), d), _lists(pa.array(join(outside, np.int64)), n), _lists(pa.array(join(weights, np.int32)), n)]
        names = ["node", "crowd", "n", "plain", "u", "d", "lacks", "deviations", "outside", "weights", "away"]
        yield pa.RecordBatch.from_arrays([*own, pa.array(d), pa.array(lacks, pa.int32()), *lists, pa.array(away)], names=names)


def _room(n: Column) -> Column:
    """What a plain text of n shingles adds to the symmetric difference that THRESHOLD allows: J >= T means |x ^ y| <= (|x| + |y|) (1 - T) / (1 + T)."""
    return n * ((1 - THRESHOLD) / (1 + THRESHOLD))


def _odds(share: Column) -> Column:
    """1 / P - 1 for P = 1 - share.  J >= T asks of the shares x and y of either text's weight that the other lacks: odds(x) + odds(y) <= 1 / T - 1."""
    return F.when(share < 1, share / (1 - share)).otherwise(F.lit(1e9))


#: What the odds of two similar texts add up to, at most.
ODDS = 1 / THRESHOLD - 1 + 1e-6


def _deviating_least(differing: DataFrame) -> DataFrame:
    """Pairs (a, b): texts of a crowd, and the one of them that deviates least.

    Of plain texts that is the one with the most room beside its deviations: if the deviations of two
    texts together leave room, |D(x)| + |D(y)| <= room(x) + room(y), they are similar, and each is similar
    to the text with the most room left, so no other such pair is needed.  Others are compared with
    the text that has the least weight outside the consensus, where that may be enough.
    """
    left = _room(F.col("n")) - F.col("d") + 1e-6
    texts = differing.where("plain").select("node", "crowd", left.alias("left"))
    best = texts.groupBy("crowd").agg(F.max(F.struct("left", "node")).alias("m"))
    near = texts.join(small(durable(best)), "crowd").where((F.col("left") + F.col("m.left") >= 0) & (F.col("node") != F.col("m.node")))
    least = _with_least(differing).where("not (plain and m.plain) and node != m.node")
    pair = (F.least("node", "m.node").alias("a"), F.greatest("node", "m.node").alias("b"))
    return near.select(*pair).unionByName(least.select(*pair))


def _with_least(texts: DataFrame) -> DataFrame:
    """``texts`` with ``m``, the text of the crowd that lacks least of the consensus and has the least weight outside; only those that may be similar to it by these weights."""
    least = texts.groupBy("crowd").agg(F.min(F.struct("lacks", "away", "node", "plain")).alias("m"))
    return texts.join(small(durable(least)), "crowd").where(_odds(F.col("away")) + _odds(F.col("m.away")) <= ODDS)


def _unresolved(held: DataFrame, differing: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of a bucket in different components, neither its hub, that may yet be similar."""
    held = held.where("node != hub").join(differing.select("node", "n", "plain", "u"), "node", "left")
    large = held.where(F.col("size") > LARGE)
    alone = _provably_alone(large)
    rest = durable(large.join(alone, ["bucket", "node"], "left_anti"))
    few = _bucket_pairs(held.where(F.col("size") <= LARGE), _cannot_link("a", "b"))
    open_ = durable(differing.join(rest.select("node", "component").distinct(), "node"))
    return few.unionByName(_repeating_pairs(open_, _with_least(differing), classes)).unionByName(_crowd_pairs(open_.where("plain")))


def _bucket_pairs(held: DataFrame, never: Column) -> DataFrame:
    """Pairs (a, b) of a bucket in different components, but those that ``never`` tells of."""
    a, b = held.alias("a"), held.alias("b")
    open_ = (F.col("a.node") < F.col("b.node")) & (F.col("a.component") != F.col("b.component")) & ~never
    return a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & open_).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))


def _repeating_pairs(texts: DataFrame, least: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of a crowd, one of them with repeated shingles, in different components, that may be similar.

    Take the shingles outside the consensus, rarest first.  What precedes the first that two texts have
    in common is weight that the other lacks, for either of them; so are the shingles that no other text
    has.  If those shares are too large, the two are not similar (see :func:`_odds`).  J is also the
    probability that two draws agree whose laws are the shares of weight in either text, and so at most
    1 - |difference| for the shares of any one shingle: that of the shared one must be small.

    Texts that share none of those lack all that the other has outside the consensus.  If they may be
    similar still, both may be similar to the text that deviates least, and have been compared with
    it; one at least is not in its component.  Only such texts are compared further.
    """
    flat = texts.select("node", "crowd", "component", "n", "plain", "u", F.inline(F.arrays_zip("outside", "weights"))).withColumnRenamed("outside", "item")
    often = flat.groupBy("crowd", "item").agg(F.count("*").alias("c")).where("c > 1")
    rarer = Window.partitionBy("node").orderBy("c", "item").rowsBetween(Window.unboundedPreceding, -1)
    before = (F.col("u") + F.coalesce(F.sum("weights").over(rarer), F.lit(0))) / F.col("n")
    placed = flat.join(often, ["crowd", "item"]).select("node", "crowd", "component", "plain", "item", (F.col("weights") / F.col("n")).alias("share"), _odds(before).alias("odds"))
    placed = durable(placed.where(F.col("odds") <= ODDS))

    def pairs(a: DataFrame, b: DataFrame, which: Column) -> DataFrame:
        open_ = (F.col("a.crowd") == F.col("b.crowd")) & (F.col("a.component") != F.col("b.component")) & ~(F.col("a.plain") & F.col("b.plain")) & (F.col("a.odds") + F.col("b.odds") <= ODDS)
        return a.alias("a").join(b.alias("b"), open_ & which).select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b"))

    shared = pairs(placed, placed, (F.col("a.item") == F.col("b.item")) & (F.col("a.node") < F.col("b.node")) & (F.abs(F.col("a.share") - F.col("b.share")) <= 1 - THRESHOLD + 1e-6))
    whole = texts.select("node", "crowd", "component", "plain", _odds(F.col("away")).alias("odds"))
    home = classes.select(F.col("node").alias("m_node"), F.col("component").alias("m_component"))
    least = durable(least.select("node", F.col("m.node").alias("m_node")))
    heads = durable(least.select("m_node").distinct().join(home, "m_node", "left"))  # a row a crowd
    near = whole.join(least, "node").join(small(heads), "m_node")
    apart = near.where(F.col("component") != F.coalesce("m_component", "m_node"))
    return shared.unionByName(pairs(durable(apart.select(whole.columns)), whole, F.lit(True)))


def _crowd_pairs(texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of plain texts of a crowd, in different components, whose deviations have enough in common.

    |x ^ y| <= room(x) + room(y) asks for o = (|D(x)| + |D(y)| - room(x) - room(y)) / 2 common
    deviations or more.  In one order of deviations, rarest first, the first common one is then among
    the first |D| - o + 1 of either.  Pairs with o <= 0 are known from :func:`_deviating_least`.
    """
    placed = texts.select("node", "crowd", "component", "d", (F.col("d") - _room(F.col("n"))).alias("over"), F.posexplode("deviations").alias("at", "item"))
    a, b = placed.alias("a"), placed.alias("b")
    common = F.greatest(F.ceil((F.col("a.over") + F.col("b.over")) / 2 - 1e-6), F.lit(1))
    met = (F.col("a.crowd") == F.col("b.crowd")) & (F.col("a.item") == F.col("b.item")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.component") != F.col("b.component"))
    early = (F.col("a.at") <= F.col("a.d") - common) & (F.col("b.at") <= F.col("b.d") - common)
    return a.join(b, met & early).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each class, the first, with the columns of ``docs``; of rows equal in id and text one."""
    first = _classes(docs, "doc_id", "text").where("row = head.row").select("doc_id", "k1", "k2").toDF("_id", "_k1", "_k2")
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    k1, k2 = _keys(body)
    held = docs.withColumns({"_a": k1, "_b": k2}).join(durable(first), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_a") == F.col("_k1")) & (F.col("_b") == F.col("_k2")))
    return held.dropDuplicates(["doc_id", "_a", "_b"]).select(docs.columns)
