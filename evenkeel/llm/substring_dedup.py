"""Repeated passages: sliding runs of sentences, hashed, joined over all documents, and cut out.

A text is divided into sentences, which end at ``.``, ``!`` or ``?`` before white space, or at a line
break.  Sentences are divided further where the words say so: after every word whose hash is 0 modulo
CUT, and only where none comes for UNIT_WORDS words after UNIT_WORDS words.  So copies of a passage
are divided alike from the first such word or sentence end on, wherever the passage begins.

A run is RUN consecutive units, or as many more as it takes to have RUN_WORDS words: the shortest such
from every unit on, and the shortest up to every unit, are hashed (two 64-bit hashes of the words,
white space apart; 80 bits of them are compared).  Of a run that occurs more than once, anywhere, the first occurrence by (doc_id,
text, place) stays; words covered by any other occurrence of any run are removed.  A passage of more
than 50 words that begins with a sentence and ends with one is so removed whole from all but its first
place, however short its sentences; of one that begins or ends inside a sentence, the words before
its first cut and after its last stay, CUT each on average at most.

Runs are made once, in Arrow batches.  Of the occurrences of a run inside a batch only the first can be
the first of all, so only that one is sent to where the run's hash is; the others are known to go.  A
passage in a third of all documents is thus one entry a batch there.  Entries travel in arrays, a row
for each batch and bucket of hashes, as rows of their own would take twice the room; a task compares
one bucket at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm import scan
from evenkeel.llm.common import durable

RUN, RUN_WORDS, UNIT_WORDS, CUT = 3, 15, 12, 8
#: Runs gathered in a task before their repeats are told apart.
GATHERED = 2_000_000
#: A place is the run's first word times this, plus its number of words (RUN_WORDS units of UNIT_WORDS words at most).
_WIDTH = 256
#: Bits of the text's hash, and of a run's second hash, that travel with it.
_KEY, _SECOND = 32, 16
#: Buckets of hashes for each shuffle partition.
BUCKETS = 8
_BREAKS = np.isin(np.arange(256), [0x0A, 0x0B, 0x0C, 0x0D])
_STOPS = np.isin(np.arange(256), list(b".!?"))
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def unit_edges(data: np.ndarray, doc: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of the words that units begin with, and at last the number of words."""
    if not len(doc):
        return np.zeros(1, np.int64)
    breaks = np.flatnonzero(_BREAKS[data])
    line = np.searchsorted(breaks, ends[:-1]) < np.searchsorted(breaks, starts[1:])
    cut = (hashes % np.uint64(CUT) == 0) | _STOPS[data[ends - 1]]
    cut |= np.append(line | (doc[1:] != doc[:-1]), True)
    stop = np.flatnonzero(cut) + 1
    begin = np.append(0, stop[:-1])
    parts = -(-(stop - begin) // UNIT_WORDS)
    number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.append(np.repeat(begin, parts) + UNIT_WORDS * number, len(doc))


def runs(doc: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word, and the word after the last, of every run."""
    if len(edges) == 1:
        return edges[:0], edges[:0]
    n = len(edges) - 1
    own = doc[edges[:-1]]
    new = np.append(True, own[1:] != own[:-1])
    low = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # each unit's document begins with this unit
    begins = np.flatnonzero(new)
    high = np.append(begins[1:], n)[np.cumsum(new) - 1]  # and ends before this one
    i = np.arange(n)
    j = np.maximum(i + RUN, np.searchsorted(edges, edges[:-1] + RUN_WORDS))
    k = np.minimum(i + 1 - RUN, np.searchsorted(edges, edges[1:] - RUN_WORDS, "right") - 1)
    onward, back = j <= high, k >= low
    pairs = np.unique(np.concatenate([i[onward] * _WIDTH + (j - i)[onward], k[back] * _WIDTH + (i + 1 - k)[back]]))
    first, size = pairs // _WIDTH, pairs % _WIDTH
    return edges[first], edges[first + size]


def run_hashes(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Two hashes (64 and _SECOND bits) of the words of each run: polynomials from prefix sums, shifted back to the run's first word."""
    out = []
    with np.errstate(over="ignore"):
        power, back = (np.cumprod(np.append(np.uint64(1), np.full(len(words), b, np.uint64))) for b in (_BASE, _BACK))
        for salt in (0, 0xA24BAED4963EE407):
            values = scan.mix(words ^ np.uint64(salt)) * power[:-1]
            prefix = np.append(np.uint64(0), np.cumsum(values))
            out.append(scan.mix((prefix[end] - prefix[begin]) * back[begin] + (end - begin).astype(np.uint64)).view(np.int64))
    return [out[0], out[1] >> (64 - _SECOND)]


def _ranks(ids: pa.Array, keys: pa.Array) -> np.ndarray:
    """Numbers of rows in the order of (id, key), null ids last; equal for equal rows."""
    code = pc.dictionary_encode(ids, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    order = pc.sort_indices(pa.table({"i": ids, "k": keys}), sort_keys=[("i", "ascending"), ("k", "ascending")], null_placement="at_end").to_numpy()
    c, k = code[order], keys.to_numpy()[order]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(np.append(0, (c[1:] != c[:-1]) | (k[1:] != k[:-1])))[: len(order)]
    return rank


def _told_apart(row: np.ndarray, rank: np.ndarray, place: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of gathered runs: which to send on, and which of those are known to be no first occurrence."""
    order = np.argsort(h1, kind="stable")
    h = h1[order]
    twin = np.append(False, h[1:] == h[:-1])
    twin[:-1] |= twin[1:]
    alone, some = order[~twin], order[twin]
    some = some[np.lexsort((place[some], rank[row[some]], h2[some], h1[some]))]
    if not len(some):
        return alone, np.zeros(len(alone), bool)
    first = np.append(True, (h1[some][1:] != h1[some][:-1]) | (h2[some][1:] != h2[some][:-1]))
    # a row that occurs twice has each of its runs once
    fresh = first | np.append(True, (rank[row[some]][1:] != rank[row[some]][:-1]) | (place[some][1:] != place[some][:-1]))
    return np.concatenate([alone, some[fresh]]), np.concatenate([np.zeros(len(alone), bool), ~first[fresh]])


def _runs(batches: Iterator[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = scan.buffers(batch.column("text"))
        rank, texts, gathered, count = _ranks(batch.column("doc_id"), batch.column("key")), batch.column("key").to_numpy(), [], 0
        ranges = list(scan.portions(at))
        for a, b in ranges:
            part = data[at[a] : at[b]]
            doc, hashes, starts, ends = scan.hashed_words(part, at[a : b + 1] - at[a])
            begin, end = runs(doc, unit_edges(part, doc, hashes, starts, ends))
            if len(begin):
                first = np.searchsorted(doc, np.arange(b - a))  # each text's first word
                gathered.append((a + doc[begin], (begin - first[doc[begin]]) * _WIDTH + (end - begin), *run_hashes(hashes, begin, end)))
                count += len(begin)
            if gathered and (count >= GATHERED or b == ranges[-1][1]):
                row, place, h1, h2 = map(np.concatenate, zip(*gathered))
                sent, again = _told_apart(row, rank, place, h1, h2)
                yield _packed(batch.column("doc_id"), texts, row[sent], np.where(again, ~place[sent], place[sent]), h1[sent], h2[sent], again, n_buckets)
                gathered, count = [], 0


def _packed(ids: pa.Array, texts: np.ndarray, row: np.ndarray, place: np.ndarray, h1: np.ndarray, h2: np.ndarray, again: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    """A row for each bucket that has entries.  Those known to go are dealt out evenly."""
    bucket = np.where(again, scan.mix(np.arange(len(row), dtype=np.uint64)), h1.view(np.uint64)) % np.uint64(n_buckets)
    order = np.argsort(bucket, kind="stable")
    count = np.bincount(bucket.astype(np.int64), minlength=n_buckets)
    some = np.flatnonzero(count)
    at = pa.array(np.append(0, np.cumsum(count[some])).astype(np.int32))
    row = row[order]
    parts = [ids.take(pa.array(row)), *map(pa.array, (texts[row].astype(np.uint32).view(np.int32), place[order], h1[order], h2[order].astype(np.int16)))]
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.ListArray.from_arrays(at, x) for x in parts)], names=["bucket", "ids", "keys", "places", "h1", "h2"])


def _not_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, key, place`` of the entries that go, from rows in the order of their buckets."""
    own: list[list] = []

    def told() -> pa.RecordBatch:
        ids = pa.concat_arrays([x[0] for x in own])
        keys, place, h1, h2 = (np.concatenate([x[k].to_numpy() for x in own]) for k in range(1, 5))
        keys = keys.view(np.uint32).astype(np.int64)
        gone = place < 0
        place = np.where(gone, ~place, place)
        order = np.argsort(h1, kind="stable")
        order = order[~gone[order]]
        twin = np.append(False, h1[order][1:] == h1[order][:-1])[: len(order)]
        twin[:-1] |= twin[1:]
        some = order[twin]
        rank = _ranks(ids.take(pa.array(some)), pa.array(keys[some]))
        inner = np.lexsort((place[some], rank, h2[some], h1[some]))
        some, rank = some[inner], rank[inner]
        new = np.append(True, (h1[some][1:] != h1[some][:-1]) | (h2[some][1:] != h2[some][:-1]))[: len(some)]
        first = np.flatnonzero(new)[np.cumsum(new) - 1]  # where each one's group begins
        gone[some[(rank != rank[first]) | (place[some] != place[some][first])]] = True
        at = np.flatnonzero(gone)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(keys[at]), pa.array(place[at])], names=["doc_id", "key", "place"])

    bucket = None
    for batch in batches:
        lists = [(batch.column(c).offsets.to_numpy(), batch.column(c).values) for c in ("ids", "keys", "places", "h1", "h2")]
        for k, b in enumerate(batch.column("bucket").to_numpy()):
            if own and b != bucket:
                yield told()
                own = []
            bucket = b
            own.append([values.slice(at[k], at[k + 1] - at[k]) for at, values in lists])
    if own:
        yield told()


def _key(text: Column) -> Column:
    """32 bits of the text's hash: what tells apart rows that share an id."""
    return F.xxhash64(text).bitwiseAND(F.lit((1 << _KEY) - 1))


def repeated_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, key, places`` of texts with runs to remove; a place is the run's first word times 256, plus how many it has."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    n = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = docs.where("text is not null").mapInArrow(lambda x: _runs(x, n), f"bucket int, ids array<{kind}>, keys array<int>, places array<long>, h1 array<long>, h2 array<smallint>")
    gone = found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_not_first, f"doc_id {kind}, key long, place long")
    return gone.groupBy("doc_id", "key").agg(F.collect_list("place").alias("places"))


def cut_out(text: str, places: np.ndarray) -> tuple[str, int]:
    """The text less the words of the runs, with the white space behind them; and how many words that were."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    starts, _ = scan.word_places(data, np.array([0, len(data)]))
    change = np.zeros(len(starts) + 1, np.int64)
    begin = places // _WIDTH
    np.add.at(change, begin, 1)
    np.add.at(change, begin + places % _WIDTH, -1)
    gone = np.cumsum(change[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
    stops = np.append(starts, len(data))
    stops[0] = 0  # white space before the first word belongs to it
    kept, at = [], 0
    for a, b in zip(edge[::2], edge[1::2]):
        kept.append(raw[at : stops[a]])
        at = stops[b]
    return (b"".join(kept) + raw[at:]).decode(), int(gone.sum())


def dedup_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the text less its repeated passages, and ``n_removed`` (int), how many words those had.

    Every row stays; a text that is repeated whole becomes empty.  Null, empty and blank texts are
    left as they are.  A document is an id and a text: rows that share an id but not a text are
    different documents, rows that share both are one, and none of them is a repeat of another.  Null
    ids come last.  A column of the name ``n_removed`` is replaced.
    """
    body = F.col(f"`{text}`").cast("string")
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), body.alias("text"), _key(body).alias("key"))
    gone = durable(repeated_runs(source)).toDF("_id", "_key", "_places")

    @F.pandas_udf("text string, n int")
    def cut(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, 0) if x is None else cut_out(x, np.asarray(p, np.int64)) for x, p in zip(texts, places)], columns=["text", "n"])

    # texts with repeats grow with the corpus, so this join is by shuffling at every size
    held = docs.withColumn("_own", _key(body)).join(gone, F.col(f"`{doc_id}`").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_key")), "left")
    touched = F.col("_places").isNotNull()
    held = held.withColumn("_cut", cut(F.when(touched, body), F.col("_places")))
    kept = F.when(touched, F.col("_cut.text")).otherwise(F.col(f"`{text}`"))
    return held.withColumns({"n_removed": F.when(touched, F.col("_cut.n")).otherwise(F.lit(0)), text: kept}).drop("_own", "_id", "_key", "_places", "_cut")
