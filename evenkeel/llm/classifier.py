"""A quality classifier: random-indexing word vectors, pooled per document, and a small network.

*Vectors.*  Words are hashed to WORDS ids; beside its word every token has a mark (one of MARKS ids:
its length class, letter case, symbols, and whether it repeats what came before in the text).  Every
id has a sparse random index vector.  A context vector is the sum of the index vectors of the ids up
to REACH tokens away, over all documents; each task adds up its own sums, and these are added by id,
so what is gathered is WORDS + MARKS vectors, whatever the size of the corpus.

*Network.*  A document is the mean vector of its words, the mean vector of its marks, and its length.
Two numpy layers turn that into a probability, fitted on at most MAX_LABELLED labelled documents; a
temperature, fitted on part of them that the weights never saw, calibrates it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm import scan
from evenkeel.llm.common import labelled_texts

WORDS, MARKS, DIMS, REACH = 1 << 14, 1 << 11, 32, 2
#: Labelled documents that the network is fitted on, at most: those with the least hash of their id.
MAX_LABELLED = 20_000
PREDICTED_FROM = 0.7
#: Labelled documents, of both kinds together, below which no weights are fitted.
LEAST_LABELLED = 20
#: Bytes of text handled at a time.
PORTION = 2 << 20


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents whose labels are never learned from: crc32 of the id as text is 2 modulo 4."""
    return F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))) % 4 == 2


def _flags(chars: str) -> np.ndarray:
    table = np.zeros(256, np.uint64)
    table[[ord(c) for c in chars]] = 1
    return table


#: For each byte: symbols, exclamation marks, capitals, digits, counted in 16 bits each.
_KINDS = _flags("#*$%&|<>") | _flags("!") << np.uint64(16) | _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ") << np.uint64(32) | _flags("0123456789") << np.uint64(48)
_STOPS = _flags(".,;:?").astype(bool)
_LENGTHS = np.array([2, 3, 5, 8, 12])


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every word: its text's index, its word id (below WORDS) and its mark id (WORDS and above)."""
    doc, hashes, starts, ends = scan.hashed_words(data, at)
    if not len(doc):
        return doc, doc, doc
    kinds = scan.sums(data, starts, ends, _KINDS, False)
    field = lambda k: (kinds >> np.uint64(16 * k)) & np.uint64(0xFFFF)
    same = np.append(False, (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1]))
    mark = np.searchsorted(_LENGTHS, ends - starts, "right")
    for part, size in ((field(0) > 0, 2), (field(1) > 0, 2), (np.minimum(field(2), 2), 3), (field(3) > 0, 2), (_STOPS[data[ends - 1]], 2), (same, 2), (_again(doc, hashes), 2)):
        mark = mark * size + part.astype(np.int64)
    return doc, (hashes % np.uint64(WORDS)).astype(np.int64), WORDS + mark


def _again(doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the three words that begin here occur again, earlier or later, in the same text."""
    runs_doc, runs = scan.shingles(doc, hashes, 3)
    out = np.zeros(len(doc), bool)
    if not len(runs):
        return out
    keys = scan.mix(runs + runs_doc.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    twin = np.append(k[1:] == k[:-1], False) | np.append(False, k[1:] == k[:-1])
    left = np.append(np.flatnonzero(doc[1:] != doc[:-1]) + 1, len(doc))
    rest = left[np.searchsorted(left, np.arange(len(doc)), "right")] - np.arange(len(doc))
    first = np.append(True, doc[1:] != doc[:-1])
    n = np.repeat(rest[first], rest[first])
    begins = np.flatnonzero((rest >= 3) | (first & (n < 3)))
    out[begins[order[twin]]] = True
    return out


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Of every id: the place of its +1 and of its -1."""
    h = scan.mix(np.arange(1, WORDS + MARKS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    plus = (h % np.uint64(DIMS)).astype(np.int64)
    return plus, (plus + 1 + ((h >> np.uint64(32)) % np.uint64(DIMS - 1)).astype(np.int64)) % DIMS


def _add_contexts(sums: np.ndarray, doc: np.ndarray, ids: np.ndarray, index: tuple[np.ndarray, np.ndarray]) -> None:
    """Add to each id's sum the index vectors of its neighbours in the same text."""
    for step in range(1, REACH + 1):
        near = np.flatnonzero(doc[step:] == doc[:-step]) if len(doc) > step else np.zeros(0, np.int64)
        a, b = ids[near], ids[near + step]
        for one, other in ((a, b), (b, a)):
            for places, sign in zip(index, (1, -1)):
                sums += sign * np.bincount(one * DIMS + places[other], minlength=len(sums))


def context_vectors(docs: DataFrame) -> np.ndarray:
    """(WORDS + MARKS, DIMS) unit vectors from the contexts of all documents; zero for unseen ids."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, index = np.zeros((WORDS + MARKS) * DIMS, np.int64), _index_vectors()
        for batch in batches:
            data, at = scan.buffers(batch.column(0))
            for a, b in scan.portions(at, PORTION):
                doc, word, mark = tokens(data[at[a] : at[b]], at[a : b + 1] - at[a])
                _add_contexts(sums, doc, word, index)
                _add_contexts(sums, doc, mark, index)
        rows = sums.reshape(-1, DIMS)
        some = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(np.ascontiguousarray(rows[some, k])) for k in range(DIMS))], names=["id", *(f"c{k}" for k in range(DIMS))])

    schema = "id long, " + ", ".join(f"c{k} long" for k in range(DIMS))
    total = docs.select(F.col("text").cast("string")).mapInArrow(gather, schema).groupBy("id").agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in range(DIMS)))
    table = total.toArrow()  # WORDS + MARKS rows at most
    out = np.zeros((WORDS + MARKS, DIMS), np.float32)
    ids = table.column("id").to_numpy()
    raw = np.stack([table.column(f"c{k}").to_numpy() for k in range(DIMS)], axis=1).astype(float) if len(ids) else np.zeros((0, DIMS))
    out[ids] = raw / np.maximum(1e-9, np.linalg.norm(raw, axis=1, keepdims=True))
    return out


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """A row for each text: mean word vector, mean mark vector, log of its words; 0 for blank texts."""
    data, at = scan.buffers(texts)
    out = np.zeros((len(texts), 2 * DIMS + 1), np.float32)
    for a, b in scan.portions(at, PORTION):
        doc, word, mark = tokens(data[at[a] : at[b]], at[a : b + 1] - at[a])
        if not len(doc):
            continue
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        n = np.diff(np.append(first, len(doc)))[:, None]
        rows = a + doc[first]
        out[rows, :DIMS] = np.add.reduceat(vectors[word], first) / n
        out[rows, DIMS : 2 * DIMS] = np.add.reduceat(vectors[mark], first) / n
        out[rows, -1] = np.log1p(n[:, 0])
    return out


@dataclass
class Network:
    """Standardised input, a tanh layer, a logistic output divided by a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 7) -> Network:
    """Weights by Adam on four rows in five, the temperature on the fifth.

    Without both labels, or with fewer than LEAST_LABELLED rows, every input scores the share of 1s.
    """
    x, y = x.astype(float), y.astype(float)
    rng = np.random.default_rng(seed)
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    net = Network(mean, scale, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), np.zeros(hidden), 0.0)
    share = (y.sum() + 1) / (len(y) + 2)
    net.b2 = float(np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2 or len(y) < LEAST_LABELLED:
        return net
    held = np.arange(len(y)) % 5 == 0
    z, t = (x[~held] - mean) / scale, y[~held]
    params = [net.w1, net.b1, net.w2, np.array(net.b2)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(t))
        for k in range(0, len(order), 256):
            rows = order[k : k + 256]
            h = np.tanh(z[rows] @ params[0] + params[1])
            error = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40))) - t[rows]) / len(rows)
            back = np.outer(error, params[2]) * (1 - h * h)
            grads = [z[rows].T @ back + 1e-4 * params[0], back.sum(0), h.T @ error + 1e-4 * params[2], np.array(error.sum())]
            step += 1
            rate = 0.01 * (1 - epoch / epochs) + 1e-4
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                params[i] = params[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3])
    logits, t = net.logit(x[held]), y[held]

    def loss(temperature: float) -> float:
        a = logits / temperature
        return float(np.mean(np.logaddexp(0, a) - t * a))

    net.temperature = float(min(np.geomspace(0.25, 16, 121), key=loss))
    return net


def labelled(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """``text, quality`` of the labelled documents to learn from.  Repeated labels and rows count once (the least)."""
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    few = marks.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(limit)
    return labelled_texts(docs, few)


def score(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Null, empty and blank texts get the score of a document without words.  Without labels of both
    kinds, or with fewer than LEAST_LABELLED of them, every score is the share of labels 1 (smoothed; a
    half without any).  Other columns are no input.
    """
    vectors = docs.sparkSession.sparkContext.broadcast(context_vectors(docs))

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch.column("text"), vectors.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(list(x), pa.list_(pa.float32()))], names=["doc_id", "quality", "x"])

    sample = labelled(docs, labels, limit).select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), "text")
    rows = sorted(sample.mapInArrow(examples, "doc_id long, quality int, x array<float>").collect())  # `limit` rows
    x = np.array([r.x for r in rows], np.float32).reshape(len(rows), 2 * DIMS + 1)
    net = fit(x, np.array([r.quality for r in rows]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = net.score(pooled(batch.column("text"), vectors.value))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64())], names=["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    out = source.mapInArrow(scored, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= PREDICTED_FROM).cast("int"))
