"""Best-path (unigram) encoding as a parallel scan over the (max, +) semiring.

See :mod:`evenkeel.llm.sentencepiece_codec` for the boundary states.  A chunk of n characters is
read with the ``width - 1`` characters that follow it, so that it knows the pieces which begin
inside and end behind it.  ``transfer`` gives its matrix, ``compose`` multiplies two, and ``trace``
walks back through one chunk once both its boundary states are known.

The scan goes up and down a tree with FAN children a node.  Upwards a node's matrix is the product of
its children's; the product is associative, so nodes of one level are independent.  Downwards a node
knows the states at its two ends, and ``states`` gives those between its children.  No task holds
more than FAN matrices of a document, however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import durable

#: Children of a node of the tree.
FAN = 32
#: What a character outside the vocabulary scores below the worst piece, as the library has it.
UNKNOWN_PENALTY = 10.0


class Vocabulary:
    """Pieces with scores and ids; single characters that no piece covers get the unknown id, or the ids of their bytes."""

    def __init__(self, pieces: dict[str, tuple[int, float]], unknown: int, bytes_: dict[int, int] | None = None):
        self.pieces, self.unknown, self.bytes = pieces, unknown, bytes_ or {}
        self.width = max(map(len, pieces), default=1)
        self.floor = min((s for _, s in pieces.values()), default=0.0) - UNKNOWN_PENALTY

    @classmethod
    def of(cls, codec) -> Vocabulary:
        sp = codec.library
        every = range(sp.get_piece_size())
        usable = (i for i in every if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)))
        return cls({sp.id_to_piece(i): (i, sp.get_score(i)) for i in usable}, sp.unk_id(), {int(sp.id_to_piece(i)[1:-1], 16): i for i in every if sp.is_byte(i)})

    def ids(self, piece: int, char: str) -> list[int]:
        """What a piece of a path stands for in the encoding; ``char`` is the character where it begins."""
        return [self.bytes[b] for b in char.encode()] if piece == self.unknown and self.bytes else [piece]

    def from_place(self, text: str, at: int) -> Iterator[tuple[int, int, float]]:
        """(end, id, score) of the pieces that begin at a place of the text; one character at least."""
        for end in range(at + 1, min(len(text), at + self.width) + 1):
            found = self.pieces.get(text[at:end])
            if found:
                yield end, *found
            elif end == at + 1:
                yield end, self.unknown, self.floor


def _forward(text: str, n: int, vocab: Vocabulary, entries: list[int], links: bool):
    """Best scores from each entry overhang to each place up to n + width - 1, and the last pieces."""
    w = vocab.width
    best = np.full((n + w, len(entries)), -np.inf)
    back = np.full((n + w, len(entries), 2), -1, np.int64) if links else None
    for k, e in enumerate(entries):
        if e < n + w:
            best[e, k] = 0.0
    for at in range(n):
        row = best[at]
        if not np.isfinite(row).any():
            continue
        for end, piece, score in vocab.from_place(text, at):
            new = row + score
            better = new > best[end]  # equal scores: the earlier beginning stays
            best[end][better] = new[better]
            if links:
                back[end, better] = (at, piece)
    return best, back


def transfer(text: str, n: int, vocab: Vocabulary) -> np.ndarray:
    """Matrix of a chunk: ``text`` holds its n characters and those that follow, up to width - 1."""
    w = vocab.width
    best, _ = _forward(text, n, vocab, list(range(w)), False)
    return best[n : n + w].T


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (max, +) product: first a, then b."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def states(matrices: list[np.ndarray], entry: int = 0, leave: int = 0) -> list[int]:
    """The overhang at each boundary of neighbouring matrices, first and last included, between two known ones.

    Prefix products give the best score into each state; walking back, each matrix then gives the best
    state in front of it.
    """
    into = [np.where(np.arange(matrices[0].shape[0]) == entry, 0.0, -np.inf)]
    for m in matrices[:-1]:
        into.append((into[-1][:, None] + m).max(axis=0))
    chosen = [leave]
    for m, before in zip(reversed(matrices), reversed(into)):
        # with the state behind fixed, the best state in front
        chosen.append(int(np.argmax(before + m[:, chosen[-1]])))
    return chosen[::-1]


def trace(text: str, n: int, vocab: Vocabulary, entry: int, leave: int) -> list[int]:
    """Ids of the pieces that begin inside the chunk, for its two boundary states."""
    _, back = _forward(text, n, vocab, [entry], True)
    at, ids = n + leave, []
    while at > entry:
        start, piece = back[at, 0]
        if start < 0:
            break
        ids.append(vocab.ids(int(piece), text[start]))
        at = int(start)
    return [i for part in reversed(ids) for i in part]


def best_path(text: str, vocab: Vocabulary) -> list[int]:
    """The encoding of a text in one go."""
    return trace(text, len(text), vocab, 0, 0) if text else []


def chunks(text: str, size: int, width: int) -> list[tuple[int, str, int]]:
    """(number, characters with those that follow, own length) of each chunk."""
    return [(i, text[a : a + size + width - 1], len(text[a : a + size])) for i, a in enumerate(range(0, len(text), size))]


def _tree(leaves: DataFrame, width: int) -> list[DataFrame]:
    """``row, part, m`` of each level, from the chunks up to one node a document."""

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        ms = [np.array(m).reshape(width, width) for m in pdf.sort_values("part").m]
        return pd.DataFrame({"row": pdf.row[:1], "part": pdf.part[:1] // FAN, "m": [reduce(compose, ms).ravel()]})

    levels = [durable(leaves)]
    while (levels[-1].agg(F.max("part")).first()[0] or 0) > 0:
        up = levels[-1].withColumn("node", F.floor(F.col("part") / FAN)).groupBy("row", "node").applyInPandas(product, "row long, part int, m array<double>")
        levels.append(durable(up))
    return levels


def _ends(levels: list[DataFrame], width: int) -> DataFrame:
    """``row, part, entry, leave`` of the chunks, from the top of the tree down; a document begins and ends without overhang."""

    def between(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        at = states([np.array(m).reshape(width, width) for m in pdf.m], int(pdf.entry.iloc[0]), int(pdf.leave.iloc[0]))
        return pd.DataFrame({"row": pdf.row, "part": pdf.part, "entry": at[:-1], "leave": at[1:]})

    known = levels[-1].select("row", "part", F.lit(0).alias("entry"), F.lit(0).alias("leave"))
    for level in reversed(levels[:-1]):
        below = level.withColumn("node", F.floor(F.col("part") / FAN).cast("int")).join(known.withColumnRenamed("part", "node"), ["row", "node"])
        known = below.groupBy("row", "node").applyInPandas(between, "row long, part int, entry int, leave int")
    return known


def unigram_encode(source: DataFrame, codec, chunk: int) -> DataFrame:
    """``doc_id, ids, n_tokens, round_trip`` of ``doc_id, text`` by the best path, chunk by chunk."""
    data = source.sparkSession.sparkContext.broadcast(codec.model)
    kind = source.schema["doc_id"].dataType.simpleString()
    width = Vocabulary.of(codec).width
    chunk = max(chunk, width)
    spaced = F.concat(F.lit("▁"), F.translate("text", " ", "▁"))
    numbered = durable(source.withColumn("row", F.monotonically_increasing_id()))
    text = numbered.where(F.length("text") > 0).withColumn("text", spaced)

    cut = F.expr(f"transform(sequence(0, cast((length(text) - 1) div {chunk} as int)), i -> struct(i as part, substring(text, i * {chunk} + 1, {chunk + width - 1}) as text, least({chunk}, length(text) - i * {chunk}) as n))")
    parts = text.select("row", F.inline(cut)).repartition("row", "part")

    def vocabulary() -> Vocabulary:
        from evenkeel.llm.sentencepiece_codec import Codec

        return Vocabulary.of(Codec(data.value))

    def matrices(batches):
        vocab = vocabulary()
        for pdf in batches:
            m = [transfer(t, n, vocab).ravel() for t, n in zip(pdf.text, pdf.n)]
            yield pd.DataFrame({"row": pdf.row, "part": pdf.part, "m": m})

    def traced(batches):
        vocab = vocabulary()
        for pdf in batches:
            ids = [trace(t, n, vocab, e, x) for t, n, e, x in zip(pdf.text, pdf.n, pdf.entry, pdf.leave)]
            yield pd.DataFrame({"row": pdf.row, "part": pdf.part, "ids": ids})

    # A chunk's matrix has width x width numbers.
    at = _ends(_tree(parts.mapInPandas(matrices, "row long, part int, m array<double>"), width), width)
    found = parts.join(at, ["row", "part"]).mapInPandas(traced, "row long, part int, ids array<int>")
    joined = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("p"))
    ids = joined.select("row", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from evenkeel.llm.sentencepiece_codec import Codec

        own = Codec(data.value)
        for batch in batches:
            same = [own.decode(i or []) == t for i, t in zip(batch.column("ids").to_pylist(), batch.column("text").to_pylist())]
            n = pa.array([len(i or []) for i in batch.column("ids").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), n, pa.array(same)], names=["doc_id", "ids", "n_tokens", "round_trip"])

    whole = numbered.join(ids, "row", "left").select("doc_id", "text", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return whole.mapInArrow(decoded, f"doc_id {kind}, ids array<int>, n_tokens long, round_trip boolean")
