"""SentencePiece encoding and decoding, with giant documents encoded in chunks.

A model file is one of two kinds, and each has its own law.

*Unigram*: the encoding is the best path, the maximum of summed piece scores.  A document longer
than CHUNK characters is cut into chunks.  A piece that begins in one chunk may end up to
``width - 1`` characters inside the next; that overhang is the boundary state.  Each chunk yields a
matrix: best score from each overhang it may receive to each it may pass on.  The matrices of a
document are multiplied in (max, +) up a tree, which then fixes the state at each boundary downwards,
and every chunk is backtraced on its own.  Of paths with equal scores either may be found.  That
holds for files that take the text as it is (no normalisation, a space in front, white space kept) and
spell unknown characters in bytes; other unigram files are left to the library, text by text.

*BPE*: the encoding is the order of merges, not a best path, so the (max, +) product gives other
ids than the library's.  There the boundary state is trivial instead: where no piece of the
vocabulary holds a space after another character, no merge crosses from such a character to a
space, so chunks are cut there and encoded on their own by the library.  A character that no
piece holds (a line break, say) separates in the same way.  If a vocabulary has neither property,
texts are encoded whole.

Decoding joins the pieces; bytes that stand for unknown characters are put together again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 1 << 16
#: Encoded stretches that a worker remembers; the store is emptied when full.
REMEMBERED = 200_000
SPACE = "▁"
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a serialized protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind)
            n = varint() if n is None else n
            yield key >> 3, data[at : at + n]
            at += n


def model_kind(data: bytes) -> int:
    """UNIGRAM, BPE or another number of the format's ModelType; UNIGRAM where it is not said."""
    for number, value in _fields(data):
        if number == 2:
            return next((v for n, v in _fields(value) if n == 3), UNIGRAM)
    return UNIGRAM


@dataclass
class Codec:
    """A model file's contents; the vocabulary is read on first use, in each process."""

    model: bytes
    _own: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"model": self.model, "_own": {}}

    @property
    def library(self):
        if "sp" not in self._own:
            import sentencepiece

            self._own["sp"] = sp = sentencepiece.SentencePieceProcessor(model_proto=self.model)
            self._own["pieces"] = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
            self._own["bytes"] = {i: int(sp.id_to_piece(i)[1:-1], 16) for i in range(sp.get_piece_size()) if sp.is_byte(i)}
            plain = [p for i, p in enumerate(self._own["pieces"]) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
            self._own["spaces_first"] = not any(SPACE in p.lstrip(SPACE) for p in plain)
            self._own["no_breaks"] = not any("\n" in p for p in plain)
            self._own["memory"] = {}
        return self._own["sp"]

    @property
    def scannable(self) -> bool:
        """Whether the encoding is the best path over the text as it is: see the module."""
        sp = self.library
        plain = ["a  b", " A\u00e9", "e\u0301 \ufb01\u00a0x\t", "\n"]
        exact = all(sp.decode(sp.encode(x)) == x for x in plain) and sp.encode("a")[:1] != sp.encode("\na")[-1:]
        return model_kind(self.model) == UNIGRAM and len(self._own["bytes"]) == 256 and exact

    @property
    def separable(self) -> bool:
        """Whether texts may be cut before a space that follows another character, and around line breaks."""
        # A model that adds no space, or normalizes, is left to the library whole.
        sp = self.library
        exact = sp.encode("a  b") == sp.encode("a") + sp.encode(" b") and sp.decode(sp.encode(" a  b ")) == " a  b "
        return model_kind(self.model) == BPE and self._own["spaces_first"] and self._own["no_breaks"] and exact

    def encode(self, text: str) -> np.ndarray:
        """The library's ids of the text; by stretches between separators where that is the same."""
        sp = self.library
        if "separable" not in self._own:
            self._own["separable"] = self.separable
        if not text:
            return np.zeros(0, np.int32)
        if not self._own["separable"]:
            return np.array(sp.encode(text), np.int32)
        return self._stretches(" " + text.replace(SPACE, " "))

    def encode_rest(self, text: str) -> np.ndarray:
        """Ids of a chunk that begins with the space at which a text was cut."""
        return self._stretches(text.replace(SPACE, " ")) if text else np.zeros(0, np.int32)

    def _stretches(self, text: str) -> np.ndarray:
        sp, memory = self.library, self._own["memory"]
        out = []
        for part in _STRETCH.findall(text):
            ids = memory.get(part)
            if ids is None:
                if len(memory) >= REMEMBERED:
                    memory.clear()
                # The library puts a space in front: give it the stretch without its own first one, or
                # behind a line break, which stands alone, so that its two ids can be taken off.
                ids = sp.encode(part[1:]) if part[0] == " " and len(part) > 1 else sp.encode("\n" + part)[2:]
                if len(part) < 64:
                    memory[part] = ids
            out += ids
        return np.array(out, np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; the space that encoding puts in front is taken off."""
        _ = self.library
        pieces, raw = self._own["pieces"], self._own["bytes"]
        out, pending = [], bytearray()
        for i in ids:
            if i in raw:
                pending.append(raw[i])
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending = bytearray()
            out.append(pieces[i])
        if pending:
            out.append(pending.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ").removeprefix(" ")


#: A line break; spaces and what follows up to the next separator; spaces at the end.
_STRETCH = re.compile(r"\n| *[^ \n]+| +")


def _read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, ids, n_tokens, round_trip`` for every row of ``docs``.

    ``round_trip``: the decoded ids are the text.  It is false for texts that hold U+2581, which the
    format takes for a space.  Null and empty texts have no ids, and null decodes to the empty
    text.  Texts longer than ``chunk`` are encoded chunk by chunk in different tasks and put
    together again; repeated rows are encoded each.  Other columns are ignored.
    """
    data = docs.sparkSession.sparkContext.broadcast(_read(path))  # the model file, about 500 KB
    codec = Codec(data.value)
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    if codec.scannable:
        from evenkeel.llm.maxplus import unigram_encode

        return unigram_encode(source, codec, chunk)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codec(data.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column("text").to_pylist()
                ids = [own.encode(x) for x in texts]
                yield _rows([part.column("doc_id")], ["doc_id"], ids, [own.decode(i.tolist()) == x for i, x in zip(ids, texts)])

    if not codec.separable:
        return source.mapInArrow(whole, f"doc_id {kind}, ids array<int>, n_tokens long, round_trip boolean")
    short = source.where(F.length("text") <= chunk).mapInArrow(whole, f"doc_id {kind}, ids array<int>, n_tokens long, round_trip boolean")
    return short.unionByName(_giants(source.where(F.length("text") > chunk), data, kind, chunk))


def _rows(columns: list, names: list[str], ids: list[np.ndarray], same: list[bool]) -> pa.RecordBatch:
    n = np.array([len(i) for i in ids], np.int64)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(flat, pa.int32()))
    return pa.RecordBatch.from_arrays([*columns, lists, pa.array(n), pa.array(same, pa.bool_())], names=[*names, "ids", "n_tokens", "round_trip"])


def _giants(source: DataFrame, data, kind: str, chunk: int) -> DataFrame:
    """Documents of several chunks.  Chunks end before a space; a stretch without one stays together."""
    numbered = source.withColumn("row", F.monotonically_increasing_id())
    cut = f"(?s).{{{chunk}}}[ {SPACE}]*[^ {SPACE}]*|.+"
    parts = numbered.select("row", "doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(cut), F.lit(0))).alias("part", "text"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codec(data.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                some = batch.slice(at, 16)
                texts, numbers = some.column("text").to_pylist(), some.column("part").to_pylist()
                ids = [own.encode(x) if k == 0 else own.encode_rest(x) for k, x in zip(numbers, texts)]
                # a later chunk's first space is its own: put it back before comparing
                same = [(own.decode(i.tolist()) if k == 0 else " " + own.decode(i.tolist())) == x for k, i, x in zip(numbers, ids, texts)]
                yield _rows([some.column(c) for c in ("row", "doc_id", "part")], ["row", "doc_id", "part"], ids, same)

    encoded = parts.repartition(F.col("row"), F.col("part")).mapInArrow(pieces, f"row long, doc_id {kind}, part int, ids array<int>, n_tokens long, round_trip boolean")
    return (
        encoded.groupBy("row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("p"),
            F.sum("n_tokens").alias("n_tokens"),
            F.min("round_trip").alias("round_trip"),
        )
        .select("doc_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), "n_tokens", "round_trip")
    )
