"""Vectorised word scanning of Arrow string columns: words, their hashes, shingles.

Works in slices of bounded size cut at white space, so that a very long text costs 16 bytes a word,
not a multiple of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; a longer word makes a longer slice.
SLICE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two multiplications and three shifts)."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts on end, and where each begins and the last ends.  Null: no bytes."""
    texts = pa.array([], pa.large_string()) if len(texts) == 0 else texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_places(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and byte after the last of every word; words don't cross texts."""
    inside = ~_SPACE[data]
    if not inside.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = at[1:-1]
    edge = edge[edge < len(data)]
    first[edge] |= inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = edge[edge > 0] - 1
    last[edge] |= inside[edge]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _slices(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    k = 0
    while k < len(starts):
        stop = max(k + 1, int(np.searchsorted(ends, starts[k] + SLICE, "right")))
        yield k, stop
        k = stop


def sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray, by_place: bool) -> np.ndarray:
    """For each word the sum of its bytes' table entries, times a power of an odd base if ``by_place``."""
    out = np.zeros(len(starts), np.uint64)
    for a, b in _slices(starts, ends):
        s, n = starts[a:b] - starts[a], ends[a:b] - starts[a:b]
        values = table[data[starts[a] : ends[b - 1]]]
        span = np.diff(np.append(s, len(values)))  # up to the next word: the word and white space
        place = np.arange(len(values)) - np.repeat(s, span)
        with np.errstate(over="ignore"):
            if by_place:
                values = values * np.cumprod(np.full(int(place.max()) + 1, _BASE, np.uint64))[place]
            values[place >= np.repeat(n, span)] = 0
            out[a:b] = np.add.reduceat(values, s)
    return out


def hashed_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every word: its text's index, its 64-bit hash, its first byte and the byte after its last."""
    starts, ends = word_places(data, at)
    doc = np.searchsorted(at, starts, "right") - 1
    return doc, mix(sums(data, starts, ends, _BYTE, True) + (ends - starts).astype(np.uint64)), starts, ends


def shingles(doc: np.ndarray, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each run of ``size`` words; a text with fewer words, but some, has one run of them all."""
    if not len(doc):
        return doc, words
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    n = np.diff(np.append(first, len(doc)))
    h = np.zeros(len(doc), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            part = np.zeros(len(doc), np.uint64)
            part[: max(len(doc) - k, 0)] = words[k:]
            left = np.repeat(first + n, n) - np.arange(len(doc))  # words up to the text's end
            h = np.where(left > k, mix(h * np.uint64(31) + part), h)
    whole = np.repeat(first + n, n) - np.arange(len(doc)) >= size
    short = first[n < size]
    whole[short] = True
    return doc[whole], h[whole]


def weighted(doc: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, item) in order, and how often each occurs."""
    if not len(doc):
        return doc, items, np.zeros(0, np.int64)
    order = np.lexsort((items, doc))
    d, x = doc[order], items[order]
    new = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (x[1:] != x[:-1])))
    return d[new], x[new], np.diff(np.append(new, len(d)))


def portions(at: np.ndarray, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes in all; a longer text has a range of its own."""
    k, n = 0, len(at) - 1
    while k < n:
        stop = min(n, max(k + 1, int(np.searchsorted(at, at[k] + most, "right")) - 1))
        yield k, stop
        k = stop
