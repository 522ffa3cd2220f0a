"""Vectorised word splitting and hashing over Arrow string columns.

A chunk is the UTF-8 bytes of some whole texts, one after another, with their
offsets. Words are maximal runs of bytes outside the ASCII white space; they
never reach over a text's end. A word's hash is a polynomial over its bytes
modulo 2**64, finalised by a mixer, so that one pass of numpy serves all words
of a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that are hashed at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Multipliers of the polynomial hashes (odd, chosen at random once).
BYTE_BASE, GRAM_BASE, GRAM_BASE_2 = 0x9E3779B97F4A7C55, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
#: All of ASCII but letters and digits, for words without punctuation.
MARKS = np.zeros(256, bool)
MARKS[:128] = [not chr(b).isalnum() for b in range(128)]
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        step = np.full(max(n, CHUNK_BYTES + 1), base, dtype=U64)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if len(have) > 8 * CHUNK_BYTES:
            return have  # of one very long text; not kept
        _powers[name] = have
    return have


class Chunk(NamedTuple):
    first: int  # of the batch's rows
    data: np.ndarray  # bytes
    offsets: np.ndarray  # of the texts in data, one more than there are


class Words(NamedTuple):
    start: np.ndarray  # byte offsets in the chunk
    end: np.ndarray
    doc: np.ndarray  # index of the text in the chunk
    hash: np.ndarray
    first: np.ndarray  # index of each text's first word, one more than there are texts


def chunks(texts: pa.Array | pa.ChunkedArray) -> Iterator[Chunk]:
    """A string column in chunks of whole texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1
        to = min(max(to, at + 1), len(texts))
        yield Chunk(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def words(chunk: Chunk, fold: bool = False, between: np.ndarray = _WHITE) -> Words:
    """All words of a chunk; fold lower-cases A-Z before hashing, between marks the bytes that part words."""
    data, offsets = (_FOLD[chunk.data] if fold else chunk.data), chunk.offsets
    n, texts = len(data), len(offsets) - 1
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, U64), np.zeros(texts + 1, np.int64))
    inside = ~between[data]
    breaks = np.zeros(n + 1, bool)
    breaks[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, ~inside[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, ~inside[1:]
    start = np.flatnonzero(inside & (before | breaks[:-1]))
    end = np.flatnonzero(inside & (after | breaks[1:])) + 1
    if len(start):
        value = _BYTE_VALUE[data]
        value *= _power(BYTE_BASE, n, "up")[:n]
        value[~inside] = 0
        h = np.add.reduceat(value, start)
        h *= _power(pow(BYTE_BASE, -1, 1 << 64), n, "down")[start]
        h += (end - start).astype(U64)
        h = mix(h)
    else:
        h = np.zeros(0, U64)
    first = np.searchsorted(start, offsets)
    return Words(start, end, np.repeat(np.arange(texts), np.diff(first)), h, first)


def gram_hash(h: np.ndarray, n: int, base: int = GRAM_BASE) -> np.ndarray:
    """Hash of each n consecutive word hashes, text ends not regarded."""
    size = max(0, len(h) - n + 1)
    out = np.zeros(size, U64)
    for k in range(n):
        out *= U64(base)
        out += h[k : k + size]
    return mix(out)


def gram_inside(w: Words, n: int) -> np.ndarray:
    """Whether the n words from each start on are of one text."""
    size = max(0, len(w.doc) - n + 1)
    return w.doc[:size] == w.doc[n - 1 :] if size else np.zeros(0, bool)


def planes(values: np.ndarray) -> bytes:
    """The bytes of integers, all first bytes first: small values then compress well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def from_planes(data: bytes, dtype=np.int64) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, len(data) // width).T).view(dtype).ravel()


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the top 32 bits; buckets of equal width, in the order of the hashes."""
    return ((h >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def bucket_count(spark) -> int:
    """Two buckets for each shuffle partition: a bucket is as bounded as a task's share,
    and tasks send few more rows than shuffles have blocks."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
