"""Texts as numpy arrays: words, lines and rolling hashes of whole Arrow batches, with no Python object per word.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; in UTF-8 these bytes occur in no other character, so
this is ``[^\\x20\\x09-\\x0D]+`` over code points. Hashes are polynomials modulo 2**64 over random byte values, mixed at
the end: equal words have equal hashes wherever they stand, and 64 bits keep different ones apart.

What is held for each byte of a text is held for a piece of ``PIECE`` bytes at a time, so a very long text takes memory for
its words only (begin, end and hash: 24 bytes a word).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 2**64, 256, dtype=U)
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD6E8FEB86659FD93 | 1
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _table(x: int, n: int) -> np.ndarray:
    a = np.full(n, x, U)
    a[0] = 1
    return np.multiply.accumulate(a)


#: Bytes or words that are looked at at once; a longer text is read in pieces of so many.
PIECE = 1 << 18
_POWERS, _INVERSE = (_table(x, PIECE + 1) for x in (_BASE, pow(_BASE, -1, 2**64)))
#: Longer words have a cryptographic hash: polynomials modulo 2**64 can be led to collide by long texts of a certain pattern.
LONG_WORD = 512


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


@dataclass
class Block:
    """Some documents: their bytes one after the other, and where each begins (one more entry than documents)."""

    first: int
    data: np.ndarray
    at: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.at) - 1


def blocks(texts: pa.Array, limit: int = PIECE) -> Iterator[Block]:
    """An Arrow string array as blocks of about ``limit`` bytes (a longer text is a block of its own). Nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    buffers = texts.buffers()
    at = np.frombuffer(buffers[1], np.int64, n + 1, 8 * texts.offset)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    if texts.null_count:  # a null may span bytes
        keep = texts.is_valid().to_numpy(zero_copy_only=False)
        if (np.diff(at)[~keep] > 0).any():
            yield from blocks(pa.compute.fill_null(texts, ""), limit)
            return
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield Block(i, data[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


@dataclass
class Spans:
    """Words or lines of a block: begin and end byte, hash, and the index of the first one of each document."""

    begin: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    at: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def pieces(n: int, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, slice, np.ndarray, np.ndarray]]:
    """Pieces of n places, and which of the spans (ascending, apart from one another) have a part in each: first and last
    place, numbers of the spans, and where in the piece their parts begin and end."""
    for s in range(0, n, PIECE):
        e = min(n, s + PIECE)
        i, j = int(np.searchsorted(end, s, "right")), int(np.searchsorted(begin, e, "left"))
        if i < j:
            yield s, e, slice(i, j), np.maximum(begin[i:j], s) - s, np.minimum(end[i:j], e) - s


def span_hashes(values, n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of each span of n values; values(i, j) gives those from i to j. Memory is bounded by a piece."""
    out = np.zeros(len(begin), U)
    for s, e, own, b, z in pieces(n, begin, end):
        p = np.zeros(e - s + 1, U)
        np.cumsum(values(s, e) * _POWERS[: e - s], out=p[1:])
        part = (p[z] - p[b]) * _INVERSE[b]
        if begin[own.start] < s:  # goes on from the piece before
            part[:1] *= U(pow(_BASE, s - int(begin[own.start]), 2**64))
        out[own] += part
    return mix(out + (end - begin).astype(U))


def span_counts(marks, n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many of the places of each span are marked; marks(i, j) tells for those from i to j."""
    out = np.zeros(len(begin), np.int64)
    for s, e, own, b, z in pieces(n, begin, end):
        c = np.zeros(e - s + 1, np.int32)
        np.cumsum(marks(s, e), out=c[1:])
        out[own] += c[z] - c[b]
    return out


def byte_counts(b: Block, table: np.ndarray) -> np.ndarray:
    """How many bytes of each document the table of 256 marks."""
    return span_counts(lambda i, j: table[b.data[i:j]], len(b.data), b.at[:-1], b.at[1:])


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def words(b: Block, data: np.ndarray | None = None, split: np.ndarray | None = None) -> Spans:
    """Words of a block. data: bytes to take for the block's own; split: bytes before which a word is split as well."""
    data = b.data if data is None else data
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return Spans(e, e, np.zeros(0, U), np.zeros(b.docs + 1, np.int64))
    begins, ends = [], []
    for s in range(0, n, PIECE):
        e = min(n, s + PIECE)
        low, high = max(s - 1, 0), min(e + 1, n)
        solid = np.zeros(e - s + 2, bool)  # with a byte on either side
        solid[low - s + 1 : high - s + 1] = ~SPACE[data[low:high]]
        edge = np.zeros(e - s + 1, bool)
        edge[b.at[np.searchsorted(b.at, s, "left") : np.searchsorted(b.at, e, "right")] - s] = True
        if split is not None:
            edge[: high - s] |= split[s:high][: e - s + 1]
        begins.append(np.flatnonzero(solid[1:-1] & (edge[:-1] | ~solid[:-2])) + s)
        ends.append(np.flatnonzero(solid[1:-1] & (edge[1:] | ~solid[2:])) + s + 1)
    begin, end = (np.concatenate(x) if len(x) > 1 else x[0] for x in (begins, ends))
    h = span_hashes(lambda i, j: _BYTE[data[i:j]], n, begin, end)
    for k in np.flatnonzero(end - begin > LONG_WORD):
        h[k] = int.from_bytes(blake2b(memoryview(np.ascontiguousarray(data[begin[k] : end[k]])), digest_size=8).digest(), "little")
    return Spans(begin, end, h, np.searchsorted(begin, b.at, "left"))


def lines(b: Block) -> Spans:
    """Every line of every document, split at \\n; an empty text is one empty line."""
    breaks = np.flatnonzero(b.data == 10)
    of = np.searchsorted(b.at, breaks, "right") - 1
    doc = np.concatenate((np.arange(b.docs), of))
    begin = np.concatenate((b.at[:-1], breaks + 1))
    end = np.concatenate((b.at[1:], breaks))
    begin, end = begin[np.lexsort((begin, doc))], end[np.lexsort((end, doc))]
    h = span_hashes(lambda i, j: _BYTE[b.data[i:j]], len(b.data), begin, end)
    return Spans(begin, end, h, np.searchsorted(np.sort(doc), np.arange(b.docs + 1), "left"))


def grams(s: Spans, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of n words within a document, and each window's first word."""
    total = len(s.hash) - n + 1
    if total <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h = np.zeros(total, U)
    for j in range(n):
        h = h * U(_STEP) + s.hash[j : j + total]
    last = np.repeat(s.at[1:], np.diff(s.at))[:total]  # end of the window's document
    first = np.flatnonzero(np.arange(total) + n <= last)
    return mix(h[first]), first


def per_doc(at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values over the documents that ``at`` bounds."""
    c = np.concatenate(([0], np.cumsum(values)))
    return c[at[1:]] - c[at[:-1]]
