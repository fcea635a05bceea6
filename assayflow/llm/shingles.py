"""Word and shingle hashes of many texts at once, in numpy over Arrow's own buffers.

A word [^\\x20\\x09-\\x0D]+ is hashed eight bytes at a time, each block mixed by multiplications and
shifts before the next one joins, all words of a batch together; the few words of more than LONG
bytes are hashed by xxh64. The hash doesn't depend on where the word stands or what stands with it.
A very long text is hashed in pieces of PIECE bytes that end at white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_U = np.uint64
_MIX = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
#: Bytes that are hashed at a time; a longer text is cut at white space.
PIECE = 1 << 21
LONG = 256

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The bytes of a block that belong to a word with so many bytes left.
_PART = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], _U)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _MIX[1]
    x = (x ^ (x >> _U(29))) * _MIX[3]
    return x ^ (x >> _U(32))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first positions of the words of some bytes (A-Z as a-z)."""
    if not len(data):
        return np.empty(0, _U), np.empty(0, np.int64)
    space = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edges = np.concatenate([[0], edges])
    if not space[-1]:
        edges = np.concatenate([edges, [len(data)]])
    starts, sizes = edges[0::2], edges[1::2] - edges[0::2]
    low = np.concatenate([_LOWER[data], np.zeros(8, np.uint8)])
    blocks = np.ndarray((len(data) + 1,), "<u8", buffer=low, strides=(1,))
    h = sizes.astype(_U) * _MIX[0]
    h = _mixed(h ^ (blocks[starts] & _PART[np.minimum(sizes, 8)]))
    some, at = np.flatnonzero(sizes > 8), 8
    for i in some[sizes[some] > LONG]:
        h[i] = xxhash.xxh64_intdigest(low[starts[i] : starts[i] + sizes[i]].tobytes())
    some = some[sizes[some] <= LONG]
    while len(some):
        h[some] = _mixed((h[some] + _MIX[2]) ^ (blocks[starts[some] + at] & _PART[np.minimum(sizes[some] - at, 8)]))
        at += 8
        some = some[sizes[some] > at]
    return h, starts


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces that end at white space."""
    at = 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data):
            gaps = np.flatnonzero(_SPACE[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
                break
            end = min(len(data), end + PIECE)
        yield data[at:end]
        at = end


def _rolled(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of size words."""
    x = np.full(len(h) - size + 1, size, _U)
    for i in range(size):
        x = (x ^ (h[i : len(x) + i] * (_MIX[i % 5] + _U(2 * (i // 5))))) * _MIX[0]
        x ^= x >> _U(29)
    return x.view(np.int64)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of one text; a shorter text is one."""
    return np.unique(_rolled(h, min(len(h), k))) if len(h) else np.empty(0, np.int64)


def _runs(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes of some texts that follow each other, and where each text's begin and end in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
    null = column.is_null().to_numpy(zero_copy_only=False)
    i = 0
    while i < len(column):
        j = i + 1
        while j < len(column) and offsets[j + 1] - offsets[i] <= PIECE:
            j += 1
        lengths = np.diff(offsets[i : j + 1])
        if j == i + 1:
            parts = [word_hashes(p)[0] for p in _pieces(data[offsets[i] : offsets[j]])]
            h = np.concatenate(parts) if parts else np.empty(0, _U)
            bounds = np.array([0, len(h)])
        else:
            # Texts lie next to each other: a space goes between them before they are hashed together.
            joined = np.full(int(lengths.sum()) + len(lengths), 0x20, np.uint8)
            joined[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)), lengths)] = data[offsets[i] : offsets[j]]
            h, starts = word_hashes(joined)
            bounds = np.searchsorted(starts, offsets[i : j + 1] - offsets[i] + np.arange(len(lengths) + 1))
        if null[i:j].any():  # bytes that a null's place may hold don't count
            keep = np.repeat(~null[i:j], np.diff(bounds))
            bounds = np.concatenate([[0], np.cumsum(np.where(null[i:j], 0, np.diff(bounds)))])
            h = h[keep]
        yield h, bounds
        i = j


def text_words(column: pa.Array) -> Iterator[np.ndarray]:
    """Word hashes of each text of an Arrow string column; none for null."""
    for h, bounds in _runs(column):
        for b, e in zip(bounds[:-1], bounds[1:], strict=True):
            yield h[b:e]


def token_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """shingles of each text of a column."""
    for h, bounds in _runs(column):
        x = _rolled(h, k) if len(h) >= k else None
        for b, e in zip(bounds[:-1], bounds[1:], strict=True):
            yield np.unique(x[b : e - k + 1]) if e - b >= k else shingles(h[b:e], k)
