"""Vectorised text kernels shared by the corpus operators.

Everything here works on one Arrow batch of UTF-8 bytes inside a task: words are maximal runs of bytes that are not
ASCII white space (``[^\\x20\\x09-\\x0D]+``), hashes are 64-bit polynomials over random byte codes. Nothing is kept
between batches, so memory is bounded by ``SLICE`` bytes or the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once (a longer single text is handled alone).
SLICE = 1 << 20
_U = np.uint64


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that nearby sums spread over all bits."""
    h = h.astype(_U, copy=True)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


def _byte_codes(fold_case: bool) -> np.ndarray:
    codes = mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
    codes[9:14] = 0
    codes[32] = 0
    if fold_case:
        codes[65:91] = codes[97:123]
    return codes


_CODES = {fold: _byte_codes(fold) for fold in (False, True)}
_SPACE = np.zeros(256, dtype=bool)
_SPACE[9:14] = True
_SPACE[32] = True
_BASE = 0x100000001B3


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a binary or string column into (first row, last row, bytes, offsets); null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=wide)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offs, offs[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, buf[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        first = last


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words; a word never crosses the end of a text."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SPACE[buf]
    head = inside.copy()
    head[1:] &= ~inside[:-1]
    tail = inside.copy()
    tail[:-1] &= ~inside[1:]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(buf))]
    head[cuts] = inside[cuts]
    tail[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(head), np.flatnonzero(tail) + 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_case: bool) -> np.ndarray:
    """One 64-bit hash per word; with fold_case, A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, _U)
    within = np.arange(len(buf), dtype=np.int64) - np.repeat(
        np.concatenate(([0], starts[1:])), np.diff(np.concatenate(([0], starts[1:], [len(buf)])))
    )
    longest = int((ends - starts).max())
    power = powers(_BASE, longest)
    terms = _CODES[fold_case][buf] * power[np.clip(within, 0, longest - 1)]
    return mix64(np.add.reduceat(terms, starts) + (ends - starts).astype(_U))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, in order (empty with fewer words)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, _U)
    for k in range(size):
        out = out * _U(0x9E3779B97F4A7C15) + words[k : k + n]
    return mix64(out + _U(size))


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct shingle hashes, sorted; fewer words than ``size`` make one shingle of the whole sequence."""
    if not len(words):
        return np.zeros(0, _U)
    return np.unique(shingle_hashes(words, min(size, len(words))))


def words_by_text(buf: np.ndarray, offs: np.ndarray, fold_case: bool) -> Iterator[np.ndarray]:
    """The word hashes of each text of a slice."""
    starts, ends = word_spans(buf, offs)
    hashes = word_hashes(buf, starts, ends, fold_case)
    cut = np.searchsorted(starts, offs)
    for i in range(len(offs) - 1):
        yield hashes[cut[i] : cut[i + 1]]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64) if h.dtype == _U else h


def list_column(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from one array per row."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
