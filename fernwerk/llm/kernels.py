"""Vectorised text kernels on the raw buffers of Arrow string columns.

Everything here works on one chunk of documents at a time: the UTF-8 bytes of all its texts lie in one
array, ``off`` holds the documents' bounds, and no Python object is made for a word or a byte.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_M1, _M2 = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)
_C1, _C2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9)

#: ``[^\x20\x09-\x0D]+``: what separates the words of shingles and passages.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing: ASCII digits and letters, and every byte of other characters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def give_back() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def tidy(run: Callable) -> Callable:
    """A task's function that gives freed memory back at its end: workers live on and serve tasks of other kinds."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> _U(33))
    h *= _M1
    h ^= h >> _U(33)
    h *= _M2
    h ^= h >> _U(33)
    return h


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of whole documents with about max_bytes of text, so that work arrays stay small whatever a batch holds."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            yield b.slice(lo, hi - lo)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 bounds of a string or binary column; a null is an empty text."""
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, bounds, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(bounds, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def words(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` bytes within documents, and the n + 1 bounds of each document's words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    m = inside[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, m[:-1]
    after[-1], after[:-1] = False, m[1:]
    full = off[:-1] < off[1:]
    before[off[:-1][full]] = False
    after[off[1:][full] - 1] = False
    starts = np.flatnonzero(m & ~before)
    return starts, np.flatnonzero(m & ~after) + 1, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight bytes at a time."""
    size = ends - starts
    h = size.astype(_U) * _C1
    if not len(starts):
        return h
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    keep = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], _U)
    at, k = np.arange(len(starts)), 0
    while len(at):
        lane = lanes[starts[at] + k] & keep[np.minimum(size[at] - k, 8)]
        g = (h[at] ^ lane) * _C2
        g ^= g >> _U(29)
        h[at] = g * _M1 + _C1
        k += 8
        at = at[size[at] > k]
    return mix(h)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64 for i up to n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, _U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _POWERS[base] = (out[0], out[1])
    return have


class Rolling:
    """Hashes of any stretch of a sequence of 64-bit values, from one prefix sum."""

    def __init__(self, values: np.ndarray, base: int = 0x9E3779B97F4A7C15):
        p, self.inverse = _powers(len(values) + 1, base | 1)
        self.sums = np.empty(len(values) + 1, _U)
        self.sums[0] = 0
        np.cumsum(values * p[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[start + size] - self.sums[start]) * self.inverse[start] + np.asarray(size, np.int64).astype(_U))

    def all(self, size: int) -> np.ndarray:
        """Of every stretch of one size."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.inverse[:n] + _U(size)) if n > 0 else np.zeros(0, _U)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbours; len(x) - w + 1 values."""
    n = len(x)
    if w <= 1 or n < w:
        return x.copy() if w <= 1 else x[:0]
    pad = -n % w
    full = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(grams: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Winnowing: each window of ``length`` units within a document is given its least gram hash, leftmost of equals.

    grams: hash of the ``gram`` units from each unit on; bounds: the documents' bounds in units. Returns per
    maximal run of windows with the same anchor: document, first window, number of windows, place of the anchor.
    """
    none = (np.zeros(0, np.int64),) * 4
    w = length - gram + 1
    n = int(bounds[-1]) - length + 1
    if n <= 0:
        return none
    place = max(1, int(len(grams)).bit_length())
    low = _U((1 << place) - 1)
    key = (grams[: n + w - 1] & ~low) | np.arange(n + w - 1, dtype=_U)
    at = (sliding_min(key, w) & low).astype(np.int64)
    doc = np.searchsorted(bounds, np.arange(n), side="right") - 1
    fits = np.arange(n) + length <= bounds[doc + 1]
    new = np.ones(n, bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new & fits)
    # a run ends before the next run, or with the document's last window
    nxt = np.append(np.flatnonzero(new), n)
    end = nxt[np.searchsorted(nxt, first, side="right")]
    end = np.minimum(end, bounds[doc[first] + 1] - length + 1)
    return doc[first], first, end - first, at[first]


def cover(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any [lo, hi)."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, lo, 1)
    np.add.at(d, hi, -1)
    return np.cumsum(d[:-1]) > 0


def spread(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all stretches one after the other, and which stretch each belongs to."""
    owner = np.repeat(np.arange(len(start)), size)
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(start, size), owner


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == _U else x.astype(np.int64)
