"""Words and word shingles of Arrow text batches as hash arrays, without a Python loop over words.

Words are maximal runs without the bytes 0x20 and 0x09 to 0x0D; ASCII capitals are folded. A word's hash is a
polynomial over its bytes modulo 2**64 taken from running sums, then mixed; a shingle's hash mixes its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at once: temporary arrays take eight times as much.
CHUNK_BYTES = 1 << 20
SHINGLE = 5

_U = np.uint64
_ROOT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit numbers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _U(_ROOT))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE_FOLDED = _BYTE[_FOLD]
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
_PLACE = mixed(np.arange(11, 11 + 64, dtype=np.uint64) * _U(_ROOT)) | _U(1)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = CHUNK_BYTES + 1
    up = np.full(n, _U(_ROOT))
    down = np.full(n, _U(pow(_ROOT, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of successive slices; a longer text is a slice of its own."""
    column = batch.column(text)
    if column.null_count:
        column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(at, at[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), len(column))
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of every word of a slice."""
    inside = _IS_WORD[data]
    before = np.empty_like(inside)
    if len(inside):
        before[0] = False
        before[1:] = inside[:-1]
        first = offsets[:-1]
        before[first[first < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    if len(inside):
        after[-1] = False
        after[:-1] = inside[1:]
        last = offsets[1:] - 1
        after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    table = _BYTE_FOLDED if fold else _BYTE
    out = np.empty(len(starts), dtype=np.uint64)
    up, down = _powers()
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = int(np.searchsorted(ends, base + CHUNK_BYTES, side="right"))
        if hi <= lo:  # one word longer than a chunk
            total, size = 0, int(ends[lo]) - base
            for at in range(base, base + size, CHUNK_BYTES):
                part = table[data[at : min(at + CHUNK_BYTES, base + size)]]
                total = (total * pow(_ROOT, len(part), 1 << 64) + int((part * up[: len(part)]).sum(dtype=np.uint64))) & _MASK
            out[lo] = (total + size * 0x632BE59BD9B4E019) & _MASK
            lo += 1
            continue
        end = int(ends[hi - 1])
        sums = np.empty(end - base + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(table[data[base:end]] * up[: end - base], dtype=np.uint64, out=sums[1:])
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _U(0x632BE59BD9B4E019)
        lo = hi
    return mixed(out)


def shingle_hashes(hashes: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Hashes of the n-word windows of one word-hash array (windows may cross texts: the caller masks)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = hashes[:m] * _PLACE[0]
    for k in range(1, n):
        total = total + hashes[k : k + m] * _PLACE[k]
    return mixed(total)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; shorter texts are one shingle, wordless ones none."""
    starts, ends, _ = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    grams = shingle_hashes(hashes, n)
    first = np.searchsorted(starts, offsets)
    for k in range(len(offsets) - 1):
        lo, hi = int(first[k]), int(first[k + 1])
        if hi - lo >= n:
            yield np.unique(grams[lo : hi - n + 1])
        elif hi > lo:
            yield mixed((hashes[lo:hi] * _PLACE[20 : 20 + hi - lo]).sum(dtype=np.uint64, keepdims=True) + _U(hi - lo))
        else:
            yield np.zeros(0, dtype=np.uint64)
