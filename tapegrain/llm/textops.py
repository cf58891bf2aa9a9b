"""Vectorised work on the bytes of Arrow text columns: words, 64-bit hashes, windows.

Texts are handled in slices of a few MB, so memory in a task does not follow the batch; one text
longer than a slice is a slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Word separators of the contracts: space and 0x09-0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of the loose words: every ASCII byte that is no letter or digit.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
SLICE_BYTES = 4 << 20
_BLOCK = 1 << 20
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))
BYTE_CODE = np.random.Generator(np.random.PCG64(20)).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: As BYTE_CODE, with A-Z read as a-z.
BYTE_CODE_LOWER = BYTE_CODE[[b + 32 if 65 <= b <= 90 else b for b in range(256)]]
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        p = np.full(max(n, _BLOCK + 1), base, U64)
        p[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(p)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of a 64-bit value."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the n+1 offsets into them; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = int(offsets[0]) if len(offsets) else 0
    return raw[lo:int(offsets[-1])] if len(offsets) else raw[:0], offsets - lo


def release() -> None:
    """Give freed memory back to the system; Python workers live on idle after their task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of a piece hold about ``limit`` bytes, one text at least."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(lengths, dtype=np.int64), 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop
            release()


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the number of words before it (n+1 values)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    edge = offsets[:-1]
    before[edge[edge < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    edge = offsets[1:] - 1
    after[edge[edge >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, code: np.ndarray = BYTE_CODE) -> np.ndarray:
    """A 64-bit hash of each byte span; spans are ascending and may not overlap."""
    out, at = np.empty(len(starts), U64), 0
    while at < len(starts):
        base = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(ends, base + _BLOCK, side="right")))
        s, e = starts[at:stop] - base, ends[at:stop] - base
        n = int(e[-1])
        run = np.zeros(n + 1, U64)
        np.cumsum(code[data[base:base + n]] * _power(_BASE, n)[:n], out=run[1:])
        out[at:stop] = (run[e] - run[s]) * _power(_BASE_INV, n + 1)[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93)
        at = stop
    return mix(out)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values, at the position of the first; the last k-1 positions have none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    acc = h[:n].copy()
    for j in range(1, k):
        acc *= U64(0xD1B54A32D192ED03)
        acc += h[j:j + n]
    return mix(acc)


def window_starts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a window of k words lies within one text, and the text of each."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    return ranges(first[:-1], counts), doc


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (count[0] values), then those of the next, in one array."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(start - np.concatenate(([0], np.cumsum(count)[:-1])), count)
    return np.arange(total) + shift


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values."""
    n, have, out = len(x) - w + 1, 1, x
    if n <= 0:
        return x[:0]
    while have * 2 <= w:
        out = np.minimum(out[:len(out) - have], out[have:])
        have *= 2
    return np.minimum(out[:n], out[w - have:w - have + n]) if have < w else out[:n]


def same_spans(data: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> bool:
    """Whether each span a holds the bytes of the span b beside it."""
    if not np.array_equal(a1 - a0, b1 - b0):
        return False
    length, k = a1 - a0, 0
    while len(a0):
        if not np.array_equal(data[a0 + k], data[b0 + k]):
            return False
        k += 1
        more = length > k
        if not more.all():
            a0, b0, length = a0[more], b0[more], length[more]
    return True


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of the spans, one after the other."""
    return data[ranges(starts, ends - starts)]


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space after each, and their new starts and ends."""
    length = ends - starts
    new = np.concatenate(([0], np.cumsum(length + 1)))
    out = np.full(int(new[-1]), 32, np.uint8)
    out[ranges(new[:-1], length)] = gather(data, starts, ends)
    return out, new[:-1], new[:-1] + length
