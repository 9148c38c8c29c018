"""Word boundaries and word hashes of many texts at once, on the UTF-8 bytes of Arrow string columns.

All of it works on whole texts; chunks() only bounds how many texts are held at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: True for bytes of words that white space separates: all but 0x20 and 0x09-0x0D.
BY_SPACE = np.ones(256, bool)
BY_SPACE[[0x20, *range(0x09, 0x0E)]] = False


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its n + 1 offsets into them; null texts are empty."""
    a = column.cast(pa.large_binary())
    if a.null_count:
        a = a.fill_null(b"")
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - (offsets[0] if len(offsets) else 0)


def chunks(batches: Iterable[pa.RecordBatch], limit: int = 4 << 20, name: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `limit` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        ends = np.cumsum(np.maximum(np.asarray(_lengths(batch.column(name))), 1))
        first = 0
        while first < batch.num_rows:
            base = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(first, last - first)
            first = last


def _lengths(column: pa.Array) -> np.ndarray:
    return np.diff(text_bytes(column)[1])


class Words:
    """Words of a chunk of texts: spans [start, end) in `data` (lower-cased A-Z), first[d] .. first[d + 1] for text d."""

    def __init__(self, column: pa.Array, member: np.ndarray = BY_SPACE):
        raw, self.offsets = text_bytes(column)
        n = len(raw)
        self.data = np.zeros(n + 8, np.uint8)  # room for 8-byte loads at the end
        np.take(LOWER, raw, out=self.data[:n])
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = member[self.data[:n]]
        begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        cuts = self.offsets[1:-1][(self.offsets[1:-1] > 0) & (self.offsets[1:-1] < n)]
        begins[cuts] |= inside[1:-1][cuts]
        ends[cuts - 1] |= inside[1:-1][cuts - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, at_most: int = 0, seed: int = 0) -> np.ndarray:
        """64-bit hashes of the words, or of their first `at_most` bytes."""
        lens = self.end - self.start
        return hash_spans(self.data, self.start, np.minimum(lens, at_most) if at_most else lens, seed)


def gathered(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[start[0] : start[0] + length[0]], then the next span, and so on, one after another."""
    ends = np.cumsum(length)
    at = np.arange(int(ends[-1]) if len(ends) else 0)
    at += np.repeat(start - ends + length, length)
    return flat[at]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M2
    x = (x ^ (x >> np.uint64(29))) * _M1
    return x ^ (x >> np.uint64(32))


def hash_spans(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of data[start : start + length], 8 bytes at a time over all spans together; data has 8 spare bytes at its end."""
    at = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = mix(length.astype(np.uint64) + np.uint64((seed * int(_M1) + 1) % (1 << 64)))
    todo, off = np.arange(len(start)), 0
    while len(todo):
        left = length[todo] - off
        if off:
            keep = left > 0
            todo, left = todo[keep], left[keep]
            if not len(todo):
                break
        x = (h[todo] ^ (at[start[todo] + off] & _MASKS[np.minimum(left, 8)])) * _M1
        h[todo] = (x ^ (x >> np.uint64(31))) * _M2
        off += 8
    return mix(h)
