"""Word and shingle hashes of Arrow string arrays, computed for whole batches with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time, so that scratch arrays stay small however long a text is.
TILE = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Words without A-Z (lower-cased), cut at the six ASCII blanks.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANKS = np.zeros(256, bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the n + 1 places where texts begin and end; null is empty."""
    array = array.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def _tile(
    data: np.ndarray, begins: np.ndarray, outside: np.ndarray, prefixes: tuple[int, ...] = ()
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in data and their first bytes' places; begins: where texts begin.

    With prefixes, hashes have a column more for each: of the word's first so many bytes, 0 if it has no more.
    """
    inside = ~outside[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = begins[begins < len(data)]
    first[begins] = inside[begins]
    start = np.flatnonzero(first)
    if not len(start):
        return np.zeros((0, 1 + len(prefixes)) if prefixes else 0, np.uint64), start
    power, inverse = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(np.where(inside, LOWER[data], 0).astype(np.uint64) * power, out=total[1:])
    # bytes outside words add nothing, so a word's sum ends where the next word begins
    ends = np.append(start[1:], len(data))
    whole = mixed((total[ends] - total[start]) * inverse[start])
    if not prefixes:
        return whole, start
    # a word ends before the first byte outside or the next text's first
    last = np.flatnonzero(inside & np.append(~inside[1:] | first[1:], True))
    columns = [whole]
    for k in prefixes:
        long = last + 1 - start > k
        to = np.where(long, start + k, start)
        columns.append(np.where(long, mixed((total[to] - total[start]) * inverse[start] + np.uint64(k)), np.uint64(0)))
    return np.stack(columns, axis=1), start


def words(array: pa.Array, outside: np.ndarray = BLANKS, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes in order, and for n texts the n + 1 places in them where texts begin and end."""
    data, ends = buffers(array)
    found, starts, at = [], [], 0
    while at < len(data):
        to = min(at + TILE, len(data))
        if to < len(data):  # not inside a word: back to a blank, or else on to the next one or to a text's end
            window = outside[data[at:to]]
            if window.any():
                to = at + len(window) - int(np.argmax(window[::-1]))
            else:
                nxt = ends[np.searchsorted(ends, to, "left")]
                while to < nxt and not outside[data[to]]:
                    to += 1
        inner = ends[np.searchsorted(ends, at) : np.searchsorted(ends, to)] - at
        h, s = _tile(data[at:to], inner, outside, prefixes)
        found.append(h)
        starts.append(s + at)
        at = to
    if not found:
        return np.zeros((0, 1 + len(prefixes)) if prefixes else 0, np.uint64), np.zeros(len(ends), np.int64)
    return np.concatenate(found), np.searchsorted(np.concatenate(starts), ends, "left")


def slices(array: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of an array, as (start, length), with about limit bytes of text each."""
    sizes = np.cumsum(np.diff(buffers(array)[1]))
    at = 0
    while at < len(array):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit, "right")))
        yield at, to - at
        at = to


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """The distinct hashes of size consecutive words; fewer words make one shingle, none make none."""
    if not len(h):
        return h
    k = min(size, len(h))
    out = np.full(len(h) - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[i : len(h) - k + 1 + i]
    return np.unique(mixed(out))


def shingle_sets(array: pa.Array, size: int) -> Iterator[np.ndarray]:
    h, ends = words(array)
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield shingles(h[a:b], size)
