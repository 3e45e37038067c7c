"""Words of many texts at once: places and 64-bit hashes by array operations over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(0x5EED))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            for i, b in enumerate((_BASE, _INVERSE)):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    bounds = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = 2 << 20):
    """Parts of a batch with about ``limit`` bytes of text each; one text is never cut."""
    column = batch.column(batch.schema.get_field_index(text))
    _, bounds = utf8(column)
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + limit, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def words(data: np.ndarray, bounds: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the end). Words: runs without white space."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    if lower:
        data = LOWER[data]
    word = ~_IS_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:n]
    end = word
    end = np.append(end[:-1] & (~word[1:] | edge[1:n]), word[-1])
    first, last = np.flatnonzero(start), np.flatnonzero(end) + 1
    power, inverse = _powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[data] * power[:n], out=total[1:])
        h = (total[last] - total[first]) * inverse[first]
        h = mix64(h + (last - first).astype(np.uint64))
    return h, np.searchsorted(first, bounds)


def shingles(h: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each run of ``size`` words; a text of fewer words, but some, is one shingle."""
    n = np.diff(bounds)
    text = np.repeat(np.arange(len(n)), n)
    if not len(h):
        return h, text
    place = np.arange(len(h)) - bounds[:-1][text]
    with np.errstate(over="ignore"):
        out = np.full(len(h), size, np.uint64)
        length = np.minimum(n, size)[text]
        for k in range(size):
            at = np.minimum(np.arange(len(h)) + k, len(h) - 1)
            out = np.where(k < length, mix64(out * _BASE + h[at]), out)
    ok = place <= np.maximum(n - size, 0)[text]
    return out[ok], text[ok]


def counted(key: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, key) with counts, texts in order: (key, text, count)."""
    if not len(key):
        return key, text, np.zeros(0, np.int64)
    order = np.lexsort((key, text))
    key, text = key[order], text[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return key[at], text[at], np.diff(np.append(at, len(key)))
