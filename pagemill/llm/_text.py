"""Vectorised word hashing straight from Arrow's UTF-8 buffers.

A word is a maximal run of ASCII letters, digits and non-ASCII characters of the lower-cased text. Its 64-bit hash is a
polynomial over random byte values, read off one running sum, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE, SLICE = 1 << 16, 6 << 20
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
NOT_BLANK = np.arange(256) > 32
#: The same words as a regular expression over lower-cased text.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of a sum depends on all of it."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS.get(0, (np.empty(0),))[0].size < n:
        size = max(n, PIECE + 1)
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _POWERS[0] = (made[0], made[1])
    return _POWERS[0]


def _cut(buf: np.ndarray, bounds: np.ndarray, a: int, end: int, inside: np.ndarray) -> int:
    """Where a piece that starts at a may end: behind a separator or at the start of a text."""
    b = min(a + PIECE, end)
    while b < end:
        tail = max(a, b - 4096)
        gaps = np.flatnonzero(~inside[buf[tail:b]])
        if not gaps.size:
            tail = a
            gaps = np.flatnonzero(~inside[buf[a:b]])
        if gaps.size:
            return tail + int(gaps[-1]) + 1
        start = int(bounds[np.searchsorted(bounds, b, "right") - 1])
        if start > a:
            return start
        b = min(a + 2 * (b - a), end)
    return end


def words(buf: np.ndarray, bounds: np.ndarray, inside: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word (run of bytes that are `inside`) of all texts, and where each text's words begin (one entry more)."""
    hashes, starts, ends = [], [], []
    kind = inside.astype(np.uint8).tobytes()
    a, end = int(bounds[0]), int(bounds[-1])
    while a < end:
        b = _cut(buf, bounds, a, end, inside)
        part = buf[a:b]
        w = np.frombuffer(part.tobytes().translate(kind), bool)
        inner = bounds[np.searchsorted(bounds, a, "right") : np.searchsorted(bounds, b, "left")] - a
        first, last = w.copy(), w.copy()
        first[1:] &= ~w[:-1]
        last[:-1] &= ~w[1:]
        first[inner] = w[inner]
        last[inner - 1] = w[inner - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        power, inverse = powers(b - a + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_TABLE[part] * power[: b - a], out=sums[1:])
        hashes.append(mix((sums[e] - sums[s]) * inverse[s]))
        starts.append(s + a)
        ends.append(e + a)
        a = b
    if not hashes:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, np.zeros(len(bounds), np.int64)
    s = np.concatenate(starts)
    return np.concatenate(hashes), s, np.concatenate(ends), np.searchsorted(s, bounds)


def grams(h: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams in order, and where each text's begin.

    A text of 1 to n-1 words has one gram of all its words; a text without words has none.
    """
    counts = np.diff(offsets)
    per = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    out = np.concatenate(([0], np.cumsum(per)))
    doc = np.repeat(np.arange(len(counts)), per)
    at = np.arange(out[-1]) - out[:-1][doc] + offsets[:-1][doc]
    left = np.minimum(counts, n)[doc]
    total = np.zeros(out[-1], np.uint64)
    padded = np.concatenate((h, np.zeros(n, np.uint64)))
    for k in range(n):
        x = padded[at + k]
        total = total * np.uint64(0xD1342543DE82EF95) + np.where(k < left, x, np.uint64(k + 1))
    return mix(total), out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the bounds of its texts; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets and len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), bounds


def with_lower(docs: DataFrame) -> DataFrame:
    """All columns and behind them the lower-cased text, under a name that no column has."""
    taken, name = {c.lower() for c in docs.columns}, "lowered"
    while name in taken:
        name += "_"
    return docs.withColumn(name, F.lower("text"))


def kept(part: pa.RecordBatch, keep: np.ndarray) -> pa.RecordBatch:
    """The rows to keep, without the column of with_lower."""
    return part.select(list(range(part.num_columns - 1))).filter(pa.array(keep))


def slices(batches, text: str | None = "text", limit: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batches cut into runs of rows of about `limit` bytes of text, a longer text alone, with bytes and bounds."""
    for batch in batches:
        buf, bounds = utf8(batch.column(batch.num_columns - 1 if text is None else text))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
            j = min(j, n)
            yield batch.slice(i, j - i), buf, bounds[i : j + 1]
            i = j


def as_binary(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()
