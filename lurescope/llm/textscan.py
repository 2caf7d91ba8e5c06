"""Vectorised word scanning of Arrow string columns.

The words of a whole batch of texts are found on the column's UTF-8 buffer at
once: a 256-entry table maps each byte to "part of a word" or not, word
borders are the places where that flag changes, and a word's 64-bit hash is a
difference of prefix sums of ``value[byte] * BASE ** position`` (mod 2**64).
Every text is scanned whole; batches are cut into slices of half a MB only to
bound the memory of a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 512 << 10

_MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche over uint64 values."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_POWER_CACHE: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers for a slice, kept by the worker; those for a longer text are not kept."""
    size = SLICE_BYTES * 2
    if n > size:
        return _powers_doubling(BASE, n), _powers_doubling(BASE_INVERSE, n)
    if not _POWER_CACHE:
        _POWER_CACHE["up"] = _powers_doubling(BASE, size)
        _POWER_CACHE["down"] = _powers_doubling(BASE_INVERSE, size)
    return _POWER_CACHE["up"], _POWER_CACHE["down"]


def _powers_doubling(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    filled = 1
    while filled < n:
        m = min(filled, n - filled)
        out[filled:filled + m] = out[:m] * np.uint64(pow(base, filled, 1 << 64))
        filled += m
    return out


# Byte classes. In UTF-8 every byte >= 0x80 belongs to a non-ASCII character.
_BYTES = np.arange(256)
NOT_SPACE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
WORD_CHARS = (((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
              | (_BYTES >= 0x80))
NOT_NEWLINE = _BYTES != 0x0A
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)


@dataclass
class Scan:
    """Words of a run of texts.  ``doc_first[i] : doc_first[i + 1]`` are the
    words of text i; ``start``/``end`` are byte offsets into ``data``."""
    data: np.ndarray
    text_start: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc_first: np.ndarray
    hashes: np.ndarray
    total: np.ndarray

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.doc_first) - 1), np.diff(self.doc_first))


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset:column.offset + n + 1] \
        if n else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; one longer text is a range alone."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        b = min(b, n)
        yield a, b
        a = b


def scan(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray,
         lower: bool = True) -> Scan:
    """Words (maximal runs of ``word_bytes``) of the texts, with their hashes."""
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = word_bytes[data]
    starts_mask = inside[1:] & ~inside[:-1]            # length n + 1
    ends_mask = ~inside[1:] & inside[:-1]
    # A text border also ends a word and starts the next one.
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    joined = cuts[inside[cuts] & inside[cuts + 1]]
    starts_mask[joined] = True
    ends_mask[joined] = True
    start = np.flatnonzero(starts_mask)
    end = np.flatnonzero(ends_mask)
    up, down = _power_tables(n + 2)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_VALUES[data] * up[:n], out=total[1:])
    return Scan(data, offsets, start, end, np.searchsorted(start, offsets, side="left"),
                _span_hashes(total, down, start, end), total)


def _span_hashes(total, down, start, end) -> np.ndarray:
    return mix((total[end] - total[start]) * down[start]
               + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def span_hashes(s: Scan, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of other byte spans of a scanned run of texts."""
    return _span_hashes(s.total, _power_tables(len(s.total))[1], start, end)


def column_scans(column: pa.Array, word_bytes: np.ndarray, lower: bool = True
                 ) -> Iterator[tuple[int, int, Scan]]:
    """(first row, end row, Scan) for slices of a string column."""
    data, offsets = string_buffer(column)
    for a, b in slices(offsets):
        part = offsets[a:b + 1]
        yield a, b, scan(data[part[0]:part[-1]], part - part[0], word_bytes, lower)


_SHINGLE_MULT = [0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53]


def shingles(s: Scan, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each k-word shingle; a text with 1 to k - 1 words
    has its whole word sequence as its only shingle."""
    n = len(s.hashes)
    doc = s.doc_of_word()
    counts = np.diff(s.doc_first)
    out_h, out_d = [], []
    if n >= k:
        h = np.zeros(n - k + 1, dtype=np.uint64)
        for j in range(k):
            h += s.hashes[j:n - k + 1 + j] * np.uint64(_SHINGLE_MULT[j % 6] + 2 * (j // 6))
        ok = doc[:n - k + 1] == doc[k - 1:]
        out_h.append(mix(h[ok]))
        out_d.append(doc[:n - k + 1][ok])
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        h = np.zeros(len(short), dtype=np.uint64)
        for j in range(k - 1):
            has = counts[short] > j
            h[has] += s.hashes[s.doc_first[short[has]] + j] * np.uint64(
                _SHINGLE_MULT[j % 6] + 2 * (j // 6))
        out_h.append(mix(h ^ (counts[short].astype(np.uint64) << np.uint64(56))))
        out_d.append(short)
    if not out_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_h), np.concatenate(out_d)


def distinct_per_doc(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, hash) pairs sorted by document, then hash."""
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[keep], d[keep]
