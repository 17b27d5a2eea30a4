"""Word shingles of whole Arrow batches of texts, hashed with NumPy.

A word is a run of bytes other than space and 0x09 to 0x0D; A-Z are lower-cased. The bytes
of a batch lie in one buffer, so that words and shingles of all its texts are hashed at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of a base modulo 2**64; kept for later batches of the same worker."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 19), np.uint64(base), dtype=np.uint64)
        have[0] = 1
        _POWERS[base] = np.cumprod(have, out=have)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, nulls as empty, and where each text begins and ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[ends[0] : ends[-1]] if len(ends) else raw[:0], ends - (ends[0] if len(ends) else 0)


def pieces(column: pa.Array, most: int = 500_000):
    """Slices ``(first, last)`` of a text column of about ``most`` bytes; a longer text stands alone."""
    _, ends = text_bytes(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(ends, ends[first] + most, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last
        first = last


def word_spans(raw: np.ndarray, ends: np.ndarray, blank: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of the text it stands in. ``blank`` marks the bytes between words."""
    if not len(raw):
        return (np.zeros(0, dtype=np.int64),) * 3
    gap = blank[raw]
    first = np.empty(len(raw), dtype=bool)
    first[0] = True
    np.copyto(first[1:], gap[:-1])
    begins = ends[:-1]
    first[begins[begins < len(raw)]] = True
    first &= ~gap
    last = np.empty(len(raw), dtype=bool)
    last[-1] = True
    np.copyto(last[:-1], gap[1:])
    last[ends[1:][ends[1:] > 0] - 1] = True
    last &= ~gap
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(ends, start, side="right") - 1


def span_hashes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span, A-Z lower-cased.

    A span's bytes are the digits of a number to an odd base modulo 2**64, taken from one running
    total of the whole buffer and shifted to the span's start.
    """
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[_LOWER[raw]] * _powers(_BASE, len(raw)), out=total[1:])
    back = _powers(pow(_BASE, -1, 2**64), len(raw))
    return mix64((total[stop] - total[start]) * back[start] + (stop - start).astype(np.uint64))


def word_hashes(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the number of the text it stands in."""
    start, stop, text = word_spans(raw, ends)
    return span_hashes(raw, start, stop), text


def shingle_sets(column: pa.Array, words: int):
    """For each text in turn the sorted distinct hashes of its ``words``-word shingles.

    A text with fewer words has one shingle, its whole sequence; one without words has none.
    """
    for first, last in pieces(column):
        raw, ends = text_bytes(column.slice(first, last - first))
        hashes, text = word_hashes(raw, ends)
        bounds = np.searchsorted(text, np.arange(last - first + 1))
        span = max(0, len(hashes) - words + 1)
        joined = np.zeros(span, dtype=np.uint64)
        for k in range(words):
            joined = mix64(joined + hashes[k : k + span]) + np.uint64(k + 1)
        for n in range(last - first):
            lo, hi = int(bounds[n]), int(bounds[n + 1])
            if hi - lo >= words:
                yield np.unique(joined[lo : hi - words + 1])
            elif hi > lo:
                short = np.array([hi - lo], dtype=np.uint64)
                for k in range(lo, hi):
                    short = mix64(short + hashes[k : k + 1])
                yield short
            else:
                yield np.zeros(0, dtype=np.uint64)
