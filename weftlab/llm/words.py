"""Vectorised word and shingle hashing over whole texts (numpy, called inside Spark tasks).

A word is a run of bytes other than \\x20 and \\x09-\\x0D; only A-Z is lower-cased. Hashes are 64-bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers of a seed."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = stream(1, 256)[_LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ORDER = stream(2, 16) | np.uint64(1)


def slices(texts: list[str | None], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first, last, joined bytes, start of each text) over runs of texts of about limit bytes; null counts as empty."""
    first, size, parts = 0, 0, []
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "replace") if t else b""
        parts.append(b)
        size += len(b) + 1
        if size >= limit or i == len(texts) - 1:
            starts = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
            yield first, i + 1, b"\n".join(parts) + b"\n", starts
            first, size, parts = i + 1, 0, []


def word_hashes(joined: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word, the first word of each text (one entry more than texts), and each word's byte span."""
    buf = np.frombuffer(joined, np.uint8)
    inside = ~_SPACE[buf]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ptr = np.append(np.searchsorted(begin, starts), len(begin))
    if not len(begin):
        return np.zeros(0, np.uint64), ptr, begin, end
    length = end - begin
    at = np.cumsum(length) - length
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.full(int(length.max()) + 1, _BASE))
        value = _BYTE[buf[inside]]
        value *= power[np.arange(len(value)) - np.repeat(at, length)]
        return mix(np.add.reduceat(value, at)), ptr, begin, end


def shingle_sets(texts: list[str | None], size: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: runs of `size` words; with fewer words the whole
    sequence as one; no words: empty."""
    for _, _, joined, starts in slices(texts):
        words, ptr, _, _ = word_hashes(joined, starts)
        with np.errstate(over="ignore"):
            n = max(0, len(words) - size + 1)
            runs = np.zeros(n, np.uint64)
            for k in range(size):
                runs += words[k : k + n] * _ORDER[k]
            runs = mix(runs)
            for a, b in zip(ptr[:-1], ptr[1:], strict=True):
                if b - a >= size:
                    yield np.unique(runs[a : b - size + 1])
                elif b > a:
                    yield mix((words[a:b] * _ORDER[: b - a]).sum(keepdims=True) + np.uint64(b - a))
                else:
                    yield runs[:0]
