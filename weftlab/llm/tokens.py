"""Byte-level BPE ids of whole texts, encoding every distinct word piece once per task.

The split rule of the vocabulary (letters, digits, other signs, each with one leading blank; white space) is applied to
whole batches of code points with numpy; distinct pieces are encoded once and their ids gathered. Texts with an
apostrophe contraction, whose rule depends on its surroundings, go through the tokenizer one by one.
Strings of control tokens inside a text are ordinary text, unless the encoder is given their ids. Null texts have no ids.
"""

from __future__ import annotations

import base64
import functools
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import tiktoken

from weftlab.llm.words import mix, stream

_CONTRACTION = re.compile("'(?:s|t|re|ve|m|ll|d)")
_LETTER, _NUMBER, _OTHER, _SPACE = 0, 1, 2, 3
_CP_BASE = np.uint64(0xD6E8FEB86659FD93)
SLICE_CHARS = 1 << 18
MOST_PIECES = 400_000


@functools.cache
def _classes() -> np.ndarray:
    """Class of every code point: letter, number, other, white space."""
    kinds = {"L": _LETTER, "N": _NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], _OTHER) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    blank = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    table[blank] = _SPACE
    return table


class Encoder:
    """ids of texts under the ranks file at `path`; pattern is its split rule.

    control: (string, id) of tokens that a text is cut at, the longest first where several begin; each gets its id."""

    def __init__(self, path: str, pattern: str, control: tuple[tuple[str, int], ...] = ()):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._control = dict(control)
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self._control, key=len, reverse=True))) + ")") if control else None
        self._clear()

    def _clear(self) -> None:
        self._hash, self._start, self._size, self._ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self, hashes: np.ndarray, places: np.ndarray, pieces: list[str]) -> None:
        ids = [self._bpe.encode_ordinary(p) for p in pieces]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        starts = len(self._ids) + np.cumsum(sizes) - sizes
        self._ids = np.concatenate([self._ids, np.fromiter((x for y in ids for x in y), np.int32, int(sizes.sum()))])
        self._hash = np.insert(self._hash, places, hashes)
        self._start, self._size = np.insert(self._start, places, starts), np.insert(self._size, places, sizes)

    def _split(self, cp: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Start of every piece among the code points of several texts; ends: one past each text."""
        kind = _classes()[cp]
        new = np.empty(len(cp), bool)
        new[0] = True
        new[1:] = kind[1:] != kind[:-1]
        new[ends[ends < len(cp)]] = True
        space = kind == _SPACE
        last = np.zeros(len(cp), bool)
        last[ends[ends > 0] - 1] = True
        final = np.flatnonzero(space[:-1] & ~space[1:] & ~last[:-1])  # a white-space run's last sign, before other signs
        new[final] = True
        new[final[cp[final] == 0x20] + 1] = False
        return np.flatnonzero(new)

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        if self._cut is None:
            yield from self._ordinary(texts)
            return
        parts = [self._cut.split(t or "") for t in texts]
        done = self._ordinary([p for cut in parts for p in cut[::2]])
        for cut in parts:
            got = [next(done)]
            for name in cut[1::2]:
                got += [np.array([self._control[name]], np.int32), next(done)]
            yield np.concatenate(got) if len(got) > 1 else got[0]

    def _ordinary(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, control tokens spelled out."""
        first, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= SLICE_CHARS or i == len(texts) - 1:
                yield from self._slice(texts[first : i + 1])
                first, size = i + 1, 0

    def _slice(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        plain = [t if t and not ("'" in t and _CONTRACTION.search(t)) else "" for t in texts]
        ends = np.cumsum([len(t) for t in plain])
        cp = np.frombuffer("".join(plain).encode("utf-32-le", "replace"), "<u4")
        ids, cut = np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        if len(cp):
            begin = self._split(cp, ends)
            length = np.diff(begin, append=len(cp))
            with np.errstate(over="ignore"):
                power = np.multiply.accumulate(np.full(int(length.max()) + 1, _CP_BASE))
                value = mix(cp.astype(np.uint64) + stream(7, 1)[0])
                value *= power[np.arange(len(cp)) - np.repeat(begin, length)]
                hashes = mix(np.add.reduceat(value, begin))
            seen, at, which = np.unique(hashes, return_index=True, return_inverse=True)
            if len(self._hash) > MOST_PIECES:
                self._clear()
            where = np.searchsorted(self._hash, seen)
            known = where < len(self._hash)
            known[known] = self._hash[where[known]] == seen[known]
            if not known.all():
                flat = "".join(plain)
                self._learn(seen[~known], where[~known], [flat[begin[k] : begin[k] + length[k]] for k in at[~known]])
                where = np.searchsorted(self._hash, seen)
            start, n = self._start[where][which], self._size[where][which]
            done = np.cumsum(n)
            ids = self._ids[np.repeat(start - (done - n), n) + np.arange(int(done[-1]))]
            cut = np.append(0, done)[np.searchsorted(begin, ends)]
        a = 0
        for t, p, b in zip(texts, plain, cut.tolist(), strict=True):
            yield ids[a:b] if p or not t else np.asarray(self._bpe.encode_ordinary(t), np.int32)
            a = b


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str, control: tuple[tuple[str, int], ...] = ()) -> Encoder:
    """One encoder per Python worker."""
    return Encoder(path, pattern, control)
