"""Token ids of whole texts for tokenizers that never join signs across the pieces of a split rule.

The rule is applied to the code points of many texts at once with numpy; each distinct piece is encoded by the tokenizer's own
library once per task and its ids are gathered. Two rules are here: that of byte-level vocabularies (letters, digits,
other signs, each with one leading blank; white space; English contractions), and words with their leading blanks, for
vocabularies without a piece that holds a blank after another sign.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np

from weftlab.llm.tokens import _LETTER, _SPACE, _classes
from weftlab.llm.words import mix, stream

_CP_BASE = np.uint64(0xD6E8FEB86659FD93)
SLICE_CHARS = 1 << 20
MOST_PIECES = 1_600_000


def split_words(cp: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Starts of the pieces of the byte-level rule among the code points of several texts; ends: one past each text."""
    kind = _classes()[cp]
    new = np.empty(len(cp), bool)
    new[0] = True
    new[1:] = kind[1:] != kind[:-1]
    new[ends[ends < len(cp)]] = True
    space = kind == _SPACE
    last = np.zeros(len(cp), bool)
    last[ends[ends > 0] - 1] = True
    final = np.flatnonzero(space[:-1] & ~space[1:] & ~last[:-1])  # the last sign of white space, before other signs
    new[final] = True
    new[final[cp[final] == 0x20] + 1] = False
    at = np.flatnonzero((cp == ord("'")) & new)
    if len(at):
        left = ends[np.searchsorted(ends, at, side="right")] - at  # signs up to the text's end
        more = np.append(cp, [0, 0])
        a, b = more[at + 1], more[at + 2]
        one = np.isin(a, [ord(c) for c in "stmd"]) & (left > 1)
        two = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & (left > 2)
        hit = one | two
        new[at[hit] + 1] = False
        after = (at + np.where(two, 3, 2))[hit & (left > np.where(two, 3, 2))]
        new[after[kind[after] == _LETTER]] = True
    return np.flatnonzero(new)


def split_blanks(cp: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Starts of words with all blanks before them."""
    blank = cp == 0x20
    new = np.empty(len(cp), bool)
    new[0] = True
    new[1:] = blank[1:] & ~blank[:-1]
    new[ends[ends < len(cp)]] = True
    return np.flatnonzero(new)


class PieceEncoder:
    """encode: ids of each of a list of pieces; size: of the vocabulary. spell: the bytes of each id; a piece whose ids do not spell it is
    counted as odd (none, where spell is not given). control: strings at which texts are cut, and the id each of them gets."""

    def __init__(self, split: Callable[[np.ndarray, np.ndarray], np.ndarray], encode: Callable[[list[str]], list[list[int]]], size: int, spell: list[bytes] | None = None, control: dict[str, int] | None = None):
        self._split, self._encode, self.size, self._spell, self._control = split, encode, size, spell, control or {}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self._control, key=len, reverse=True))) + ")") if control else None
        self._clear()

    def _clear(self) -> None:
        self._hash, self._start, self._size, self._odd, self._ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int32)

    def _learn(self, hashes: np.ndarray, places: np.ndarray, pieces: list[str]) -> None:
        ids = self._encode(pieces)
        spell = self._spell
        odd = [b"".join(map(spell.__getitem__, i)) != p.encode("utf-8", "replace") for i, p in zip(ids, pieces, strict=True)] if spell else np.zeros(len(ids), bool)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        starts = len(self._ids) + np.cumsum(sizes) - sizes
        self._ids = np.concatenate([self._ids, np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(sizes.sum()))])
        self._hash = np.insert(self._hash, places, hashes)
        self._start, self._size, self._odd = np.insert(self._start, places, starts), np.insert(self._size, places, sizes), np.insert(self._odd, places, odd)

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts in a row, bounds of each text in them, number of odd pieces of each text)."""
        ends = np.cumsum([len(t) for t in texts])
        joined = "".join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")
        if not len(cp):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64), np.zeros(len(texts), np.int64)
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
            self._learn(seen[~known], where[~known], [joined[begin[k] : begin[k] + length[k]] for k in at[~known]])
            where = np.searchsorted(self._hash, seen)
        start, n, odd = self._start[where][which], self._size[where][which], self._odd[where][which]
        done = np.cumsum(n)
        ids = self._ids[np.repeat(start - (done - n), n) + np.arange(int(done[-1]))]
        first = np.append(0, np.searchsorted(begin, ends))
        return ids, np.append(0, done)[first], np.diff(np.append(0, np.cumsum(odd))[first])

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, in order; null texts have none."""
        for lo, hi in slices(texts):
            parts = [self._cut.split(t or "") if self._cut else [t or ""] for t in texts[lo:hi]]  # control strings at the odd places
            ids, bound, _ = self.flat([p for cut in parts for p in cut[::2]])
            k = 0
            for cut in parts:
                got = [ids[bound[k] : bound[k + 1]]]
                for i, name in enumerate(cut[1::2], k + 1):
                    got += [np.array([self._control[name]], np.int32), ids[bound[i] : bound[i + 1]]]
                k += len(cut) // 2 + 1
                yield np.concatenate(got) if len(got) > 1 else got[0]


def slices(texts: list[str | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """(first, last) of runs of texts of about `limit` signs."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit or i == len(texts) - 1:
            yield first, i + 1
            first, size = i + 1, 0


def byte_values() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary's entries stands for: printable signs for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def byte_spelling(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary."""
    from tokenizers import Tokenizer

    values, vocabulary = byte_values(), Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values()) + 1)
    for entry, i in vocabulary.items():
        out[i] = bytes(values[c] for c in entry)
    return out


@functools.lru_cache(maxsize=4)
def byte_level(path: str, plain: bool = False) -> PieceEncoder:
    """The encoder of a byte-level vocabulary file of the tokenizers library; plain: control strings inside texts are ordinary text, otherwise
    they get their ids, as the library does by default. Pieces, which are what the library's own splitting gives, go to its BPE model at once.

    ValueError for vocabularies without an entry for every byte: ids would not spell every text."""
    from tokenizers import Tokenizer

    tokenizer, values = Tokenizer.from_file(path), byte_values()
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    if not values.keys() <= vocabulary.keys():
        raise ValueError(f"{path}: not a byte-level vocabulary")
    control = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    tokenize, signs = tokenizer.model.tokenize, {b: c for c, b in values.items() if ord(c) != b}

    def encode(pieces: list[str]) -> list[list[int]]:
        return [[t.id for t in tokenize(p.encode("utf-8", "replace").decode("latin-1").translate(signs))] for p in pieces]

    return PieceEncoder(split_words, encode, max(vocabulary.values()) + 1, control=None if plain else control)


def piece_spelling(path: str) -> list[bytes]:
    """The bytes of every id of a sentencepiece model: blanks for U+2581, bytes of byte pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in ids]


@functools.lru_cache(maxsize=4)
def blank_led(path: str) -> PieceEncoder:
    """The encoder of a sentencepiece model that puts a blank before each text; it is given texts that have it already.

    ValueError for models whose pieces hold a blank after another sign, or which change texts otherwise."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any("▁" in p.lstrip("▁") for p in pieces) or [pieces[i] for i in model.encode(" ")] != ["▁▁"]:
        raise ValueError(f"{path}: pieces are not words with the blanks before them")
    blank = [model.piece_to_id("▁")]

    def encode(words: list[str]) -> list[list[int]]:
        some = iter(model.encode([w[1:] for w in words if w != " "], num_threads=1))
        return [blank if w == " " else next(some) for w in words]

    spell = piece_spelling(path)
    return PieceEncoder(split_blanks, encode, len(spell), spell)
