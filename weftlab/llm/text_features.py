"""Shape features of whole texts, vectorised over batches (numpy, inside Spark tasks)."""

from __future__ import annotations

import numpy as np
import pandas as pd

from weftlab.llm.words import slices, word_hashes

NAMES = ["log_words", "word_length", "upper", "symbols", "digits", "pipes", "bangs", "distinct_words", "top_word", "repeats",
         "log_lines", "line_length", "distinct_lines", "stops", "distinct_pairs", "non_ascii", "commas", "capitalised"]

_B = np.arange(256)
_UPPER = (_B >= 65) & (_B <= 90)
_LOWER = (_B >= 97) & (_B <= 122)
_DIGIT = (_B >= 48) & (_B <= 57)
_SIGN = (_B > 32) & (_B < 127) & ~_UPPER & ~_LOWER & ~_DIGIT & ~np.isin(_B, [44, 46, 39, 45, 34])
_BREAK = _B == 10
_OF = {"upper": _UPPER, "letters": _UPPER | _LOWER, "symbols": _SIGN, "digits": _DIGIT, "pipes": _B == 124, "bangs": _B == 33,
       "lines": _BREAK, "stops": _B == 46, "commas": _B == 44, "non_ascii": _B >= 128}


def features(texts: list[str | None]) -> np.ndarray:
    """One row of NAMES per text; null and empty texts have zeros, and everything is finite."""
    return np.concatenate([np.zeros((0, len(NAMES))), *(_slice(j, s) for _, _, j, s in slices(texts))])


def _slice(joined: bytes, starts: np.ndarray) -> np.ndarray:
    buf = np.frombuffer(joined, np.uint8)
    words, ptr, begin, _ = word_hashes(joined, starts)
    stops = np.append(starts[1:], len(buf)) - 1
    n = {}
    for k, of in _OF.items():
        total = np.append(0, np.cumsum(of[buf], dtype=np.int64))
        n[k] = (total[stops] - total[starts]).astype(float)
    starts_upper = np.append(0, np.cumsum(_UPPER[buf[begin]], dtype=np.int64)) if len(begin) else np.zeros(1, np.int64)
    breaks = np.append(-1, np.flatnonzero(_BREAK[buf]))
    line = np.searchsorted(breaks, starts)
    with np.errstate(over="ignore"):
        up_to = np.append(np.uint64(0), np.cumsum(words, dtype=np.uint64))
    size = (stops - starts).astype(float)
    out = np.zeros((len(starts), len(NAMES)))
    for i in range(len(starts)):
        a, b = ptr[i], ptr[i + 1]
        w = words[a:b]
        if b == a:
            continue
        _, count = np.unique(w, return_counts=True)
        with np.errstate(over="ignore"):
            pairs = len(np.unique(w[1:] * np.uint64(3) + w[:-1])) if b - a > 1 else 1
        ends = breaks[line[i] : line[i] + int(n["lines"][i]) + 1]  # each line as the sum of its word hashes
        at = np.searchsorted(begin, ends)
        sums = np.diff(up_to[np.clip(np.append(np.append(a, at), b), a, b)])
        sums = sums[sums > 0]
        m, letters = float(b - a), max(1.0, n["letters"][i])
        out[i] = [np.log1p(m), size[i] / m, n["upper"][i] / letters, n["symbols"][i] / m, n["digits"][i] / m, n["pipes"][i] / m, n["bangs"][i] / m,
                  len(count) / m, count.max() / m, (w[1:] == w[:-1]).mean() if b - a > 1 else 0.0, np.log1p(n["lines"][i]), m / (n["lines"][i] + 1),
                  len(np.unique(sums)) / max(1, len(sums)), n["stops"][i] / m, pairs / max(1.0, m - 1), n["non_ascii"][i] / size[i], n["commas"][i] / m,
                  (starts_upper[b] - starts_upper[a]) / m]
    return out


def frame(texts: list[str | None]) -> pd.DataFrame:
    return pd.DataFrame(features(texts), columns=NAMES)
