"""A generalised additive model with pairwise interactions as quality classifier.

Cyclic gradient boosting over one feature at a time, with trees of at most three leaves on binned values, learns one lookup
table per feature; the strongest pairs of features, by the gain of a four-leaf tree on the residuals, get two-way
tables the same way. Scoring adds up table cells of binned values, for whole batches at once.

It is fitted on the driver from at most `max_rows` labelled rows, a sample by hash of their ids; everything else
covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlab.llm.batches import add_columns, keep_rows
from weftlab.llm.text_features import NAMES, features

MAX_ROWS = 20_000
THRESHOLD = 0.3


@dataclass
class AdditiveModel:
    """intercept, bin edges and a lookup table per feature, and (i, j, coarse edges, table) per pair."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, j], "right")]
        for i, j, ei, ej, t in self.pairs:
            z += t[np.searchsorted(ei, x[:, i], "right"), np.searchsorted(ej, x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values per bin of the best tree of at most three leaves on ordered bins."""

    def cut(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        gl, hl = np.cumsum(g[a : b - 1]), np.cumsum(h[a : b - 1])
        gt, ht = g[a:b].sum(), h[a:b].sum()
        gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
        k = int(gain.argmax())
        return float(gain[k]), a + k + 1

    _, first = cut(0, len(g))
    (gain_l, left), (gain_r, right) = cut(0, first), cut(first, len(g))
    bounds = sorted({0, first, left if gain_l >= gain_r else right, len(g)})
    out = np.zeros(len(g))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best two-cut tree, four leaves, on a grid of bins."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    gt, ht = cg[-1, -1], ch[-1, -1]
    q = []
    for c in (cg, ch):
        a = c[:-1, :-1]
        b, d = c[:-1, -1:] - a, c[-1:, :-1] - a
        q.append((a, b, d, c[-1, -1] - a - b - d))
    if not q[0][0].size:
        return 0.0, np.zeros_like(g)
    gain = sum(x**2 / (y + 1) for x, y in zip(*q, strict=True)) - gt**2 / (ht + 1)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.empty_like(g)
    for s, t, k in ((slice(0, i + 1), slice(0, j + 1), 0), (slice(0, i + 1), slice(j + 1, None), 1), (slice(i + 1, None), slice(0, j + 1), 2), (slice(i + 1, None), slice(j + 1, None), 3)):
        out[s, t] = _leaf(q[0][k][i, j], q[1][k][i, j])
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.15, bins: int = 32, pairs: int = 8, grid: int = 8) -> AdditiveModel:
    """The model of features x (rows x features) and labels y (0 or 1). Without both labels it is constant."""
    p = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    edges = [_edges(x[:, j], bins) for j in range(x.shape[1])] if len(y) else [np.zeros(0)] * x.shape[1]
    model = AdditiveModel(base, edges, [np.zeros(len(e) + 1) for e in edges])
    if len(np.unique(y)) < 2:
        return model
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    z = np.full(len(y), base)

    def sums(cell: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-z))
        return np.bincount(cell, y - q, n), np.bincount(cell, q * (1 - q), n)

    for _ in range(rounds):
        for j, t in enumerate(model.tables):
            step = rate * _tree(*sums(at[j], len(t)))
            t += step
            z += step[at[j]]
    coarse = [_edges(x[:, j], grid) for j in range(x.shape[1])]
    low = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(coarse)]
    shape = lambda i, j: (len(coarse[i]) + 1, len(coarse[j]) + 1)

    def grid_sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = sums(low[i] * shape(i, j)[1] + low[j], shape(i, j)[0] * shape(i, j)[1])
        return g.reshape(shape(i, j)), h.reshape(shape(i, j))

    gains = sorted(((_quadrants(*grid_sums(i, j))[0], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)
    model.pairs = [(i, j, coarse[i], coarse[j], np.zeros(shape(i, j))) for _, i, j in gains[:pairs]]
    for _ in range(rounds // 3):
        for i, j, _, _, t in model.pairs:
            step = rate * _quadrants(*grid_sums(i, j))[1]
            t += step
            z += step[low[i], low[j]]
    return model


def remainder(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> AdditiveModel:
    """Fit on labelled rows whose remainder is not 0: at most max_rows of them, by hash of the id. Null labels are skipped."""
    chosen = labels.filter((remainder(F.col(id_col)) != 0) & F.col(target).isNotNull()).select(F.col(id_col).alias("__id"), F.col(target).cast("int").alias("__y"))
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id", "__y").limit(max_rows)
    docs = docs.select(id_col, text_col)
    rows = docs.join(F.broadcast(chosen), docs[id_col] == F.col("__id")).select(F.col("__id"), F.col("__y").alias("y"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["__id"], "y": pdf["y"], **dict(zip(NAMES, features(pdf["text"].tolist()).T, strict=True))})

    got = rows.mapInPandas(run, "id long, y int, " + ", ".join(f"{n} double" for n in NAMES)).toPandas().sort_values(["id", "y", *NAMES])
    return fit(got[NAMES].to_numpy(float), got["y"].to_numpy(int))


def score(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; null and empty texts are scored like texts without words."""

    def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
        s = model.score(features(b.column("text").to_pylist()))
        return {"score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(remainder(F.col(id_col)) == 0, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return add_columns(rows, ["text"], "score double, predicted int", run)


def keep_good(docs: DataFrame, model: AdditiveModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs that score at least threshold; columns as in docs. Repeated rows are judged alike."""
    return keep_rows(docs, text_col, lambda texts: model.score(features(texts)) >= threshold)
