"""Shared steps on embedding columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: str) -> Column:
    """True for vectors that are not null, empty or zero and hold only finite numbers."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(vec).isNotNull() & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def stack(vecs: pd.Series, dim: int) -> np.ndarray:
    """The vectors as rows of doubles."""
    return np.concatenate(vecs.to_numpy()).astype(np.float64).reshape(-1, dim) if len(vecs) else np.zeros((0, dim))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision; scaled by their largest part first, so nothing overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def prepared(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, dim, vec) of the rows with a usable vector and an id."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return rows.filter(F.col("id").isNotNull() & usable("vec")).select("id", F.size("vec").alias("dim"), "vec")
