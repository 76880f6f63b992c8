"""Arrow batches in tasks: columns that only pass through keep their exact types and nulls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def add_columns(df: DataFrame, drop: list[str], more: str, run: Callable[[pa.RecordBatch], dict[str, pa.Array]]) -> DataFrame:
    """df without the columns `drop`, with the columns that run() makes of each batch (schema text `more`)."""
    kept = [c for c in df.columns if c not in drop]
    schema = df.select(*kept).schema
    for f in df.sparkSession.createDataFrame([], more).schema:
        schema = schema.add(f)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = run(b)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *made.values()], [*kept, *made])

    return df.mapInArrow(each, schema)


def keep_rows(df: DataFrame, column: str, run: Callable[[list], np.ndarray]) -> DataFrame:
    """Rows of df for which run(values of column) is true."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(run(b.column(column).to_pylist()), pa.bool_()))

    return df.mapInArrow(each, df.schema)
