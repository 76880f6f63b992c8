"""Restrictions and intersections of genes and samples."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlab.session import materialise


def restrict_to_shared_genes(edges: DataFrame, m: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges whose both ends are measured, and the matrix rows of their genes."""
    genes = m.select("gene").distinct()
    kept = edges.join(genes.withColumnRenamed("gene", "g1"), "g1", "left_semi").join(genes.withColumnRenamed("gene", "g2"), "g2", "left_semi")
    ends = kept.select(F.col("g1").alias("gene")).union(kept.select("g2")).distinct()
    return kept, m.join(ends, "gene", "left_semi")


def common(tables: list[DataFrame], column: str, at_least: int | None = None) -> DataFrame:
    """Distinct values found in all tables, or in at_least of them."""
    each = reduce(DataFrame.union, [t.select(column).distinct() for t in tables])
    return each.groupBy(column).agg(F.count("*").alias("n")).filter(F.col("n") >= (at_least or len(tables))).select(column)


def complement(members: DataFrame, key: str, every: DataFrame, block: int = 10_000) -> DataFrame:
    """(key, sample): for each key all samples of `every` (one cohort's names) but the key's own.

    Names are dealt by hash into parts of about `block`, and each key meets a part at a time, so no array holds a whole cohort. Null samples
    are no names, repeated rows count once, samples that `every` lacks are passed over, and a null key is a key. A key of null samples
    only has the whole cohort; without keys or names the result is empty.
    """
    kind = every.schema["sample"].dataType
    names = materialise(every.select("sample").filter("sample is not null").distinct(), "cohort")
    parts = max(1, math.ceil(names.count() / block))
    part = F.pmod(F.xxhash64("sample"), F.lit(parts)).cast("int").alias("__part")
    every_part = names.select("sample", part).groupBy("__part").agg(F.collect_set("sample").alias("__all"))
    own = members.select(key, F.col("sample").cast(kind).alias("sample"))
    keys = own.select(key).distinct().select(key, F.lit(None).cast(kind).alias("sample"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("__part"))
    sides = own.filter("sample is not null").select(key, "sample", part).union(keys).groupBy(key, "__part").agg(F.collect_set("sample").alias("__own"))
    return sides.join(every_part, "__part").select(key, F.explode(F.array_except("__all", "__own")).alias("sample"))
