"""Harmonising clinical annotations, one row per sample."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_rename(table: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """The chosen variables under their new names."""
    return table.select(*[F.col(old).alias(new) for old, new in names.items()])


def combine(left: DataFrame, right: DataFrame, key: str = "sample") -> DataFrame:
    """Two annotation tables side by side, for the samples of the first. Columns of the second that clash are dropped."""
    extra = [c for c in right.columns if c == key or c not in left.columns]
    return left.join(right.select(*extra), key, "left")


def fill_na(table: DataFrame, columns: list[str], by: str = "NA") -> DataFrame:
    return table.fillna(by, subset=columns)


def recode(table: DataFrame, column: str, codes: Mapping[str, str], strip: str = "", strict: bool = True) -> DataFrame:
    """column with `strip` removed and mapped by codes. Values without a code are an error, or kept if not strict; null stays."""
    value = F.regexp_replace(column, strip, "") if strip else F.col(column)
    pairs = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    unknown = F.raise_error(F.concat(F.lit(f"no code for {column} = "), value)).cast("string") if strict else value
    return table.withColumn(column, F.when(value.isNull(), F.lit(None)).when(F.map_contains_key(pairs, value), pairs[value]).otherwise(unknown))


def rejects(table: DataFrame, column: str, codes: Mapping[str, str], strip: str = "") -> DataFrame:
    """Rows whose value has no code."""
    value = F.regexp_replace(column, strip, "") if strip else F.col(column)
    return table.filter(value.isNotNull() & ~value.isin(*codes))


def domains(table: DataFrame, columns: list[str], cohort: str) -> DataFrame:
    """(cohort, variable, domain): sorted distinct values of each variable."""
    long = table.select(F.lit(cohort).alias("cohort"), *columns).unpivot(["cohort"], columns, "variable", "value")
    return long.groupBy("cohort", "variable").agg(F.array_sort(F.collect_set("value")).alias("domain"))


def stack(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All cohorts as one table, with a column cohort; variables that a cohort lacks are null."""
    out = None
    for name, t in tables.items():
        t = t.withColumn("cohort", F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out
