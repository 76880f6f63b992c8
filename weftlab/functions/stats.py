"""Column expressions: log-factorials, hypergeometric tails, ratios of power sums, Jaccard, Benjamini-Hochberg."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: ln(i!) for the first i; beyond them Stirling's series has all digits of a double.
_SMALL = [math.lgamma(i + 1) for i in range(16)]
#: Up to so large a number log-factorials are looked up, which keeps expressions small.
_TABLE = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once: without this, an expression that is used in several places stands, and is planned, in each."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def log_factorial(i: Column, most: int | None = None) -> Column:
    """ln(i!) of a whole number from 0: looked up, if it is known to be at most `most` and that is small, else in closed form."""
    if most is not None and most <= _TABLE:
        return F.get(F.lit(np.array([math.lgamma(k + 1) for k in range(most + 1)])), i.cast("int"))

    def series(x: Column) -> Column:
        return (x + 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0))) - 1 / (1680 * F.pow(x, F.lit(7.0)))

    return let(i.cast("double"), lambda x: F.when(x < len(_SMALL), F.get(F.lit(np.array(_SMALL)), x.cast("int"))).otherwise(series(x)))


def hypergeom_term(x: Column, k: Column, m: Column, n: int) -> Column:
    """P(X = x) for X the overlap of sets of k and m out of n; 0 where it cannot be."""
    lf = lambda i: log_factorial(i, n)
    p = F.exp(lf(k) + lf(n - k) + lf(m) + lf(n - m) - lf(F.lit(n)) - lf(x) - lf(k - x) - lf(m - x) - lf(n - k - m + x))
    return F.when((x >= F.greatest(F.lit(0), k + m - n)) & (x <= F.least(k, m)), p).otherwise(0.0)


def hypergeom_tail(x: Column, k: Column, m: Column, n: int) -> Column:
    """P(X >= x) for X the overlap of sets of k and m out of n.

    Terms are summed away from the middle of the distribution, each from the one before, and only as many as count: over x from
    there upwards, or below x, taken from 1. Null in, null out.
    """

    def placed(s: Column) -> Column:
        middle = F.floor((s["k"] + 1.0) * (s["m"] + 1.0) / F.lit(n + 2.0))
        least, most = F.greatest(F.lit(0).cast("long"), s["k"] + s["m"] - n), F.least(s["k"], s["m"])
        upper = s["x"] > middle
        at = F.when(upper, s["x"]).otherwise(s["x"] - 1)  # the first term of the sum
        return F.struct(s["x"].alias("x"), s["k"].alias("k"), s["m"].alias("m"), least.alias("least"), most.alias("most"), upper.alias("upper"), at.alias("at"))

    def summed(b: Column) -> Column:
        k, m, at, upper = b["k"], b["m"], b["at"], b["upper"]
        part = lambda x: x.cast("double") / float(n)  # noqa: E731  (products of four counts exceed a long from some 55,000 on)
        spread = F.sqrt(part(k) * part(m) * part(n - k) * part(n - m) * (float(n) * n / max(1, n - 1)))
        steps = F.least(F.when(upper, b["most"] - at).otherwise(at - b["least"]), (40 * spread + 60).cast("long"))

        def grow(acc: Column, s: Column) -> Column:
            up, down = at + s, at - s  # from up - 1 to up, from down + 1 to down
            wide = lambda a, b: a.cast("double") * b
            ratio = F.when(upper, wide(k - up + 1, m - up + 1) / wide(up, n - k - m + up)).otherwise(wide(down + 1, n - k - m + down + 1) / wide(k - down, m - down))
            return let(acc["t"] * ratio, lambda t: F.struct(t.alias("t"), (acc["s"] + t).alias("s")))

        def whole(first: Column) -> Column:
            return F.when(steps > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(steps, F.lit(1))), F.struct(first.alias("t"), first.alias("s")), grow)["s"]).otherwise(first)

        p = let(let(hypergeom_term(at, k, m, n), whole), lambda total: F.when(upper, total).otherwise(1 - total))
        return F.when(b["x"] <= b["least"], 1.0).when(b["x"] > b["most"], 0.0).otherwise(F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0)))

    given = F.struct(x.cast("long").alias("x"), k.cast("long").alias("k"), m.cast("long").alias("m"))
    return F.when(x.isNotNull() & k.isNotNull() & m.isNotNull(), let(given, lambda s: let(placed(s), summed)))


def with_tail(df: DataFrame, x: str, k: str, m: str, n: int, out: str = "p") -> DataFrame:
    """df with `out`, the hypergeom_tail of three of its columns, computed once per distinct triple: counts repeat, and the sum is long. df is read
    twice. A null in the triple gives null."""
    triples = df.select(x, k, m).distinct()
    tails = triples.select(F.col(x).alias("__x"), F.col(k).alias("__k"), F.col(m).alias("__m"), hypergeom_tail(F.col(x), F.col(k), F.col(m), n).alias(out))
    return df.join(tails, F.col(x).eqNullSafe(F.col("__x")) & F.col(k).eqNullSafe(F.col("__k")) & F.col(m).eqNullSafe(F.col("__m")), "left").drop("__x", "__k", "__m")


def tail_sql(x: str, k: str, m: str, n: str) -> str:
    """DuckDB text of hypergeom_tail."""
    lf = lambda v: f"lgamma(({v}) + 1.0)"
    return (
        f"CASE WHEN greatest({x}, {k} + {m} - {n}) > least({k}, {m}) THEN 0.0 ELSE least(1.0, list_sum(list_transform(range(CAST(greatest({x}, {k} + {m} - {n}) AS BIGINT), CAST(least({k}, {m}) AS BIGINT) + 1), "
        f"lambda i: exp({lf(k)} + {lf(f'{n} - {k}')} + {lf(m)} + {lf(f'{n} - {m}')} - {lf(n)} - {lf('i')} - {lf(f'{k} - i')} - {lf(f'{m} - i')} - {lf(f'{n} - {k} - {m} + i')})))) END"
    )


def std_of_sums(n: Column, s: Column, ss: Column) -> Column:
    """Population standard deviation from a count, a sum and a sum of squares; null for count 0."""
    mean = F.try_divide(s, n)
    return F.sqrt(F.greatest(F.try_divide(ss, n) - mean * mean, F.lit(0.0)))


def snr(n1: Column, s1: Column, ss1: Column, n: Column, s: Column, ss: Column) -> Column:
    """abs(mean_in - mean_out) / (std_in + std_out) from the power sums inside (1) and of all; null if undefined."""
    n0, s0, ss0 = n - n1, s - s1, ss - ss1
    return F.try_divide(F.abs(F.try_divide(s1, n1) - F.try_divide(s0, n0)), std_of_sums(n1, s1, ss1) + std_of_sums(n0, s0, ss0))


def jaccard(shared: Column, a: Column, b: Column) -> Column:
    """shared / (a + b - shared); 0 when both are empty."""
    return F.coalesce(F.try_divide(shared, a + b - shared), F.lit(0.0))


def bh_adjust(df: DataFrame, p: str, by: list[str], ties: list[str], out: str = "q") -> DataFrame:
    """Benjamini-Hochberg q-values of column p within each group."""
    up = Window.partitionBy(*by).orderBy(p, *ties)
    down = Window.partitionBy(*by).orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0)
    n = F.count("*").over(Window.partitionBy(*by))
    ranked = df.withColumn("__rank", F.row_number().over(up)).withColumn("__q", F.col(p) * n / F.col("__rank"))
    return ranked.withColumn(out, F.least(F.lit(1.0), F.min("__q").over(down))).drop("__rank", "__q")
