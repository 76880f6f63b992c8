"""Cleaning of expression matrices in long form (gene, sample, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlab.functions.ordering import numbered


def bad_value_census(m: DataFrame) -> DataFrame:
    """One row: counts and percentages of NaN, infinite and zero cells, and the dimensions. Null counts as NaN."""
    v = F.col("value")
    nan, inf, zero = v.isNull() | F.isnan(v), F.abs(v) == float("inf"), v == 0
    n = F.count("*")
    one = lambda c, name: [F.count_if(c).alias(f"n_{name}"), F.try_divide(100.0 * F.count_if(c), n).alias(f"pct_{name}")]
    return m.agg(n.alias("n_cells"), F.countDistinct("gene").alias("n_genes"), F.countDistinct("sample").alias("n_samples"), *one(nan, "nan"), *one(inf, "inf"), *one(zero, "zero"))


def fill_missing(m: DataFrame, by: float = 0.0) -> DataFrame:
    """NaN and null values become `by`."""
    return m.withColumn("value", F.coalesce(F.nanvl("value", F.lit(by)), F.lit(by)))


def prevalence_filter(m: DataFrame, share: float = 0.05) -> DataFrame:
    """Genes with non-zero values in strictly more than `share` of all samples."""
    n = m.agg(F.countDistinct("sample").alias("n_all"))
    kept = m.groupBy("gene").agg(F.count_if(F.col("value") != 0).alias("n")).join(F.broadcast(n)).filter(F.col("n") > share * F.col("n_all"))
    return m.join(kept.select("gene"), "gene", "left_semi")


def drop_duplicate_profiles(m: DataFrame) -> DataFrame:
    """Genes whose whole profile repeats that of a smaller gene are dropped. Profiles meet by hash, then in full."""
    profile = m.groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("sample", "value"))).alias("profile"))
    w = Window.partitionBy("h", "profile").orderBy("gene")
    kept = profile.withColumn("h", F.xxhash64("profile")).withColumn("nth", F.row_number().over(w)).filter("nth = 1")
    return m.join(kept.select("gene"), "gene", "left_semi")


def log2_transform(m: DataFrame) -> DataFrame:
    """log2(value + 1); null stays null, values under -1 become NaN or null as Spark's log2 gives."""
    return m.withColumn("value", F.log2(F.col("value") + 1))


def zscore_genes(m: DataFrame) -> DataFrame:
    """(value - mean) / population standard deviation per gene; null for a constant gene."""
    w = Window.partitionBy("gene")
    return m.withColumn("value", F.try_divide(F.col("value") - F.avg("value").over(w), F.stddev_pop("value").over(w)))


def duplicate_gene_check(names: DataFrame, col: str = "gene") -> DataFrame:
    """(gene, n) of names that occur more than once."""
    return names.groupBy(F.col(col).alias("gene")).agg(F.count("*").alias("n")).filter("n > 1")


def assign_ids(names: DataFrame, col: str, out: str) -> DataFrame:
    """(col, out): dense ids from 0 in name order. Null names are left out, repeated ones count once."""
    distinct = names.select(col).distinct().filter(F.col(col).isNotNull())
    return numbered(distinct, [col], out).withColumn(out, F.col(out).cast("int"))


def map_back(ids: DataFrame, key: str, named: DataFrame) -> DataFrame:
    """Names for ids, by an equi-join on key."""
    return ids.join(named, key)


def gene_power_sums(m: DataFrame) -> DataFrame:
    """(gene, n, s, ss)."""
    return m.groupBy("gene").agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))


def filter_by_snr(bics: DataFrame, least: float) -> DataFrame:
    """Rows with avgSNR of at least `least`; a null avgSNR goes."""
    return bics.filter(F.col("avgSNR") >= least)


def random_sample_profiles(m: DataFrame, n: int, bins: int, low: float, high: float, seed: int = 1) -> DataFrame:
    """(sample, bin, n_values): histogram of the values of n samples chosen by a seeded hash."""
    chosen = m.select("sample").distinct().withColumn("h", F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("sample").cast("string")))).orderBy("h").limit(n).select("sample")
    return m.join(F.broadcast(chosen), "sample", "left_semi").groupBy("sample", F.width_bucket("value", F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n_values"))
