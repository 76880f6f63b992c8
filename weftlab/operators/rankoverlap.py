"""Rank-rank overlap: from the expression of both ends to the samples of an edge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from weftlab.functions.stats import hypergeom_tail, hypergeom_term, snr
from weftlab.operators.network import drop_small_components
from weftlab.session import materialise


def rank_samples(m: DataFrame, direction: str = "UP") -> DataFrame:
    """m with rnk, from 0: highest value first for UP, lowest first for DOWN; ties by sample."""
    value = F.desc("value") if direction == "UP" else F.asc("value")
    return m.withColumn("rnk", F.row_number().over(Window.partitionBy("gene").orderBy(value, "sample")) - 1)


def cutoffs(n: int, step: int) -> list[int]:
    """The grid of cut-offs: int(n / 2) down to 1 by step."""
    return list(range(n // 2, 0, -step))


def overlap_thresholds(spark, n: int, step: int, p: float) -> DataFrame:
    """(tu, tw, min_overlap): the smallest overlap from which on every overlap up to min(tu, tw) has a right tail below p; n if none.
    The grid has (n / 2 / step) squared cells, whatever the data."""
    grid = cutoffs(n, step)
    one = spark.createDataFrame([(t,) for t in grid], "tu int")
    cells = one.withColumn("tw", F.explode(F.lit(grid))).withColumn("x", F.explode(F.sequence(F.lit(0), F.least("tu", "tw"))))
    down = Window.partitionBy("tu", "tw").orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, 0)
    tail = cells.withColumn("term", hypergeom_term(F.col("x"), F.col("tu"), F.col("tw"), n)).withColumn("ok", F.sum("term").over(down) < p)
    run = tail.withColumn("all_ok", F.min(F.col("ok").cast("int")).over(down) == 1)
    return run.groupBy("tu", "tw").agg(F.coalesce(F.min(F.when(F.col("all_ok"), F.col("x"))), F.lit(n)).cast("int").alias("min_overlap"))


def edge_profiles(edges: DataFrame, ranked: DataFrame, below: int | None = None) -> DataFrame:
    """(g1, g2, sample, r1, v1, r2, v2): both ends' rank and value per sample; with `below` only samples under that rank in both,
    filtered before the joins."""
    few = ranked if below is None else ranked.filter(F.col("rnk") < below)
    a = few.select(F.col("gene").alias("g1"), "sample", F.col("rnk").alias("r1"), F.col("value").alias("v1"))
    b = few.select(F.col("gene").alias("g2"), "sample", F.col("rnk").alias("r2"), F.col("value").alias("v2"))
    return edges.select("g1", "g2").join(a, "g1").join(b, ["g2", "sample"])


def top_overlap_test(edges: DataFrame, ranked: DataFrame, n: int, tu: int, tw: int, items: bool = False) -> DataFrame:
    """(g1, g2, overlap, p, enrichment[, samples]) of the tops of both ends; edges without overlap have overlap 0 and p 1."""
    a = ranked.filter(F.col("rnk") < tu).select(F.col("gene").alias("g1"), "sample")
    b = ranked.filter(F.col("rnk") < tw).select(F.col("gene").alias("g2"), "sample")
    both = edges.select("g1", "g2").join(a, "g1").join(b, ["g2", "sample"]).groupBy("g1", "g2").agg(F.count("*").alias("overlap"), *([F.array_sort(F.collect_list("sample")).alias("samples")] if items else []))
    out = edges.select("g1", "g2").join(both, ["g1", "g2"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0).cast("long")))
    tails = edges.sparkSession.range(min(tu, tw) + 1).select(F.col("id").alias("overlap"), hypergeom_tail(F.col("id"), F.lit(tu), F.lit(tw), n).alias("p"))
    out = out.join(F.broadcast(tails), "overlap")  # a row per possible overlap
    return out.select("g1", "g2", "overlap", "p", (F.col("overlap") / (tu * tw / n)).alias("enrichment"), *(["samples"] if items else []))


def gene_profiles(ranked: DataFrame, below: int) -> DataFrame:
    """(gene, n, s, ss, samples, values): count and power sums of each gene's values, and its samples of rank below `below` in their order."""
    top = F.array_sort(F.collect_list(F.when(F.col("rnk") < below, F.struct("rnk", "sample", "value"))))
    rows = ranked.groupBy("gene").agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"), top.alias("top"))
    return rows.select("gene", "n", "s", "ss", F.col("top.sample").alias("samples"), F.col("top.value").alias("values"))


def _edge_rows(edges: DataFrame, ranked: DataFrame, n: int) -> DataFrame:
    """A row per edge with the profiles of both ends (columns with 1 and 2); no row per sample."""
    profiles = gene_profiles(ranked, n // 2)
    end = lambda i: profiles.select(F.col("gene").alias(f"g{i}"), *[F.col(c).alias(f"{c}{i}") for c in profiles.columns[1:]])
    return edges.select("g1", "g2").join(end(1), "g1").join(end(2), "g2")


class _Corners:
    """Summed-area tables of the edges of a batch: counts and power sums of both ends in every corner of the grid of cut-offs."""

    def __init__(self, batch: pa.RecordBatch, n: int, step: int):
        mid, self.k, self.edges = n // 2, len(cutoffs(n, step)), batch.num_rows
        lists = [[batch.column(f"{c}{i}") for c in ("samples", "values")] for i in (1, 2)]
        code = pa.concat_arrays([x[0].flatten() for x in lists]).dictionary_encode()
        self.names, codes = code.dictionary, code.indices.to_numpy()
        size = [np.asarray(x[0].value_lengths()) for x in lists]
        edge = [np.repeat(np.arange(self.edges), m) for m in size]
        rank = [np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) for m in size]
        value = [x[1].flatten().fill_null(0.0).to_numpy(zero_copy_only=False) for x in lists]
        key = [edge[0] * len(self.names) + codes[: len(edge[0])], edge[1] * len(self.names) + codes[len(edge[0]) :]]
        _, at, bt = np.intersect1d(*key, assume_unique=True, return_indices=True)
        self.edge, self.sample, self.ranks = edge[0][at], codes[at], (rank[0][at], rank[1][bt])
        v = (value[0][at], value[1][bt])
        cell = [np.minimum((mid - r - 1) // step, self.k - 1) for r in self.ranks]
        place = (self.edge * self.k + cell[0]) * self.k + cell[1]
        self.sums = []
        for w in (None, v[0], v[0] * v[0], v[1], v[1] * v[1]):
            cells = np.bincount(place, w, self.edges * self.k**2).reshape(self.edges, self.k, self.k)
            self.sums.append(cells[:, ::-1, ::-1].cumsum(axis=1).cumsum(axis=2)[:, ::-1, ::-1])
        self.cut = mid - step * np.arange(self.k)

    def snr(self, batch: pa.RecordBatch) -> np.ndarray:
        """The mean of both ends' ratios in every corner; NaN if undefined."""
        got = np.zeros(self.sums[0].shape)
        n1 = self.sums[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            for i in (1, 2):
                n, s, ss = (batch.column(f"{c}{i}").to_numpy(zero_copy_only=False).astype(np.float64)[:, None, None] for c in ("n", "s", "ss"))
                s1, ss1 = self.sums[2 * i - 1], self.sums[2 * i]
                std = lambda n, s, ss: np.sqrt(np.maximum(ss / n - (s / n) ** 2, 0.0))
                spread = std(n1, s1, ss1) + std(n - n1, s - s1, ss - ss1)
                got += np.where(spread > 0, np.abs(s1 / n1 - (s - s1) / (n - n1)) / spread, np.nan)
        return got / 2


def overlap_grid(edges: DataFrame, ranked: DataFrame, n: int, step: int) -> DataFrame:
    """(g1, g2, c1, c2, tu, tw, n, s1, ss1, s2, ss2): samples in each corner top-tu x top-tw, and the sums of both ends' values there.
    c counts cells inwards from the widest cut-off; corners of the whole grid are present for edges with any sample.

    Each end's profile is one row, joined with the edges; a corner's sums come from a summed-area table of the edge, in its task.
    """
    rows = _edge_rows(edges, ranked, n)
    out = rows.select("g1", "g2").schema.add("c1", "integer").add("c2", "integer").add("tu", "integer").add("tw", "integer").add("n", "long")
    for c in ("s1", "ss1", "s2", "ss2"):
        out = out.add(c, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches, len(cutoffs(n, step)) ** 2):
            got = _Corners(batch, n, step)
            some = np.flatnonzero(got.sums[0][:, 0, 0] > 0)
            e, c1, c2 = (x.ravel() for x in np.meshgrid(some, np.arange(got.k), np.arange(got.k), indexing="ij"))
            at = pa.array(e)
            cells = [c1.astype(np.int32), c2.astype(np.int32), got.cut[c1].astype(np.int32), got.cut[c2].astype(np.int32), got.sums[0][some].ravel().astype(np.int64), *(s[some].ravel() for s in got.sums[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("g1").take(at), batch.column("g2").take(at), *map(pa.array, cells)], out.names)

    return rows.mapInArrow(run, out)


def _few(batches: Iterator[pa.RecordBatch], cells: int, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Batches of so many edges that their tables stay small."""
    size = max(1, most // max(1, cells))
    for batch in batches:
        for lo in range(0, batch.num_rows, size):
            yield batch.slice(lo, size)


def corner_snr(grid: DataFrame, sums: DataFrame) -> DataFrame:
    """grid with snr, the mean over both ends. sums: gene_power_sums."""
    of = lambda g, i: sums.select(F.col("gene").alias(g), F.col("n").alias(f"t{i}"), F.col("s").alias(f"ts{i}"), F.col("ss").alias(f"tss{i}"))
    both = grid.join(of("g1", 1), "g1").join(of("g2", 2), "g2")
    side = lambda i: snr(F.col("n"), F.col(f"s{i}"), F.col(f"ss{i}"), F.col(f"t{i}"), F.col(f"ts{i}"), F.col(f"tss{i}"))
    return both.withColumn("snr", (side(1) + side(2)) / 2).drop("t1", "ts1", "tss1", "t2", "ts2", "tss2")


def best_corner(edges: DataFrame, ranked: DataFrame, n: int, step: int, thresholds: DataFrame, min_n_samples: int, min_snr: float, with_samples: bool = False) -> DataFrame:
    """(g1, g2, tu, tw, n, snr[, samples]) of the best corner of each edge that has one; samples: those in it, in no order.

    Anti-diagonals c1 + c2 are walked from the widest corner; the walk ends after the first with a hit (n above its threshold and snr at
    least min_snr) or with any n <= min_n_samples, and before the first with a cut-off <= 0. Best: most samples, then
    smallest abs(tu - tw), then smallest c1. Undefined ratios are no hits. thresholds: overlap_thresholds of the same n and step; it is
    gathered, as its size is that of the grid whatever the data.
    """
    rows = _edge_rows(edges, ranked, n)
    k = len(cutoffs(n, step))
    least = np.full((n + 1, n + 1), n)
    for r in thresholds.collect():
        least[r["tu"], r["tw"]] = r["min_overlap"]
    kind = ranked.schema["sample"].dataType
    out = rows.select("g1", "g2").schema.add("tu", "integer").add("tw", "integer").add("n", "long").add("snr", "double")
    if with_samples:
        out = out.add("samples", ArrayType(kind))
    cut = n // 2 - step * np.arange(k)
    needed = least[np.ix_(cut, cut)]
    c1, c2 = np.indices((k, k))
    diagonal = c1 + c2
    order = (k * np.abs(c1 - c2) + c1)[None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches, k**2):
            got = _Corners(batch, n, step)
            size, ratio = got.sums[0].astype(np.int64), got.snr(batch)
            hit = (size > needed) & (ratio >= min_snr)
            end = np.where(hit | (size <= min_n_samples), diagonal, k - 1).min(axis=(1, 2))
            seen = hit & (diagonal <= np.minimum(end, k - 1)[:, None, None])
            worth = np.where(seen, size * k**3 - order, -1).reshape(len(seen), -1)
            at = worth.argmax(axis=1)
            edge = np.flatnonzero(seen.any(axis=(1, 2)))
            u, w = at[edge] // k, at[edge] % k
            cols = [*(batch.column(g).take(pa.array(edge)) for g in ("g1", "g2")), *(pa.array(cut[x].astype(np.int32)) for x in (u, w)), pa.array(size[edge, u, w]), pa.array(ratio[edge, u, w])]
            if with_samples:
                limit = np.zeros((2, got.edges), np.int64)
                limit[0, edge], limit[1, edge] = cut[u], cut[w]
                inside = (got.ranks[0] < limit[0, got.edge]) & (got.ranks[1] < limit[1, got.edge])
                counts = np.bincount(got.edge[inside], minlength=got.edges)[edge]
                cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), got.names.take(pa.array(got.sample[inside]))))
            yield pa.RecordBatch.from_arrays(cols, out.names)

    return rows.mapInArrow(run, out)


def assign_samples_to_edges(edges: DataFrame, m: DataFrame, direction: str = "UP", p: float = 0.01, min_snr: float = 0.0, min_n_samples: int | None = None, k: int = 3) -> DataFrame:
    """(g1, g2, sample): the samples in which both ends are extreme; edges with fewer than min_n_samples and components of fewer
    than k genes are dropped. Default for min_n_samples: the larger of 10 and a twentieth of the samples. A gene has one value per sample."""
    n = m.select("sample").distinct().count()
    step = max(1, n // 100)
    least = min_n_samples if min_n_samples is not None else max(10, int(0.05 * n))
    best = best_corner(edges, rank_samples(m, direction), n, step, overlap_thresholds(m.sparkSession, n, step, p), least, min_snr, with_samples=True).filter(F.col("n") >= least)
    best = materialise(best, "best-corners")
    kept = drop_small_components(best.select("g1", "g2"), k)
    return best.join(kept, ["g1", "g2"], "left_semi").select("g1", "g2", F.explode("samples").alias("sample"))


#: Edges that an SNR threshold is taken from.
SIZE = 1000


def threshold_edges(edges: DataFrame, size: int | None = None) -> DataFrame:
    """The `size` (by default SIZE) edges, chosen by hash, that snr_threshold reads (all, if fewer): no other edge needs a score."""
    return edges.orderBy(F.md5(F.concat_ws("-", F.col("g1").cast("string"), F.col("g2").cast("string")))).limit(SIZE if size is None else size)


def snr_threshold(edges: DataFrame, avg_snr: Column | str, q: float = 0.1, size: int | None = None) -> DataFrame:
    """One row: the 1 - q quantile of avg_snr (-1 where rejected) over the threshold_edges, to 3 decimals."""
    chosen = threshold_edges(edges, size)
    return chosen.agg(F.round(F.percentile(F.coalesce(avg_snr, F.lit(-1.0)), 1 - q), 3).alias("min_snr"))


def edge_sample_distribution(edge_samples: DataFrame, bins: int, high: int) -> DataFrame:
    """(bin, n_edges): how many samples the edges hold, in equal bins of [0, high)."""
    sizes = edge_samples.groupBy("g1", "g2").agg(F.count("*").cast("double").alias("n"))
    return sizes.groupBy(F.width_bucket("n", F.lit(0.0), F.lit(float(high)), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n_edges"))
