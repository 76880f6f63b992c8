"""Null distributions from random connected gene sets."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlab.functions.ordering import numbered
from weftlab.operators import bicluster
from weftlab.operators.arrays import columns, stored_matrix
from weftlab.operators.network import canonical_edges, incidence
from weftlab.session import materialise, release


#: Edges of a network that a worker holds as arrays (80 MB); beyond it the walks meet the edges in joins.
MOST_EDGES = 10_000_000
#: Steps of the walks of a task, about, and rows of a table that it gives out.
STEPS, ROWS = 250_000, 50_000


def random_connected_subnets(edges: DataFrame, sizes: list[int], n: int, seed: int = 1, max_restarts: int = 10, most_edges: int = MOST_EDGES) -> DataFrame:
    """(size, walk, gene): n random connected gene sets of each size; those that give up after max_restarts starts leave no rows.

    A set grows from its last gene to one of the unseen neighbours, else from a member that has several, else it starts anew. Up to most_edges
    edges each walk runs within a task over the whole network, 4 bytes a neighbour; beyond that all walks take their steps together, by joins
    with the edges. Both draw by the same hash of the seed, the set, its start and its size, so they find the same sets. Null ends and self-loops are left out, repeated edges count once.
    """
    both, walks = _neighbours(edges), _walks(edges.sparkSession, sizes, n)
    if both.count() > 2 * most_edges:
        return _by_joins(both, walks, seed, max_restarts)
    return _within_tasks(both, _dealt(walks, sizes, n), seed, max_restarts)


def _neighbours(edges: DataFrame) -> DataFrame:
    """(gene, nbr): both ways of each edge, written."""
    both = incidence(canonical_edges(edges), "g1", "g2").select("gene", F.when(F.col("gene") == F.col("g1"), F.col("g2")).otherwise(F.col("g1")).alias("nbr"))
    return materialise(both, "both-ways")


def _walks(spark: SparkSession, sizes: list[int], n: int) -> DataFrame:
    """(size, walk), n of each size."""
    return spark.createDataFrame([(k,) for k in sizes], "size int").withColumn("walk", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def _by_joins(both: DataFrame, walks: DataFrame, seed: int, max_restarts: int) -> DataFrame:
    """The walks as a table that takes one step a round: (size, walk, start, seen, at).

    Neighbours are numbered over the whole table, so that drawing one is a join on a unique number, however many a gene has. Free
    neighbours of a gene are its degree less the members among its neighbours, which are as few as a set has genes.
    """
    edges = materialise(numbered(both, ["gene", "nbr"], "nth"), "neighbours")
    degrees = edges.groupBy("gene").agg(F.min("nth").alias("low"), F.count("*").alias("degree"))
    genes = materialise(numbered(degrees, ["gene"], "number"), "genes")
    n_genes = genes.count()
    key = ["size", "walk"]

    def draw(below: Column, *what: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), *key, "start", F.size("seen"), *[F.lit(w) for w in what]), below)

    def started(rows: DataFrame) -> DataFrame:
        first = rows.withColumn("seen", F.array().cast(seen_type)).withColumn("number", draw(F.lit(n_genes), "start"))
        return first.join(genes.select("number", F.col("gene").alias("at")), "number").select(*key, "start", F.array("at").alias("seen"), "at")

    def free(rows: DataFrame) -> DataFrame:
        """rows (with gene) and (low, free, taken): the numbers of its neighbours that are members, sorted."""
        among = rows.select(*key, "gene", F.explode("seen").alias("nbr")).join(edges, ["gene", "nbr"])
        taken = among.groupBy(*key, "gene").agg(F.array_sort(F.collect_list("nth")).alias("taken"))
        known = rows.join(genes.select("gene", "low", "degree"), "gene").join(taken, [*key, "gene"], "left")
        known = known.withColumn("taken", F.coalesce("taken", F.array().cast("array<long>")))
        return known.withColumn("free", F.col("degree") - F.size("taken"))

    seen_type = f"array<{both.schema['gene'].dataType.simpleString()}>"
    state = materialise(started(walks.withColumn("start", F.lit(1))), "walks")
    found = []
    while True:
        done = state.filter(F.size("seen") >= F.col("size"))
        found.append(done.select(*key, F.explode("seen").alias("gene")))
        going = state.filter(F.size("seen") < F.col("size"))
        if going.isEmpty():
            break
        ends = materialise(free(going.withColumn("gene", F.col("at"))), "ends")
        skip = F.aggregate("taken", F.col("low") + draw(F.col("free"), "step"), lambda at, x: F.when(x <= at, at + 1).otherwise(at))
        grown = ends.filter("free > 0").withColumn("nth", skip).drop("gene").join(edges.select("nth", "nbr"), "nth")
        grown = grown.select(*key, "start", F.concat("seen", F.array("nbr")).alias("seen"), F.col("nbr").alias("at"))
        stuck = ends.filter("free = 0").select(*key, "start", "seen")
        roots = free(stuck.withColumn("gene", F.explode("seen"))).filter("free > 1").groupBy(*key).agg(F.array_sort(F.collect_list("gene")).alias("roots"))
        turned = materialise(stuck.join(roots, key, "left"), "stuck")
        back = turned.filter("roots is not null").withColumn("at", F.element_at("roots", (draw(F.size("roots"), "root") + 1).cast("int")))
        anew = started(turned.filter("roots is null").select(*key, (F.col("start") + 1).alias("start")).filter(F.col("start") <= max_restarts))
        state = materialise(grown.unionByName(back.select(*key, "start", "seen", "at")).unionByName(anew), "walks")
        release(ends, turned)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _hashed(parts: tuple[int | str, ...], h: int = 42) -> int:
    """What xxhash64 of parts is in Spark, whole numbers being 32 bits wide, as an unsigned number; h: that of the parts before."""
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else p.to_bytes(4, "little", signed=True), h)
    return h


class Network:
    """Neighbours of genes as numbers, in arrays; one is held by a Python worker."""

    def __init__(self, path: str, n_genes: int):
        a, b = columns(path, "a", "b")
        key = a.astype(np.int64) * n_genes + b
        del a, b
        key.sort()
        self.first = np.searchsorted(key, np.arange(n_genes + 1, dtype=np.int64) * n_genes)
        self.nbrs = (key % max(1, n_genes)).astype(np.int32)
        self.n_genes = n_genes

    _held: dict[str, Network] = {}

    @classmethod
    def of(cls, path: str, n_genes: int) -> Network:
        if path not in cls._held:
            cls._held.clear()
            cls._held[path] = cls(path, n_genes)
        return cls._held[path]

    def walk(self, size: int, number: int, seed: int, max_restarts: int) -> np.ndarray:
        """Grow from the last gene to one of its unseen neighbours, else from a member that has several, else start anew; the genes found, ascending.

        The members with several unseen neighbours are kept in order, so a step looks at the neighbours of a gene or two, however large the set is.
        """
        nbrs, first = self.nbrs, self.first
        for start in range(1, max_restarts + 1 if self.n_genes else 1):
            unseen: dict[int, int] = {}  # of each member, the number of its unseen neighbours
            roots: list[int] = []
            drawn = _hashed((seed, size, number, start))

            def draw(below: int, what: str) -> int:
                h = _hashed((len(unseen), what), drawn)
                return (h - (1 << 64) if h >> 63 else h) % below

            def add(x: int) -> list[int]:
                fresh = []
                for y in nbrs[first[x] : first[x + 1]].tolist():
                    if y in unseen:
                        unseen[y] -= 1
                        if unseen[y] == 1:
                            del roots[bisect_left(roots, y)]
                    else:
                        fresh.append(y)
                unseen[x] = len(fresh)
                if len(fresh) > 1:
                    insort(roots, x)
                return fresh

            fresh = add(draw(self.n_genes, "start"))
            while len(unseen) < size:
                if fresh:
                    fresh = add(fresh[draw(len(fresh), "step")])
                elif roots:
                    at = roots[draw(len(roots), "root")]
                    fresh = [y for y in nbrs[first[at] : first[at + 1]].tolist() if y not in unseen]
                else:
                    break
            if len(unseen) == size:
                return np.array(sorted(unseen), np.int64)
        return np.zeros(0, np.int64)


def _numbered_network(both: DataFrame) -> tuple[DataFrame, str, int]:
    """(genes with their number, path of the neighbours as numbers a, b, number of genes). All is written by tasks; a worker reads the arrays."""
    genes = materialise(numbered(both.select("gene").distinct(), ["gene"], "nth"), "network-genes")
    ends = both.join(genes.withColumnRenamed("nth", "a"), "gene").join(genes.select(F.col("gene").alias("nbr"), F.col("nth").alias("b")), "nbr")
    return genes, materialise(ends.select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b")), "network-ends").materialised_at, genes.count()


def _dealt(walks: DataFrame, sizes: list[int], n: int) -> DataFrame:
    """The walks over tasks of some STEPS steps each."""
    return walks.repartition(max(32, min(20_000, sum(sizes) * n // STEPS)), "size", "walk")


def _within_tasks(both: DataFrame, walks: DataFrame, seed: int, max_restarts: int) -> DataFrame:
    """The walks dealt over tasks, over the network as arrays."""
    genes, path, n_genes = _numbered_network(both)
    named = genes.materialised_at
    kind = both.schema["gene"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net, held, rows = Network.of(path, n_genes), [], 0
        at, name = columns(named, "nth", "gene")
        names = name[np.argsort(at)]

        def out() -> pd.DataFrame:
            k = [len(g) for _, _, g in held]
            return pd.DataFrame({"size": np.repeat([s for s, _, _ in held], k), "walk": np.repeat([w for _, w, _ in held], k), "gene": names[np.concatenate([g for _, _, g in held])]})

        for pdf in batches:
            for size, w in zip(pdf["size"].tolist(), pdf["walk"].tolist(), strict=True):
                held.append((size, w, net.walk(size, w, seed, max_restarts)))
                rows += len(held[-1][2])
                if rows >= ROWS:
                    yield out()
                    held.clear()
                    rows = 0
        if held:
            yield out()

    return walks.mapInPandas(run, f"size int, walk int, gene {kind}")


def null_distribution(edges: DataFrame, m: DataFrame, sizes: list[int], n: int, seed: int = 1, max_restarts: int = 10, most_edges: int = MOST_EDGES) -> DataFrame:
    """(n_genes, n_samples, avgSNR) of n random connected sets per size: SNR of the smaller of two sample clusters, and its size.

    Up to most_edges edges a set is walked, split and scored where it is drawn, over the network and the rows of the matrix in the shared folder, so that no
    row stands for a gene of a set; beyond that the sets are a table, as random_connected_subnets gives it.
    """
    both = _neighbours(edges)
    total = m.select("sample").distinct().count()
    if both.count() > 2 * most_edges:
        sets = random_connected_subnets(edges, sizes, n, seed, max_restarts, most_edges).withColumn("id", F.col("size").cast("long") * n + F.col("walk"))  # walks are below n
        members = sets.select("id", "gene")
        chosen = bicluster.discordant_sample_set(members, m, total, min_n_samples=1)
        rows = bicluster.bicluster_snr(members, chosen, m).join(chosen.groupBy("id").agg(F.count("*").alias("n_samples")), "id")
        return rows.select(F.floor(F.col("id") / n).alias("n_genes"), "n_samples", "avgSNR")
    genes, path, n_genes = _numbered_network(both)
    samples = numbered(m.select("sample").distinct(), ["sample"], "__s")
    cells = m.join(genes.withColumnRenamed("nth", "__g"), "gene").join(samples, "sample").select(F.col("__g").alias("gene"), F.col("__s").alias("sample"), "value")
    matrix = stored_matrix(cells, total)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = Network.of(path, n_genes)
        for pdf in batches:
            rows = []
            for size, w in zip(pdf["size"].tolist(), pdf["walk"].tolist(), strict=True):
                values, kinds = matrix.take(net.walk(size, w, seed, max_restarts))
                held = kinds.any(axis=0)
                if held.any():
                    values, known = values[:, held], kinds[:, held] > 1
                    label = bicluster.two_means(np.ascontiguousarray(values.T))
                    ones = int(label.sum())
                    if 0 < ones < len(label):
                        rows.append((size, min(ones, len(label) - ones), bicluster.split_snr(values, known, label > 0)))
            yield pd.DataFrame(rows, columns=["n_genes", "n_samples", "avgSNR"]).astype({"avgSNR": "Float64"})

    return _dealt(_walks(edges.sparkSession, sizes, n), sizes, n).mapInPandas(run, "n_genes long, n_samples long, avgSNR double")
