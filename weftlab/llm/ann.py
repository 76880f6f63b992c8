"""Approximate nearest neighbours: a forest of random-projection trees searched through one shared priority queue.

Tree nodes split at the median of a random projection, fitted on a bounded sample of at most `SAMPLE` vectors; every row
is then filed into one leaf per tree. A query walks all trees with one queue, ordered by the squared margins of the splits crossed on the way, and takes
leaves until they hold enough rows: a budget that grows with the number of rows to the power 0.75. Candidates of the
leaves are reranked exactly. Leaves are dealt in blocks of bounded size, whatever they hold.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlab.llm.vectors import prepared, stack, unit
from weftlab.session import materialise

SAMPLE = 20_000
TREES = 16
LEAF = 256
MOST_DEPTH = 12
BLOCK = 4096
EFFORT = 8.0


class Forest:
    """Splitting planes of complete binary trees: planes[t] has one row per inner node, cuts[t] its threshold."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int):
        self.depth, self.planes, self.cuts = depth, [], []
        for t in range(trees):
            rng = np.random.default_rng([seed, t])
            planes = rng.standard_normal((2**depth - 1, sample.shape[1]))
            cuts = np.zeros(2**depth - 1)
            node = np.zeros(len(sample), np.int64)
            for level in range(depth):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(node == k)
                    p = sample[rows] @ planes[k]
                    cuts[k] = np.median(p) if len(p) else 0.0
                    node[rows] = 2 * k + 1 + (p > cuts[k])
            self.planes.append(planes)
            self.cuts.append(cuts)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row in every tree."""
        out = np.zeros((len(x), len(self.planes)), np.int64)
        for t, (planes, cuts) in enumerate(zip(self.planes, self.cuts, strict=True)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (np.einsum("ij,ij->i", x, planes[node]) > cuts[node])
            out[:, t] = node - (2**self.depth - 1)
        return out

    def search(self, q: np.ndarray, sizes: np.ndarray, budget: int) -> list[tuple[int, int]]:
        """(tree, leaf) in order of the shared queue until the leaves hold `budget` rows; sizes: rows per tree and leaf."""
        margins = [(p @ q - c) / np.sqrt((p * p).sum(axis=1)) for p, c in zip(self.planes, self.cuts, strict=True)]
        queue = [(0.0, t, 0) for t in range(len(self.planes))]
        first, found, held = 2**self.depth - 1, [], 0
        while queue and held < budget:
            key, t, node = heapq.heappop(queue)
            while node < first:
                m = margins[t][node]
                near, far = (2 * node + 2, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (key + m * m, t, far))
                node = near
            if sizes[t, node - first]:
                found.append((t, node - first))
                held += int(sizes[t, node - first])
        return found


def nearest(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = TREES, leaf: int = LEAF, effort: float = EFFORT, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k nearest rows found by cosine, ties to the smaller id.

    queries has the same two columns; a row is never its own answer. Vectors that are null, empty, zero or hold null or
    non-finite parts, and rows with a null id, take no part. Only vectors of one length are compared. Rows that repeat an id
    count once, with their nearest vector. Fewer than k candidates: all of them. An empty table gives an empty result.
    """
    spark = df.sparkSession
    rows = materialise(prepared(df, id_col, vec_col), "vectors")
    asked = prepared(queries, id_col, vec_col)
    found = None
    for dim in [r["dim"] for r in rows.select("dim").distinct().orderBy("dim").collect()]:
        part = _nearest(rows.filter(F.col("dim") == dim), asked.filter(F.col("dim") == dim), int(dim), k, trees, leaf, effort, seed)
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return found


def _nearest(rows: DataFrame, asked: DataFrame, dim: int, k: int, trees: int, leaf: int, effort: float, seed: int) -> DataFrame:
    spark = rows.sparkSession
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("id")).limit(SAMPLE).select("id", "vec").toPandas().sort_values("id")
    depth = min(MOST_DEPTH, max(0, math.ceil(math.log2(max(1, n / leaf)))))
    forest = Forest(unit(stack(sample["vec"], dim)), trees, depth, seed)
    budget = math.ceil(effort * n**0.75)
    shared = spark.sparkContext.broadcast(forest)  # at most trees * 2**MOST_DEPTH planes

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            leaves = shared.value.leaves(unit(stack(pdf["vec"], dim))) if len(pdf) else np.zeros((0, trees), np.int64)
            yield pd.DataFrame({"id": pdf["id"], "vec": pdf["vec"], "leaves": list(leaves.astype(np.int32))})

    filed = materialise(rows.mapInPandas(file, "id long, vec array<double>, leaves array<int>"), "filed")
    held = filed.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").count()
    sizes = np.zeros((trees, 2**depth), np.int64)
    for r in held.collect():  # one row per leaf: at most trees * 2**MOST_DEPTH
        sizes[r["tree"], r["leaf"]] = r["count"]
    counts = spark.sparkContext.broadcast(sizes)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = unit(stack(pdf["vec"], dim)) if len(pdf) else []
            out = [(i, v, t, at) for i, v, q in zip(pdf["id"], pdf["vec"], x, strict=True) for t, at in shared.value.search(q, counts.value, budget)]
            yield pd.DataFrame(out, columns=["id", "vec", "tree", "leaf"])

    probes = asked.select("id", "vec").repartition(max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))), "id").mapInPandas(walk, "id long, vec array<double>, tree int, leaf int")
    per_leaf = spark.createDataFrame([(t, a, int(-(-sizes[t, a] // BLOCK))) for t in range(trees) for a in range(2**depth) if sizes[t, a]], "tree int, leaf int, blocks int")
    per_leaf = F.broadcast(per_leaf)
    stored = filed.select("id", "vec", F.posexplode("leaves").alias("tree", "leaf")).join(per_leaf, ["tree", "leaf"])
    stored = stored.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    wanted = probes.join(per_leaf, ["tree", "leaf"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ["tree", "leaf", "block"]
    cols = [*key, "id", "vec"]

    def rerank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        right = right.sort_values("id")
        y, out = unit(stack(right["vec"], dim)), []
        ids, first = np.unique(right["id"].to_numpy(), return_index=True)
        for lo in range(0, len(left), 256):
            q = left.iloc[lo : lo + 256]
            s = np.maximum.reduceat(unit(stack(q["vec"], dim)) @ y.T, first, axis=1)  # the best row of each id
            s[q["id"].to_numpy()[:, None] == ids[None, :]] = -2.0
            kept = min(k, len(ids))
            least = -np.partition(-s, kept - 1, axis=1)[:, kept - 1]
            a, b = np.nonzero((s >= least[:, None]) & (s > -1.5))
            hits = pd.DataFrame({"query_id": q["id"].to_numpy()[a], "vec_id": ids[b], "score": s[a, b]}).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
            out.append(hits.drop_duplicates(["query_id", "vec_id"]).groupby("query_id").head(k))
        return pd.concat(out)

    near = wanted.select(*cols).groupBy(*key).cogroup(stored.select(*cols).groupBy(*key)).applyInPandas(rerank, "query_id long, vec_id long, score double")
    once = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k)
    ranked = once.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("pos", "hit"))
    return ranked.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.far")).alias("score"))
