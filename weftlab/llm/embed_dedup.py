"""Near-duplicate vectors by sorted projection passes.

Each pass gives every distinct vector a code of concatenated random hyperplane signs, orders all vectors lexicographically
by it and compares each with the next `WINDOW` ones. Verified pairs of all passes are united into components. The number of passes follows
from the chosen miss probability of a pair at the threshold and from how crowded the vectors lie: a pair shares a window when enough signs
agree to leave at most a window of others, and the number of others after b equal signs is measured on a bounded sample. Since a window cannot hold
a large group, the links of each vector are then counted against its whole component, in blocks, so counts have no cap.

Codes and ids alone are sorted; vectors meet them once, when the windows are compared.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlab.llm.vectors import prepared, stack, unit
from weftlab.operators.components import connected_components
from weftlab.session import materialise, release

WINDOW = 128
BLOCK = 2048
BITS = 62
MISS = 1e-3
#: Vectors whose neighbourhoods are measured to set the number of passes.
SAMPLE = 2000


def passes_for(n: int, threshold: float, miss: float = MISS, window: int = WINDOW, sample: np.ndarray | None = None) -> int:
    """Passes after which a pair at the threshold is missed with probability `miss`.

    Two vectors at angle t agree on one sign with probability 1 - t/pi. The pair shares a window once so many first signs agree that
    at most `window` other vectors do: log2(n / window) signs if the vectors are spread evenly, more where they lie in a
    crowd. sample: unit vectors by which crowds are measured; each stands for n / len(sample) vectors, those at or over the threshold left out, since
    links to them chain. The most crowded one counts.
    """
    bits = max(1.0, math.log2(max(n, 2) / window))
    if sample is not None and len(sample) > 1:
        bits = max(bits, _crowding(sample, n, threshold, window, bits))
    hit = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(miss) / math.log1p(-hit))) if hit < 1 else 1


def _crowding(sample: np.ndarray, n: int, threshold: float, window: int, least: float) -> float:
    """The number of signs that leaves at most `window` of n vectors beside the most crowded vector of the sample."""
    most = least
    for lo in range(0, len(sample), 256):
        cos = np.clip(sample[lo : lo + 256] @ sample.T, -1, 1)
        agree = np.where(cos >= threshold, 0.0, 1 - np.arccos(cos) / np.pi)
        while most < BITS and ((agree**most).sum(axis=1) * (n / len(sample))).max() > window:
            most += 0.5
    return most


def _planes(dim: int, k: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, k]).standard_normal((dim, BITS))


def _codes(reps: DataFrame, dim: int, passes: int, seed: int) -> DataFrame:
    """(pass, code, id) of every vector, one row per pass."""
    places = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)

    def run(batches):
        for pdf in batches:
            x, ids = unit(stack(pdf["vec"], dim)), pdf["id"].to_numpy()
            codes = [(x @ _planes(dim, k, seed) > 0) @ places for k in range(passes)]
            if len(ids):
                yield pd.DataFrame({"pass": np.repeat(np.arange(passes, dtype=np.int32), len(ids)), "code": np.concatenate(codes), "id": np.tile(ids, passes)})

    return reps.select("id", "vec").mapInPandas(run, "pass int, code long, id long")


def _window_links(reps: DataFrame, dim: int, passes: int, threshold: float, seed: int) -> DataFrame:
    """Links that join up what is found within the windows: in each block every vector points to the smallest it reaches."""
    n = max(2, int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["pass", "code", "id"]
    codes = materialise(_codes(reps, dim, passes, seed), "codes")
    dealt = codes.repartitionByRange(n, *order).sortWithinPartitions(*order).select("pass", "id")
    dealt = materialise(dealt.withColumn("at", F.monotonically_increasing_id()), "ordered")
    release(codes)
    part, local = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dealt.groupBy(part.alias("part")).count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))  # one row per task
    ranked = dealt.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + local)
    own = F.floor(F.col("rank") / BLOCK)
    halo = F.when((F.col("rank") % BLOCK < WINDOW) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    places = ranked.withColumn("block", F.explode(halo)).select("id", "block", "rank", "pass")
    blocks = places.join(reps.select("id", "vec"), "id").select("block", "rank", "pass", "id", "vec")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in pdf.groupby("pass"):
            part = part.sort_values("rank")
            x, ids = unit(stack(part["vec"], dim)), part["id"].to_numpy()
            low = np.arange(len(ids))

            def root(i: int, low: np.ndarray = low) -> int:
                while low[i] != i:
                    low[i] = low[low[i]]
                    i = low[i]
                return i

            for lo in range(0, len(ids), WINDOW):
                near = x[lo : lo + WINDOW] @ x[lo : lo + 2 * WINDOW].T >= threshold
                r, c = np.nonzero(near)
                for i, j in zip(r[(c > r) & (c - r <= WINDOW)].tolist(), c[(c > r) & (c - r <= WINDOW)].tolist(), strict=True):
                    a, b = root(lo + i), root(lo + j)
                    if a != b:
                        a, b = (a, b) if ids[a] < ids[b] else (b, a)
                        low[b] = a
            tops = np.array([root(i) for i in range(len(ids))], dtype=np.int64)
            moved = ids[tops] != ids
            out.append(pd.DataFrame({"a": ids[tops[moved]], "b": ids[moved]}))
        return pd.concat(out)

    return blocks.groupBy("block").applyInPandas(run, "a long, b long").distinct()


def _count_links(grouped: DataFrame, threshold: float) -> DataFrame:
    """(id, n_links): for each representative the vectors it is linked with, copies included, within its component.
    grouped: comp, id, dim, vec, copies."""
    sizes = grouped.groupBy("comp", "dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
    dealt = grouped.join(sizes, ["comp", "dim"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).repartition(max(2, int(grouped.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "comp", "dim", "i", "j")  # else a component's blocks would stay in one task

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, own, copies = unit(stack(pdf["vec"], int(pdf["dim"].iat[0]))), pdf["own"].to_numpy(), pdf["copies"].to_numpy()
        a, b = np.flatnonzero(own == pdf["i"].iat[0]), np.flatnonzero(own == pdf["j"].iat[0])
        near = (x[a] @ x[b].T >= threshold).astype(np.float64)
        n = np.zeros(len(pdf))
        n[a] += near @ copies[b]
        if pdf["i"].iat[0] != pdf["j"].iat[0]:
            n[b] += copies[a] @ near
        return pd.DataFrame({"id": pdf["id"], "n": n.astype(np.int64)})

    counted = dealt.groupBy("comp", "dim", "i", "j").applyInPandas(run, "id long, n long")
    return counted.groupBy("id").agg((F.sum("n") - 1).alias("n_links"))


def near_duplicate_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, miss: float = MISS, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of df.

    Equal vectors are collapsed first and count as linked. Vectors that are null, empty, zero or hold null or non-finite
    parts, and rows with a null id, link with nothing: n_links 0, component_id their own id. Vectors of different length
    never link. Rows that repeat an id count as vectors of their own under that id. An empty table gives an empty result.
    """
    rows = prepared(df, id_col, vec_col)
    once = rows.groupBy("dim", "vec").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    vectors = materialise(once.withColumn("key", F.monotonically_increasing_id()), "vectors")  # key: an id of its own for every distinct vector
    links = None
    for r in vectors.groupBy("dim").count().orderBy("dim").collect():  # one row per length of vectors
        part = vectors.filter(F.col("dim") == r["dim"]).select(F.col("key").alias("id"), "vec")
        sample = unit(stack(part.orderBy(F.xxhash64("id")).limit(SAMPLE).toPandas()["vec"], r["dim"]))
        found = _window_links(part, r["dim"], passes_for(r["count"], threshold, miss, sample=sample), threshold, seed)
        links = found if links is None else links.union(found)
    if links is None:
        links = vectors.select(F.col("key").alias("a"), F.col("key").alias("b"))
    links = materialise(links, "links")
    named = vectors.select("key", "id")
    pairs = links.join(named.toDF("a", "x"), "a").join(named.toDF("b", "y"), "b").select("x", "y")
    comp = materialise(connected_components(pairs, "x", "y"), "vector-groups").toDF("id", "comp")
    linked = links.select(F.col("a").alias("key")).union(links.select("b")).distinct()
    grouped = vectors.join(linked, "key", "left_semi").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    counted = _count_links(grouped.select("comp", F.col("key").alias("id"), "dim", "vec", "copies"), threshold).withColumnRenamed("id", "key")
    known = vectors.select("key", "id", "vec", "copies").join(comp, "id", "left").join(counted, "key", "left")
    known = known.select("vec", F.coalesce("n_links", F.col("copies") - 1).alias("n"), F.coalesce("comp", "id").alias("c"))
    all_rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    out = all_rows.join(known, "vec", "left")
    ok = F.col("vec_id").isNotNull() & F.col("c").isNotNull()
    out = out.select("vec_id", F.when(ok, F.col("n")).otherwise(0).alias("n_links"), F.when(ok, F.col("c")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
