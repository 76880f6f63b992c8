"""The sampler over module labels: parts of the network are drawn in tasks, and exchange counts after every step.

What tasks keep lies as arrays in the shared folder (`arrays.put`). An edge, and so a module, has an address there: its part, and its place among the
part's edges by id. Per part: the fixed arrays of `gibbs.laid` and the edges of other parts at its genes; per step a label (the address of the
module) for each edge. Parts exchange tables of one row per module that has edges: part, place, edges, and edges that carry each sample. The part of
a module's founding edge keeps its row; a task adds the changes that all parts made in the step before to the rows that it keeps or sees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftlab.functions.ordering import numbered
from weftlab.operators import arrays, gibbs, modules
from weftlab.operators.network import incidence
from weftlab.session import drop_path, materialise, new_path, release

#: Cells (edges times samples) of a part.
CELLS = 8_000_000
#: Steps that a network of a single part takes in one job; it has nobody to exchange counts with, so the number changes no result.
AT_ONCE = 10
#: Label files that a task of the history reads at most.
FILES = 8


def draw(probs: DataFrame, seed: int, step: int, block: int) -> DataFrame:
    """(eid, module): one module per edge by inverse cumulative probability at a hash-uniform number."""
    up = Window.partitionBy("eid").orderBy("module")
    run = probs.withColumn("cum", F.sum("p").over(up)).withColumn("u", modules.uniform(F.col("eid"), F.lit(seed), F.lit(step), F.lit(block)))
    hit = run.filter((F.col("p") > 0) & (F.col("cum") > F.col("u") * (1 - 1e-12)))
    return hit.groupBy("eid").agg(F.min_by("module", "cum").alias("module"))


def parted(edges: DataFrame, n: int, part_edges: int | None = None) -> tuple[DataFrame, int]:
    """(edges with `part`, number of parts): edges in the order of the busiest gene near them, cut into parts of equal size, so that most edges
    that share a gene share a part, and a gene of any number of edges is spread over as many parts as it needs."""
    total, size = edges.count(), part_edges or max(1, CELLS // max(1, n))
    if total <= size:
        return edges.withColumn("part", F.lit(0).cast("long")), 1
    degree = incidence(edges, "eid").groupBy("gene").agg(F.count("*").alias("n"))
    of = lambda g, i: degree.select(F.col("gene").alias(g), F.col("n").alias(f"n{i}"))
    busy = F.when((F.col("n1") > F.col("n2")) | (F.col("n1") == F.col("n2")) & (F.col("g1") < F.col("g2")), F.col("g1")).otherwise(F.col("g2"))
    placed = numbered(edges.join(of("g1", 1), "g1").join(of("g2", 2), "g2").withColumn("__busy", busy), ["__busy", "eid"], "__nth")
    return placed.select(*edges.columns, F.floor(F.col("__nth") / size).alias("part")), -(-total // size)


def _far(edges: DataFrame) -> DataFrame:
    """(of, at, far, source, nth): the genes that each part shares with edges of other parts, and those edges, with their parts and places."""
    ends = incidence(edges, "eid", "part", "place")
    near = ends.select("gene", F.col("part").alias("of")).distinct()
    return near.join(ends, "gene").filter("of <> part").select("of", F.col("gene").alias("at"), F.col("eid").alias("far"), F.col("part").alias("source"), F.col("place").alias("nth"))


@dataclass
class Drawn:
    """What the sampler leaves in the shared folder: names of files by part, and of the labels by part and step."""

    folder: str
    fixed: dict[int, dict[str, str]]
    labels: dict[int, list[str]] = field(default_factory=dict)
    tables: dict[int, tuple[str, str]] = field(default_factory=dict)  # rows kept, changes
    exchanged: str = ""
    converged: bool = False

    def steps(self) -> int:
        return len(next(iter(self.labels.values())))

    def ids(self, addresses: np.ndarray) -> np.ndarray:
        """The edge ids at addresses."""
        part, out = addresses >> 32, np.zeros(len(addresses), np.int64)
        for p in np.unique(part).tolist():
            here = part == p
            out[here] = arrays.get(self.folder, self.fixed[p]["eid"])[addresses[here] & 0xFFFFFFFF]
        return out

    def history(self, spark: SparkSession, first: int = 0) -> DataFrame:
        """(step, eid, module) from step `first` on."""
        told, n = [(part, step) for part in sorted(self.labels) for step in range(first, self.steps())], max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part, step in (told[i] for pdf in batches for i in pdf["id"]):
                eid = arrays.get(self.folder, self.fixed[part]["eid"])
                yield pd.DataFrame({"step": np.full(len(eid), step, np.int32), "eid": eid, "module": self.ids(arrays.get(self.folder, self.labels[part][step]))})

        return spark.range(0, len(told), 1, min(len(told), max(n, -(-len(told) // FILES)))).mapInPandas(read, "step int, eid long, module long")


def run_sampler(edges: DataFrame, samples: DataFrame, n: int, steps: int = 200, averaged: int = 20, needed: int = 5, tol: float = 0.1, seed: int = 1, points: int = 10, part_edges: int | None = None, alpha: float = modules.ALPHA, beta: float = modules.BETA) -> tuple[DataFrame, bool]:
    """(history, converged): history (step, eid, module) of a Gibbs sampler, from every edge alone to convergence or `steps`.

    The network is cut into parts of bounded size (`part_edges` edges, by default CELLS cells). In a step each part draws its edges in one task, level
    by level as `gibbs` tells, from counts that its own moves keep current and that hold the other parts' edges as they were before the step;
    after it, the parts' changes are added to the counts. With one part this is the sequential sampler in a fixed order. What was
    drawn is written after each job, so lineage stays short and a lost executor costs one step. Results depend on the seed and the parts, not on
    Spark's partitions. Converged: `needed` steps in a row with flat series, over the last `points` steps, of the change of the transition
    tables over `averaged` steps and of the log-likelihood. Samples may be of any type; edges without samples take part; repeated
    samples of an edge count once. Without edges the history is empty.
    """
    drawn = _drawn(edges, samples, n, steps, averaged, needed, tol, seed, points, part_edges, alpha, beta)
    if drawn is None or not drawn.labels:
        return edges.sparkSession.createDataFrame([], "step int, eid long, module long"), False
    return drawn.history(edges.sparkSession), drawn.converged


def _drawn(edges: DataFrame, samples: DataFrame, n: int, steps: int = 200, averaged: int = 20, needed: int = 5, tol: float = 0.1, seed: int = 1, points: int = 10, part_edges: int | None = None, alpha: float = modules.ALPHA, beta: float = modules.BETA) -> Drawn | None:
    spark = edges.sparkSession
    if edges.isEmpty():
        return None
    ids = numbered(samples.select("sample").distinct(), ["sample"], "nth")
    listed = samples.join(ids, "sample").groupBy("eid").agg(F.array_sort(F.collect_set(F.col("nth").cast("int"))).alias("samples"))
    genes = numbered(incidence(edges).select("gene").distinct(), ["gene"], "nth")  # any type of gene becomes a number
    gene = lambda g: genes.select(F.col("gene").alias(g), F.col("nth").cast("long").alias(f"{g}n"))
    plain = edges.select("eid", "g1", "g2").join(gene("g1"), "g1").join(gene("g2"), "g2").select(F.col("eid").cast("long").alias("eid"), F.col("g1n").alias("g1"), F.col("g2n").alias("g2"))
    cut, parts = parted(plain, n, part_edges)
    placed = cut.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("eid")).cast("long") - 1)
    fixed = materialise(placed.join(listed, "eid", "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<int>"))), "parts")
    drawn = _laid(fixed, n, parts)
    release(fixed)
    series, flat, step = [], 0, 0
    while step < steps:
        k = 1 if parts > 1 else min(AT_ONCE, steps - step)
        into = new_path(spark, "exchanged")
        told = _job(spark, drawn, into, n, step, k, averaged, seed, alpha, beta)
        if parts > 1:
            drop_path(spark, drawn.exchanged)
            drawn.exchanged, drawn.tables = into, {r["part"]: (r["kept"], r["changed"]) for r in told}
        for r in sorted(told, key=lambda r: (r["part"], r["step"])):
            drawn.labels.setdefault(r["part"], []).append(r["labels"])
        for step in range(step, step + k):
            lp, squares, terms, known = (sum(r[c] for r in told if r["step"] == step) for c in ("lp", "squares", "terms", "known"))
            if known:
                series.append((step, (squares / terms) ** 0.5 if terms else 0.0, lp))
            flat = flat + 1 if len(series) >= points and is_flat(series, points, tol) else 0
            if flat >= needed:
                drawn.labels = {p: files[: step + 1] for p, files in drawn.labels.items()}
                drawn.converged = True
                break
        step += 1
        if drawn.converged:
            break
    if parts > 1:
        drop_path(spark, drawn.exchanged)
    return drawn


def is_flat(series: list[tuple[int, float, float]], points: int, tol: float) -> bool:
    """convergence_check of a series (step, x1, x2) that is at hand: at most one row per step."""
    rows = np.array(series, dtype=np.float64)
    t = rows[-points:, 0] - rows[-points:, 0].mean()
    for x in (rows[:, 1], rows[:, 2]):
        lo, hi = x.min(), x.max()
        if hi <= lo or not (t * t).sum():
            return False
        y = 10 * (x[-points:] - lo) / (hi - lo)
        if not abs((t * y).sum() / (t * t).sum()) < tol:
            return False
    return True


def _laid(fixed: DataFrame, n: int, parts: int) -> Drawn:
    """Every part's fixed arrays, and its table of edges that are alone, written by tasks."""
    folder, into = new_path(fixed.sparkSession, "parts-arrays"), new_path(fixed.sparkSession, "exchanged")

    def lay(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        part, right = int(left["part"].iat[0]), right.sort_values(["at", "far"])
        held = gibbs.laid(*(left[c].to_numpy(np.int64) for c in ("eid", "g1", "g2")), list(left["samples"]))
        eid, far = held["eid"], right["far"].to_numpy(np.int64)
        held["far"] = right["source"].to_numpy(np.int64) << 32 | right["nth"].to_numpy(np.int64)
        held["n_far"] = np.bincount(np.searchsorted(held["genes"], right["at"].to_numpy(np.int64)), minlength=len(held["genes"]))
        held["seen"], first = np.unique(np.append(eid, far), return_index=True)
        held["seen_at"] = np.append((part << 32) + np.arange(len(eid)), held["far"])[first]
        held["own_seen"], held["far_seen"] = np.searchsorted(held["seen"], eid), np.searchsorted(held["seen"], far)
        kept = changed = None
        if parts > 1:
            table = np.zeros((len(eid), 3 + n), np.int32)
            table[:, 0], table[:, 1], table[:, 2] = part, np.arange(len(eid)), 1
            table[np.repeat(np.arange(len(eid)), held["n_samples"]), 3 + held["sample"]] = 1
            kept, changed = arrays.put(into, f"{part}-kept", table), arrays.put(into, f"{part}-changed", table[:0])
        files = [(name, arrays.put(folder, f"{part}-{name}", x)) for name, x in held.items()]
        return pd.DataFrame({"part": part, "name": [f[0] for f in files], "file": [f[1] for f in files], "kept": kept, "changed": changed})

    told = fixed.groupBy("part").cogroup(_far(fixed).groupBy("of")).applyInPandas(lay, "part long, name string, file string, kept string, changed string").collect()  # names of files
    drawn = Drawn(folder, {}, exchanged=into)
    for r in told:
        drawn.fixed.setdefault(r["part"], {})[r["name"]] = r["file"]
        if parts > 1:
            drawn.tables[r["part"]] = r["kept"], r["changed"]
    return drawn


def _summed(tables: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """The sum of rows of one module, over the tables, for the modules at the addresses `wanted` (ascending) that have edges; by address."""
    rows, at = [], []
    for t in tables:
        address = t[:, 0].astype(np.int64) << 32 | t[:, 1]
        place = np.minimum(np.searchsorted(wanted, address), len(wanted) - 1)
        some = np.flatnonzero(wanted[place] == address)
        rows.append(t[some])
        at.append(address[some])
    every, at = np.concatenate(rows), np.concatenate(at)
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(at[order]) != 0)) if len(at) else order
    out = every[order[first]]
    if len(first) < len(order):
        out[:, 2:] = np.add.reduceat(every[order, 2:], first, axis=0)
    return out[out[:, 2] > 0]


def _job(spark: SparkSession, drawn: Drawn, into: str, n: int, first: int, k: int, averaged: int, seed: int, alpha: float, beta: float) -> list:
    """A row per part and step of k steps: the sums of the step and the files written."""
    parts = len(drawn.fixed)

    def draw_part(part: int) -> pd.DataFrame:
        load = lambda name: arrays.get(drawn.folder, drawn.fixed[part][name])
        fixed = {name: load(name) for name in drawn.fixed[part]}
        own = (part << 32) + np.arange(len(fixed["eid"]))
        labels, far = own, np.array(fixed["far"])
        if first:
            labels = np.array(arrays.get(drawn.folder, drawn.labels[part][-1]))
            source, place = far >> 32, far & 0xFFFFFFFF
            for p in np.unique(source).tolist():
                here = source == p
                far[here] = arrays.get(drawn.folder, drawn.labels[p][-1])[place[here]]
        # the modules seen: founded by the edges at the part's genes, and named by their labels
        named = np.unique(np.append(labels, far))
        ids, seen = drawn.ids(named), np.array(fixed["seen"])
        new = np.flatnonzero(seen[np.minimum(np.searchsorted(seen, ids), len(seen) - 1)] != ids)
        new = new[np.argsort(ids[new])]
        seen_at = np.arange(len(seen)) + np.searchsorted(ids[new], seen)
        module, address = np.zeros((2, len(seen) + len(new)), np.int64)
        for out, old, more in ((module, seen, ids), (address, fixed["seen_at"], named)):
            out[seen_at], out[np.arange(len(new)) + np.searchsorted(seen, ids[new])] = old, more[new]
        of = lambda x: np.searchsorted(module, ids)[np.searchsorted(named, x)]
        counts = kept = changed = held = None
        if parts > 1:
            by = np.argsort(address)
            held = _summed([arrays.get(drawn.exchanged, f) for both in drawn.tables.values() for f in both], address[by])
            at = by[np.searchsorted(address[by], held[:, 0].astype(np.int64) << 32 | held[:, 1])]
            counts = np.zeros((len(module), n), np.int32), np.zeros(len(module), np.int64)
            counts[0][at], counts[1][at] = held[:, 3:], held[:, 2]
            kept = arrays.put(into, f"{part}-kept", held[held[:, 0] == part])
        drawn_part = gibbs.Part.of(fixed, module, of(labels), seen_at[fixed["own_seen"]], n, alpha, beta, seed, counts, (fixed["n_far"], [seen_at[fixed["far_seen"]], of(far)]))
        files, out = drawn.labels.get(part, [])[-(averaged + 1) :], []
        window = [np.asarray(arrays.get(drawn.folder, f)) for f in files]
        for step in range(first, first + k):
            full = len(window) > averaged
            squares, terms = gibbs.window_change(np.stack(window, axis=1)) if full else (0.0, 0)
            lp = drawn_part.sweep(step)
            window = [*window, address[drawn_part.label]][-(averaged + 1) :]
            out.append((part, step, lp, squares, float(terms), float(full), arrays.put(drawn.folder, f"{part}-labels-{step}", window[-1]), kept))
        if parts > 1:
            some = np.flatnonzero(drawn_part.touched)
            table = np.zeros((len(some), 3 + n), np.int32)
            table[:, 0], table[:, 1], table[:, 2], table[:, 3:] = address[some] >> 32, address[some] & 0xFFFFFFFF, drawn_part.m[some], drawn_part.ones[some]
            was = np.full(len(module), -1)
            was[at] = np.arange(len(held))
            old = was[some]
            table[old >= 0, 2:] -= held[old[old >= 0], 2:]
            changed = arrays.put(into, f"{part}-changed", table[(table[:, 2:] != 0).any(axis=1)])
        return pd.DataFrame(out, columns=["part", "step", "lp", "squares", "terms", "known", "labels", "kept"]).assign(changed=changed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in pdf["id"].tolist():
                yield draw_part(part)

    return spark.range(0, parts, 1, parts).mapInPandas(run, "part long, step int, lp double, squares double, terms double, known double, labels string, kept string, changed string").collect()  # names and sums


def sample_modules(edges: DataFrame, samples: DataFrame, n: int, **how) -> DataFrame:
    """The history of run_sampler with `converged`, the same in every row."""
    history, converged = run_sampler(edges, samples, n, **how)
    return history.withColumn("converged", F.lit(converged))


def final_modules(history: DataFrame, converged: bool, needed: int = 5, points: int = 10) -> DataFrame:
    """consensus_modules over the last steps: points + needed of them if the sampler has converged, else `needed`."""
    last = history.agg(F.max("step")).first()[0]
    return modules.consensus_modules(history.filter(F.col("step") > (last or 0) - (points + needed if converged else needed)))


def settled_modules(edges: DataFrame, samples: DataFrame, n: int, needed: int = 5, points: int = 10, **how) -> tuple[DataFrame, bool]:
    """(final_modules of run_sampler's history, converged); of the history only the last steps are read."""
    drawn = _drawn(edges, samples, n, needed=needed, points=points, **how)
    if drawn is None or not drawn.labels:
        return final_modules(edges.sparkSession.createDataFrame([], "step int, eid long, module long"), False), False
    last = points + needed if drawn.converged else needed
    return modules.consensus_modules(drawn.history(edges.sparkSession, max(0, drawn.steps() - last))), drawn.converged
