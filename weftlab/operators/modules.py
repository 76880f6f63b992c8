"""Module inference on edges: state tables, probabilities, convergence, consensus.

edges: eid, g1, g2; samples: eid, sample; state: eid, module.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlab.operators.network import incidence

ALPHA, BETA = 0.5, 1.0


def initial_state(edges: DataFrame, samples: DataFrame, n: int) -> DataFrame:
    """(eid, module, share): every edge its own module; share of the n samples it carries."""
    counts = samples.groupBy("eid").agg(F.count("*").alias("k"))
    return edges.select("eid").join(counts, "eid", "left").select("eid", F.col("eid").alias("module"), (F.coalesce("k", F.lit(0)) / n).alias("share"))


def module_sample_counts(state: DataFrame, samples: DataFrame) -> DataFrame:
    """(module, m, sample, ones): edges of each module, and how many of them carry each sample (only samples that any carries)."""
    sizes = state.groupBy("module").agg(F.count("*").alias("m"))
    return samples.join(state.select("eid", "module"), "eid").groupBy("module", "sample").agg(F.count("*").alias("ones")).join(sizes, "module")


def edge_candidate_modules(edges: DataFrame, state: DataFrame) -> DataFrame:
    """(eid, module): modules and founding ids of all edges that share a vertex with the edge, itself included. Modules are
    made distinct per vertex first, so the pairs of edges at a hub are never listed."""
    ends = incidence(edges, "eid")
    offers = ends.join(state.select("eid", "module"), "eid").select("gene", F.explode(F.array("module", "eid")).alias("module")).distinct()
    return ends.join(offers, "gene").select("eid", "module").distinct()


def edge_module_loglik(candidates: DataFrame, state: DataFrame, samples: DataFrame, n: int, alpha: float = ALPHA, beta: float = BETA) -> DataFrame:
    """(eid, module, lp) of every candidate: the log-probability of the edge in the module, itself removed first.

    Only the samples an edge carries are joined: the rest of a module's likelihood is a sum per module (for an edge of its own, one with a
    row less), corrected at those samples.
    """
    half = alpha / 2
    counts = module_sample_counts(state, samples)
    safe = lambda x: F.when(x > 0, F.ln(x)).otherwise(0.0)
    sums = counts.groupBy("module").agg(F.count("*").alias("used"), F.sum(F.ln(F.col("m") - F.col("ones") + half)).alias("b0"), F.sum(safe(F.col("m") - 1 - F.col("ones") + half)).alias("b1"))
    sizes = state.groupBy("module").agg(F.count("*").alias("m")).join(sums, "module", "left").fillna(0, ["used", "b0", "b1"])
    own = F.col("module") == F.col("home")
    pairs = candidates.join(state.select("eid", F.col("module").alias("home")), "eid").join(sizes, "module", "left").withColumn("m0", F.coalesce("m", F.lit(0)) - own.cast("int"))
    at = pairs.select("eid", "module", "home", "m0", F.col("m").alias("mm")).join(samples, "eid").join(counts.select("module", "sample", "ones"), ["module", "sample"], "left")
    ones = F.coalesce("ones", F.lit(0)) - own.cast("int")
    gain = F.ln(ones + half) - F.ln(F.col("m0") - ones + half)
    # an own edge's samples stand in b1 with m - 1 - ones; their right term is m0 - (ones - 1)
    fix = F.when(own, F.ln(F.col("m0") - ones + half) - safe(F.col("mm") - 1 - F.coalesce("ones", F.lit(0)) + half)).otherwise(0.0)
    per = at.groupBy("eid", "module").agg(F.sum(F.when(F.col("m0") > 1, gain + fix)).alias("gain"), F.sum(ones).alias("match"))
    rows = pairs.join(per, ["eid", "module"], "left")
    m = F.col("m0")
    unused = (n - F.col("used")) * F.when(m > 1, F.ln(m + half)).otherwise(0.0)
    many = -n * F.ln(m + alpha) + F.when(own, F.col("b1")).otherwise(F.col("b0")) + unused + F.coalesce("gain", F.lit(0.0)) + F.ln(m + beta)
    k = F.coalesce("match", F.lit(0))
    single = k * math.log((half + 1) / alpha) + (n - k) * math.log(half / alpha) + math.log(1 + beta)
    return rows.select("eid", "module", F.when(m <= 0, n * math.log(0.5) + math.log(beta)).when(m == 1, single).otherwise(many).alias("lp"))


def move_probabilities(logp: DataFrame, orders: float = 7.0) -> DataFrame:
    """(eid, module, lp, p): exp of lp less its largest value per edge, zero below -orders, normalised."""
    w = Window.partitionBy("eid")
    rel = F.col("lp") - F.max("lp").over(w)
    e = logp.withColumn("e", F.when(rel < -orders, 0.0).otherwise(F.exp(rel)))
    return e.withColumn("p", F.col("e") / F.sum("e").over(w)).drop("e")


def edge_transitions(history: DataFrame) -> DataFrame:
    """(eid, a, b, p) over all states of each edge that has over one: moves from a to b in consecutive steps / occurrences of a before
    the last step. history: step, eid, module."""
    w = Window.partitionBy("eid").orderBy("step")
    moves = history.select("eid", F.col("module").alias("a"), F.lead("module").over(w).alias("b")).filter("b is not null")
    seen = history.groupBy("eid").agg(F.collect_set("module").alias("states")).filter(F.size("states") > 1)
    all_ = seen.select("eid", F.explode("states").alias("a"), "states").select("eid", "a", F.explode("states").alias("b"))
    done = moves.groupBy("eid", "a", "b").agg(F.count("*").alias("n"))
    out = moves.groupBy("eid", "a").agg(F.count("*").alias("of"))
    rows = all_.join(done, ["eid", "a", "b"], "left").join(out, ["eid", "a"], "left")
    return rows.select("eid", "a", "b", F.coalesce(F.col("n") / F.col("of"), F.lit(0.0)).alias("p"))


def transition_rmsd(one: DataFrame, two: DataFrame) -> DataFrame:
    """One row: root mean squared difference over edges in both tables; a missing pair counts as its own square; 0 if none."""
    a = one.join(two.select("eid").distinct(), "eid", "left_semi").withColumnRenamed("p", "p1")
    b = two.join(one.select("eid").distinct(), "eid", "left_semi").withColumnRenamed("p", "p2")
    d = F.coalesce("p1", F.lit(0.0)) - F.coalesce("p2", F.lit(0.0))
    return a.join(b, ["eid", "a", "b"], "full").agg(F.coalesce(F.sqrt(F.avg(d * d)), F.lit(0.0)).alias("rmsd"))


def convergence_check(series: DataFrame, last: int = 10, tol: float = 0.1) -> DataFrame:
    """One row (slope_1, slope_2, converged) of series (step, x1, x2): the last points, min-max scaled by the whole series times 10; a flat
    series has a null slope and has not converged."""
    ends = series.agg(*[f(c).alias(f"{n}_{c}") for c in ("x1", "x2") for n, f in (("lo", F.min), ("hi", F.max))])
    tail = series.orderBy(F.desc("step")).limit(last).join(F.broadcast(ends))
    scaled = lambda c: F.try_divide(10.0 * (F.col(c) - F.col(f"lo_{c}")), F.col(f"hi_{c}") - F.col(f"lo_{c}"))
    got = tail.agg(F.regr_slope(scaled("x1"), F.col("step")).alias("slope_1"), F.regr_slope(scaled("x2"), F.col("step")).alias("slope_2"))
    return got.withColumn("converged", F.coalesce((F.abs("slope_1") < tol) & (F.abs("slope_2") < tol), F.lit(False)))


def consensus_modules(history: DataFrame, low: float = 0.5) -> DataFrame:
    """(eid, module, share, weak): the most frequent module of each edge, ties to the smallest; weak if in under half of the steps."""
    counts = history.groupBy("eid", "module").agg(F.count("*").alias("n"))
    w = Window.partitionBy("eid")
    best = counts.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("nth", F.row_number().over(w.orderBy(F.desc("n"), "module")))
    return best.filter("nth = 1").select("eid", "module", "share", (F.col("share") < low).alias("weak"))


def module_census(state: DataFrame, consensus: DataFrame) -> DataFrame:
    """One row: founding ids without an edge, modules of one edge, larger ones, and edges that the consensus moved."""
    sizes = consensus.groupBy("module").agg(F.count("*").alias("m"))
    moved = state.select("eid", F.col("module").alias("old")).join(consensus, "eid").agg(F.count_if(F.col("old") != F.col("module")).alias("n_moved"), F.count("*").alias("n_edges"))
    kinds = sizes.agg(F.count_if(F.col("m") == 1).alias("n_single"), F.count_if(F.col("m") > 1).alias("n_larger"))
    return kinds.join(F.broadcast(moved)).select((F.col("n_edges") - F.col("n_single") - F.col("n_larger")).alias("n_empty"), "n_single", "n_larger", "n_moved")


def module_genes(edges: DataFrame, state: DataFrame) -> DataFrame:
    """(module, gene): distinct ends of each module's edges."""
    return incidence(edges.join(state.select("eid", "module"), "eid"), "module").select("module", "gene").distinct()


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / float(1 << 52)
