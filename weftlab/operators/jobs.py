"""The two end-to-end jobs: finding biclusters in a network and a matrix, and their significance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlab.functions.ordering import numbered
from weftlab.operators import bicluster, merge, network, nulls, rankoverlap, sampler, sets
from weftlab.operators.modules import module_genes
from weftlab.session import materialise
from weftlab.sources import matrix

Biclusters = tuple[DataFrame, DataFrame, DataFrame]


def restricted(edges: DataFrame, m: DataFrame, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """Canonical edges between measured genes, without components of fewer than k genes, and the matrix rows of their genes."""
    kept, few = sets.restrict_to_shared_genes(network.canonical_edges(edges), m)
    kept = materialise(network.drop_small_components(kept, k), "network")
    return kept, few.join(network.incidence(kept).select("gene").distinct(), "gene", "left_semi")


def edge_snr_threshold(edges: DataFrame, m: DataFrame, direction: str, n: int, q: float, least: int) -> float:
    """The 1 - q quantile of the avgSNR of biclusters of single edges, over the threshold_edges."""
    edges = edges.withColumn("id", F.xxhash64("g1", "g2"))
    chosen = materialise(rankoverlap.threshold_edges(edges), "edges")
    members = network.incidence(chosen, "id")
    found = bicluster.optimal_sample_set(members, m, chosen.select("id", F.lit(direction).alias("direction")), n, least)
    score = bicluster.bicluster_snr(members, found, m)
    return rankoverlap.snr_threshold(chosen.join(score, "id", "left"), "avgSNR", q).first()["min_snr"]


def discover(edges: DataFrame, m: DataFrame, direction: str = "UP", p: float = 0.01, q: float = 0.1, min_snr: float | None = None, min_n_samples: int | None = None, k: int = 3, alpha: float = 0.05, **sampling) -> Biclusters:
    """(bics, members, samples) found in an expression matrix m (gene, sample, value) over a network (g1, g2).

    Restrict the network, set the SNR threshold (unless given), assign samples to edges, sample modules until they have converged,
    take the consensus of the last steps, split samples per module, keep those that pass, and merge what overlaps. bics: id, direction,
    avgSNR, n_genes, n_samples, converged (whether the sampler has, the same in every row). min_n_samples: by default the larger of 10 and a twentieth of the samples. Without edges or without a
    module that passes, all three are empty.
    """
    edges, m = restricted(edges, m, k)
    m = materialise(m, "matrix")
    n = m.select("sample").distinct().count()
    least = min_n_samples if min_n_samples is not None else max(10, int(0.05 * n))
    snr = edge_snr_threshold(edges, m, direction, n, q, least) if min_snr is None else min_snr
    assigned = materialise(rankoverlap.assign_samples_to_edges(edges, m, direction, p, snr, least, k), "edge-samples")
    named = materialise(numbered(assigned.select("g1", "g2").distinct(), ["g1", "g2"], "eid"), "edge-ids")
    carried = materialise(assigned.join(named, ["g1", "g2"]).select("eid", "sample"), "carried")
    state, converged = sampler.settled_modules(named, carried, n, **sampling)
    state = materialise(state.select("eid", "module"), "modules")
    judged, sets_ = bicluster.judged_modules(named, state, m, direction, n, snr, least)
    found = judged.filter("reason = 'kept'").select(F.col("id").alias("module"))
    ids = materialise(numbered(found, ["module"], "id").select("module", F.col("id").cast("int").alias("id")), "module-ids")
    members = module_genes(named, state).join(ids, "module").select("id", "gene")
    bics = ids.select("id", F.lit(direction).alias("direction"))
    samples = sets_.withColumnRenamed("id", "module").join(ids, "module").select("id", "sample")
    merged = merge.merge_biclusters(bics, members, samples, m, n, snr, least, alpha)
    return described(*merged, m).withColumn("converged", F.lit(converged)), merged[1], merged[2]


def described(bics: DataFrame, members: DataFrame, samples: DataFrame, m: DataFrame) -> DataFrame:
    """bics (id, direction) with avgSNR, n_genes and n_samples."""
    sizes = members.groupBy("id").agg(F.count("*").alias("n_genes")).join(samples.groupBy("id").agg(F.count("*").alias("n_samples")), "id")
    return bics.select("id", "direction").join(sizes, "id").join(bicluster.bicluster_snr(members, samples, m), "id")


def listed(found: Biclusters) -> DataFrame:
    """What discover returns as one table with the sets as arrays of text, as write_biclusters takes it."""
    of = lambda d, c: d.groupBy("id").agg(F.collect_list(F.col(c).cast("string")).alias(f"{c}s"))
    return found[0].join(of(found[1], "gene"), "id").join(of(found[2], "sample"), "id")


def significance_from_files(up: str, down: str, edges: DataFrame, m: DataFrame, min_snr: float, **how) -> DataFrame:
    """significance of two tables that write_biclusters has written, as discover leaves them; a path without a table counts as an empty one.
    Names in files are text, so those of the network and the matrix are taken as text too."""
    spark = m.sparkSession

    def read(path: str) -> Biclusters:
        rows = materialise(matrix.read_biclusters(spark, path).select("id", "direction", "genes", "samples"), "read-biclusters")
        return rows.select("id", "direction"), rows.select("id", F.explode("genes").alias("gene")), rows.select("id", F.explode("samples").alias("sample"))

    named = edges.select(F.col("g1").cast("string").alias("g1"), F.col("g2").cast("string").alias("g2"))
    values = m.select(F.col("gene").cast("string").alias("gene"), F.col("sample").cast("string").alias("sample"), "value")
    return significance(read(up), read(down), named, values, min_snr, **how)


def significance(up: Biclusters, down: Biclusters, edges: DataFrame, m: DataFrame, min_snr: float, min_n_samples: int | None = None, k: int = 3, sets_per_size: int = 1000, seed: int = 1) -> DataFrame:
    """The final report of UP and DOWN biclusters (bics, members, samples each) with empirical p-values.

    Both are united and merged, also across directions, large ones are turned round, and each is set against random connected gene sets
    of its own size. min_n_samples: by default the larger of 10 and a tenth of the samples.
    """
    edges, m = restricted(edges, m, k)
    m = materialise(m, "matrix")
    n = m.select("sample").distinct().count()
    least = min_n_samples if min_n_samples is not None else max(10, int(0.1 * n))
    bics, members, samples = merge.unite_up_down(tuple(d.select("id", "direction") if i == 0 else d for i, d in enumerate(up)), tuple(d.select("id", "direction") if i == 0 else d for i, d in enumerate(down)))
    bics, members, samples = merge.merge_biclusters(bics, members, samples, m, n, min_snr, least, discordant=True)
    bics, samples = bicluster.flip_large_biclusters(bics, samples, m.select("sample").distinct(), n)
    samples = materialise(samples, "flipped")
    scored = materialise(described(bics, members, samples, m), "scored")
    sizes = [r["n_genes"] for r in bicluster.sizes_census(members).select("n_genes").orderBy("n_genes").collect()]  # one number per size of gene sets
    null = materialise(nulls.null_distribution(edges, m, sizes, sets_per_size, seed), "null")
    p = bicluster.empirical_pvalues(scored.select("id", "n_genes", "n_samples", "avgSNR"), null)
    return bicluster.final_report(scored.select("id", "direction", "avgSNR").join(p, "id"), members, samples)
