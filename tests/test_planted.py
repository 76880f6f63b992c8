"""Planted biclusters in a matrix of 2,000 genes and 200 samples, found with all defaults. Takes minutes: run with WEFTLAB_SLOW=1."""

import os

import numpy as np
import pandas as pd
import pytest

from weftlab.operators import evaluate, jobs

pytestmark = pytest.mark.skipif(not os.environ.get("WEFTLAB_SLOW"), reason="takes minutes")


def planted(n_genes=2000, n_samples=200, sets=10, genes=20, samples=50, raised=2.0, n_edges=14_000, seed=42):
    """(values, [(genes, samples)], edges): noise with raised blocks, whose genes are connected, in a network of hubs."""
    rng = np.random.default_rng(seed)
    x, truth = rng.standard_normal((n_genes, n_samples)), []
    order = rng.permutation(n_genes)
    for i in range(sets):
        g, s = order[i * genes : (i + 1) * genes], rng.choice(n_samples, samples, replace=False)
        x[np.ix_(g, s)] += raised
        truth.append((g.tolist(), s.tolist()))
    share = rng.pareto(1.4, n_genes) + 1
    share = np.minimum(share / share.sum(), 0.02)
    a, b = (rng.choice(n_genes, n_edges, p=share / share.sum()) for _ in range(2))
    edges = {(int(min(u, v)), int(max(u, v))) for u, v in zip(a, b, strict=True) if u != v}
    for g, _ in truth:
        edges |= {(min(u, v), max(u, v)) for i, u in enumerate(g) for v in g[:i] if v == g[i - 1] or rng.random() < 0.15}
    return x, truth, sorted(edges)


def test_defaults_find_planted_biclusters(spark):
    x, truth, edges = planted()
    rows = pd.DataFrame({"gene": np.repeat(np.arange(x.shape[0]), x.shape[1]), "sample": np.tile(np.arange(x.shape[1]), x.shape[0]), "value": x.ravel()})
    found = jobs.discover(spark.createDataFrame(pd.DataFrame(edges, columns=["g1", "g2"])), spark.createDataFrame(rows), "UP")
    tg = spark.createDataFrame([(i, g) for i, (gs, _) in enumerate(truth) for g in gs], "id int, gene long")
    ts = spark.createDataFrame([(i, s) for i, (_, ss) in enumerate(truth) for s in ss], "id int, sample long")
    rng = np.random.default_rng(1)
    chance = spark.createDataFrame([(i, int(g)) for i in range(10) for g in rng.choice(2000, 20, replace=False)], "id int, gene long")
    random_ = [r["recovery"] for r in evaluate.recovery((chance, ts), (tg, ts)).collect()]
    recovery = [r["recovery"] for r in evaluate.recovery((found[1], found[2]), (tg, ts)).collect()]
    relevance = [r["relevance"] for r in evaluate.relevance((found[1], found[2]), (tg, ts)).collect()]
    assert len(recovery) == 10 and min(recovery) > 0.7 and np.mean(relevance) > 0.7 and max(random_) < 0.2
