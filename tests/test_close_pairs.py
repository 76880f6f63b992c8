"""Pairs of sets under a bound of p, against all pairs."""

import numpy as np
import pytest

from weftlab.operators import merge, pairs
from tests.test_operators import frame


@pytest.mark.parametrize("n", [40, 130])
def test_close_pairs_are_all_pairs_under_the_bound(spark, monkeypatch, n):
    monkeypatch.setattr(pairs, "WIDE_BLOCK", 16)
    rng = np.random.default_rng(n)
    centres = [rng.permutation(n)[: n // 3] for _ in range(4)]
    bics = frame(spark, [(i, "UP" if i % 3 else "DOWN") for i in range(50)], "id int, direction string")
    samples = frame(spark, sorted({(i, int(s)) for i in range(49) for s in [*rng.choice(centres[i % 4], n // 4, replace=False), *rng.choice(n, 3)]}), "id int, sample int")
    bits, n_words = pairs.numbered_bits(samples, n)
    sets = pairs.packed_sets(bics, samples, bits, n_words)
    columns = ("i", "j", "d1", "d2", "shared", "only_1", "only_2", "p", "jac")
    rows = lambda df: sorted(tuple(r[c] for c in columns) for r in df.collect())
    every = rows(pairs.pair_overlaps(pairs.set_pairs(sets), n, ways=True))
    new = {1, 7, 30, 49}
    some = sets.filter(sets["id"].isin(*new))
    for below in (0.9, 1e-3):
        want = [r for r in every if r[7] < below]
        assert want and rows(pairs.close_pairs(sets, n, below)) == want
        want = [r for r in want if r[0] in new or r[1] in new]
        assert rows(pairs.close_pairs(some, n, below, sets)) == rows(pairs.close_pairs_of_few(some, sets, n, below)) == want


def test_merging_lists_no_row_per_pair(spark, monkeypatch):
    """Merging finds its pairs without listing all, and merges the same whether the driver keeps the changes of a round or not."""
    monkeypatch.setattr(pairs, "set_pairs", lambda *a, **b: pytest.fail("all pairs listed"))
    rng = np.random.default_rng(1)
    centres = [rng.permutation(30)[:10] for _ in range(3)]
    m = frame(spark, [(g, s, float(rng.normal() + 2 * (s in centres[g % 3]))) for g in range(30) for s in range(30)], "gene long, sample int, value double")
    bics = frame(spark, [(i, "UP") for i in range(12)], "id int, direction string")
    members = frame(spark, sorted({(i, int(g)) for i in range(12) for g in rng.choice(range(i % 3, 30, 3), 4)}), "id int, gene long")
    samples = frame(spark, sorted({(i, int(s)) for i in range(12) for s in rng.choice(centres[i % 3], 9, replace=False)}), "id int, sample int")
    got = []
    for few in (merge.FEW, 0):
        monkeypatch.setattr(merge, "FEW", few)
        got.append([sorted(map(tuple, d.collect())) for d in merge.merge_biclusters(bics, members, samples, m, 30, 0.3, 5)])
    assert got[0] == got[1] and len(got[0][0]) < 12
