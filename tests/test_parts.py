"""The sampler's parts: what they exchange, and how many jobs a step takes."""

import math

import numpy as np
import pytest

from weftlab.operators import gibbs, modules, sampler
from tests.test_operators import frame, net, of_net  # noqa: F401


def test_parts_draw_from_the_counts_of_all(spark, net):  # noqa: F811
    """Five steps of four parts equal parts that are made anew for every step from the labels of all edges."""
    edges, samples = of_net(spark, net)
    cut, parts = sampler.parted(edges, 12, 17)
    rows = sorted((r["part"], r["eid"], r["g1"], r["g2"]) for r in cut.collect())
    have, label = {r[1]: [] for r in rows}, {r[1]: r[1] for r in rows}
    for r in samples.collect():
        have[r["eid"]].append(r["sample"])
    want = []
    for step in range(5):
        eid, g1, g2 = (np.array([r[i] for r in rows]) for i in (1, 2, 3))
        held = gibbs.Part(eid, g1, g2, [np.array(have[e], int) for e in eid], np.array([label[e] for e in eid]), 12, 0.5, 1.0, 5).counts()
        now = {}
        for part in range(parts):
            mine, rest = [r for r in rows if r[0] == part], [r for r in rows if r[0] != part]
            eid, g1, g2 = (np.array([r[i] for r in mine]) for i in (1, 2, 3))
            offered = sorted({(g, k) for r in rest for g in r[2:] for k in (r[1], label[r[1]])})
            drawn = gibbs.Part(eid, g1, g2, [np.array(have[e], int) for e in eid], np.array([label[e] for e in eid]), 12, 0.5, 1.0, 5, held, tuple(np.array(x) for x in zip(*offered, strict=True)))
            drawn.sweep(step)
            now |= dict(zip(drawn.eid.tolist(), drawn.modules[drawn.label].tolist(), strict=True))
        label = now
        want += [(step, e, k) for e, k in label.items()]
    history, _ = sampler.run_sampler(edges, samples, 12, steps=5, seed=5, part_edges=17)
    assert parts == 4 and sorted(map(tuple, history.collect())) == sorted(want)
    settled, converged = sampler.settled_modules(edges, samples, 12, steps=5, seed=5, part_edges=17, needed=2)
    assert not converged and sorted(map(tuple, settled.collect())) == sorted(map(tuple, sampler.final_modules(history, False, 2).collect()))


@pytest.mark.parametrize("part_edges", [None, 17])
def test_more_steps_take_a_job_each_at_most(spark, net, part_edges):  # noqa: F811
    edges, samples = of_net(spark, net)
    took = []
    for steps in (2, 5):
        spark.sparkContext.setJobGroup(f"steps-{steps}-{part_edges}", "")
        sampler.run_sampler(edges, samples, 12, steps=steps, part_edges=part_edges)
        took.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"steps-{steps}-{part_edges}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert took[1] - took[0] == (3 if part_edges else 0)


def test_windows_of_any_length_as_the_operators_tell(spark):
    rng = np.random.default_rng(3)
    for w in (3, 4, 7):
        history = rng.integers(0, 3, (40, w))
        rows = frame(spark, [(s, e, int(history[e, s])) for e in range(40) for s in range(w)], "step int, eid long, module long")
        squares, terms = gibbs.window_change(history)
        one, two = (modules.edge_transitions(rows.filter(f)) for f in (f"step < {w - 1}", "step > 0"))
        assert math.isclose((squares / terms) ** 0.5, modules.transition_rmsd(one, two).first()[0], rel_tol=1e-12)
    assert gibbs.window_change(np.array([[1, 2] * 5 + [1]])) == (0.0, 4)  # shares that are equal differ by nothing at all
