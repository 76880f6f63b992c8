"""Jobs of many rounds: how few tables a round writes, and that its short ways give what the operators give."""

import random

import numpy as np

from tests.test_operators import frame, planted
from weftlab import session
from weftlab.operators import bicluster, merge, network


def written(monkeypatch):
    """The names of the tables that are written from now on."""
    names, path = [], session.new_path
    monkeypatch.setattr(session, "new_path", lambda spark, name: names.append(name) or path(spark, name))
    return names


def test_a_round_of_merging_writes_few_tables(spark, monkeypatch):
    inside = list(range(10))
    m = planted(spark, [(list(range(6)), inside)], 8, 40)
    genes = frame(spark, [(i, g) for i, gs in ((1, (0, 1, 2)), (2, (3, 4, 5)), (3, (1, 3))) for g in gs], "id int, gene long")
    samples = frame(spark, [(i, s) for i in (1, 2, 3) for s in inside], "id int, sample int")
    bics = frame(spark, [(i, "UP") for i in (1, 2, 3)], "id int, direction string")
    names = written(monkeypatch)
    b, g, s = merge.merge_biclusters(bics, genes, samples, m, 40, 0.5, 5)
    assert [tuple(r) for r in b.collect()] == [(1, "UP")] and sorted(tuple(r) for r in g.collect()) == [(1, x) for x in range(6)] and sorted(tuple(r) for r in s.collect()) == [(1, x) for x in inside]
    assert names.count("chosen") == 3  # two rounds, and one that finds no pair
    assert len(names) <= 10 + 3 * 5


def test_united_sets_are_those_of_the_operators(spark):
    """Sets, directions and scores of unions, with null and missing cells, against optimal_sample_set and bicluster_snr."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 70)) + 3 * np.outer(np.arange(30) % 3 == 0, np.arange(70) < 25) - 3 * np.outer(np.arange(30) % 3 == 1, np.arange(70) < 18)
    m = frame(spark, [(g, f"s{s:02d}", None if (g * s) % 31 == 7 else float(x[g, s])) for g in range(30) for s in range(70) if (g + s) % 13], "gene long, sample string, value double")
    numbers = frame(spark, [(f"s{s:02d}", s) for s in range(70)], "sample string, number long")
    ways = {(1, 2): ("UP", "UP"), (3, 4): ("DOWN", "UP"), (5, 6): ("UP", "DOWN"), (7, 8): ("DOWN", "DOWN")}
    sets = {(1, 2): range(0, 30, 3), (3, 4): range(1, 30, 3), (5, 6): range(4, 24), (7, 8): range(2, 30, 3)}
    rows = frame(spark, [(*p, *ways[p], g) for p in sets for g in sets[p]], "i int, j int, d1 string, d2 string, gene long").join(bicluster.profiles(m, numbers), "gene")
    members = frame(spark, [(i, g) for (i, _), gs in sets.items() for g in gs], "id int, gene long")
    hits = 0
    for discordant in (False, True):
        got = {r["i"]: r for r in bicluster.united_sets(rows, 70, 2, 0.2, 5, discordant).collect()}
        for (i, j), (d1, d2) in ways.items():
            want = None
            for d in ["MIXED" if d1 != d2 else d1] if discordant else [d1, d2]:
                mine, way = members.filter(f"id = {i}"), frame(spark, [(i, d)], "id int, direction string")
                found = bicluster.optimal_sample_set(mine, m, way, 70, 5)
                inside = sorted(int(r["sample"][1:]) for r in found.collect())
                if inside:
                    score = bicluster.bicluster_snr(mine, found, m).first()["avgSNR"]
                    want = (j, d, inside) if score >= 0.2 else None
                    break
            r = got.get(i)
            assert (r and (r["j"], r["direction"], [64 * w + b for w, bits in enumerate(r["words"]) for b in range(64) if bits >> b & 1])) == want
            assert r is None or r["size"] == len(want[2])
            hits += want is not None
    assert hits > 3


def test_small_components_without_finding_the_large(spark, monkeypatch):
    rng = random.Random(5)
    pairs = [(rng.randrange(150), rng.randrange(150)) for _ in range(75)] + [(200 + a, 201 + a) for a in range(40)] + [(300, 301), (302, 301), (310, 311), (320, 320)]
    edges = frame(spark, pairs, "g1 long, g2 long")
    near, names = network.NEAR, written(monkeypatch)
    for k in (3, 5):
        monkeypatch.setattr(network, "NEAR", near)
        names.clear()
        got = sorted(map(tuple, network.drop_small_components(edges, k).collect()))
        assert not any(n.startswith("cc-") for n in names) and len(names) <= k
        monkeypatch.setattr(network, "NEAR", 0)
        assert got == sorted(map(tuple, network.drop_small_components(edges, k).collect())) and len(got) < len(pairs) - 1
